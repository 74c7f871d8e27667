"""The catalogue's queries as plain SQL."""

from __future__ import annotations

from ..functions.text import INSTRUCTIONS, PROMPT_VERSION
from ..sources.benchdata import ANSWER, OPEN_RANKING, PAYLOADS, RAW_ARTICLE, STUDY
from .catalog import BUDGET, CAP, FLAT, SAMPLE, TOP

R = STUDY.ranking
DEV, TEST = STUDY.splits
SEED, MODEL = R.seed, STUDY.model

PAPERS = """
p AS (
  SELECT o_orderkey AS k, o_orderkey::VARCHAR AS pmid, strftime(o_orderdate, '%Y-%m-%d') AS pub_date, year(o_orderdate) AS yr,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority || ' ' || o_orderstatus END AS abstract,
         o_orderpriority = '1-URGENT' AS in_a, coalesce(c_mktsegment = 'BUILDING', false) AS in_c
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), corridor AS (
  SELECT pmid, 'A' AS corridor, yr, pub_date FROM p WHERE in_a UNION ALL SELECT pmid, 'C', yr, pub_date FROM p WHERE in_c
)"""


ANCHORS = ", ".join(f"'{a}'" for a in STUDY.anchors)


def inc(term: str = "p_brand || ' ' || p_name") -> str:
    return PAPERS + f""", lines AS (
  SELECT l_orderkey::VARCHAR AS pmid, {term} AS term, p_brand || ' ' || p_name AS name, p_type, l_returnflag = 'R' AS mentioned FROM lineitem JOIN part ON l_partkey = p_partkey
), terms AS (SELECT pmid, term, bool_or(mentioned) AS grounded FROM lines WHERE name NOT IN ({ANCHORS}) GROUP BY pmid, term),
inc AS (SELECT p.pmid, term, yr, in_a, in_c, grounded FROM p JOIN terms ON p.pmid = terms.pmid WHERE in_a OR in_c)"""


STATS = inc() + """, stats AS (
  SELECT term, count(*) FILTER (in_a) AS a_df, count(*) FILTER (in_c) AS c_df, count(*) AS total_df,
         min(yr) FILTER (in_a) AS a_first_year, min(yr) FILTER (in_c) AS c_first_year
  FROM inc GROUP BY term
), total AS (SELECT count(*) AS total_papers FROM p WHERE in_a OR in_c)"""

CLOSED = STATS + f""", ranked AS (
  SELECT term, a_df, c_df, total_df, a_df * c_df / total_df AS score,
         row_number() OVER (ORDER BY a_df * c_df / total_df DESC, least(a_df, c_df) DESC, term) AS rank
  FROM stats, total WHERE total_df BETWEEN {R.df_min} AND {R.df_max_ratio} * total_papers AND a_df > 0 AND c_df > 0
)"""


def slices(base: str, rows: str = "inc") -> str:
    def counts(s) -> str:
        pre, post = f"yr <= {s.cutoff}", f"yr BETWEEN {s.first} AND {s.last}"
        return f"""SELECT '{s.name}' AS split, term, count(*) FILTER (in_a AND {pre}) AS a_pre, count(*) FILTER (in_c AND {pre}) AS c_pre,
      count(*) FILTER (in_a AND {post}) AS a_post, count(*) FILTER (in_c AND {post}) AS c_post,
      count(*) FILTER (in_a AND {pre} AND grounded) AS ga_pre, count(*) FILTER (in_c AND {pre} AND grounded) AS gc_pre FROM {rows} GROUP BY term"""

    sizes = " UNION ALL ".join(f"SELECT '{s.name}' AS split, {s.cutoff} AS cutoff, count(*) FILTER (in_a AND yr <= {s.cutoff}) AS n_a, count(*) FILTER (in_c AND yr <= {s.cutoff}) AS n_c FROM p" for s in STUDY.splits)
    return base + f""", counts AS ({' UNION ALL '.join(counts(s) for s in STUDY.splits)}), sizes AS ({sizes}),
slices AS (SELECT c.*, n_a, n_c FROM counts c JOIN sizes s ON c.split = s.split)"""


CLOSED_CAND = f""", cand AS (
  SELECT *, least(a_post, c_post) AS hit_count FROM slices
  WHERE a_pre >= 1 AND c_pre >= 1 AND a_pre + c_pre BETWEEN {R.df_min} AND {R.df_max_ratio} * (n_a + n_c)
)"""
CSLICES = slices(inc()) + CLOSED_CAND
OSLICES = slices(inc("l_partkey::VARCHAR")) + f""", cand AS (
  SELECT * FROM (
    SELECT split, term, n_a, n_c, CASE WHEN a_pre >= 1 THEN 'A' ELSE 'C' END AS present, CASE WHEN a_pre >= 1 THEN a_pre ELSE c_pre END AS present_pre,
           CASE WHEN a_pre >= 1 THEN c_post ELSE a_post END AS hit_count, CASE WHEN a_pre >= 1 THEN ga_pre ELSE gc_pre END AS grounded_pre
    FROM slices WHERE (a_pre >= 1) <> (c_pre >= 1)
  ) WHERE present_pre BETWEEN {OPEN_RANKING.df_min} AND {OPEN_RANKING.df_max_ratio} * (n_a + n_c)
)"""


def pmi(a: str, c: str) -> str:
    base = f"(({a} + {c}) / (n_a + n_c))"
    return f"""CASE WHEN n_a > 0 AND n_c > 0 AND {a} + {c} > 0 THEN round(CASE WHEN {a} > 0 THEN ln(({a} / n_a) / {base}) ELSE 0 END + CASE WHEN {c} > 0 THEN ln(({c} / n_c) / {base}) ELSE 0 END, 9) ELSE 0 END"""


def ranked(base: str, methods: list[tuple[str, str]]) -> str:
    scores = " UNION ALL ".join([f"SELECT split, '{m}' AS method, term, ({s})::DOUBLE AS score, hit_count, '' AS shuffle FROM cand" for m, s in methods] + [f"SELECT split, 'random', term, NULL, hit_count, md5('{SEED}:' || term) FROM cand"])
    return base + f""", scores AS ({scores}),
ranks AS (SELECT *, row_number() OVER (PARTITION BY split, method ORDER BY score DESC NULLS LAST, shuffle, term) AS rank FROM scores)"""


def sweep(base: str) -> str:
    return base + f""", sweep AS (
  SELECT s.split, n, coalesce(count(c.term), 0) AS candidates, coalesce(count(*) FILTER (hit_count >= n), 0) AS hits,
         CASE WHEN count(c.term) > 0 THEN round(count(*) FILTER (hit_count >= n) / count(c.term), 9) ELSE 0 END AS rate
  FROM (SELECT unnest(['{DEV.name}', '{TEST.name}']) AS split) s CROSS JOIN (SELECT unnest({list(R.sweep)}) AS n) LEFT JOIN cand c ON c.split = s.split
  GROUP BY s.split, n
), star AS (SELECT coalesce(min(n) FILTER (split = 'dev' AND hits >= {R.least_hits} AND rate <= {R.most_rate}), 1) AS n_star FROM sweep)"""


CLOSED_METHODS = [("grounded", pmi("ga_pre", "gc_pre")), ("pmi", pmi("a_pre", "c_pre")), ("frequency", "a_pre + c_pre")]
SCORED = sweep(ranked(CSLICES, CLOSED_METHODS)) + ", labels AS (SELECT ranks.*, n_star, hit_count >= n_star AS hit FROM ranks, star)"
OSCORED = sweep(ranked(OSLICES, [("grounded", "grounded_pre"), ("frequency", "present_pre")])) + ", labels AS (SELECT ranks.*, n_star, hit_count >= n_star AS hit FROM ranks, star)"
METRICS = f""", metrics AS (
  SELECT split, method, k, max(n_star) AS n_star, round(count(*) FILTER (hit AND rank <= k) / k, 9) AS precision,
         CASE WHEN count(*) FILTER (hit) > 0 THEN round(count(*) FILTER (hit AND rank <= k) / count(*) FILTER (hit), 9) ELSE 0 END AS recall
  FROM labels, (SELECT unnest({list(R.top_k)}) AS k) GROUP BY split, method, k
)"""
SHOW_METRICS = "SELECT split, method, k::BIGINT AS k, n_star::BIGINT AS n_star, precision::DOUBLE AS precision, recall::DOUBLE AS recall FROM metrics"
SHOW_SWEEP = "SELECT split, n::BIGINT AS n, candidates::BIGINT AS candidates, hits::BIGINT AS hits, rate::DOUBLE AS rate FROM sweep"

VERDICT = f""", v AS (SELECT max(precision) FILTER (method = 'grounded') AS g, max(precision) FILTER (method = 'frequency') AS f, max(precision) FILTER (method = 'random') AS r FROM metrics WHERE split = 'test' AND k = {R.top_k[0]})
 SELECT 'grounded' AS model, g::DOUBLE AS model_p, f::DOUBLE AS frequency_p, r::DOUBLE AS random_p, (g > f AND g >= r)::BIGINT AS passed FROM v"""


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def stems(x: str) -> str:
    return f"list_transform({toks(x)}, lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' THEN t[:-2] ELSE t END)"


def match(d: str, m: str) -> str:
    """Of two lists of stems."""
    return f"(len({d}) > 0 AND len({m}) > 0 AND (contains(array_to_string({m}, ' '), array_to_string({d}, ' ')) OR list_has_all({m}, {d})))"


def support(forms: str) -> str:
    return inc() + f""", said AS (
  SELECT DISTINCT pmid, unnest([term, p_type]) AS mention FROM lines WHERE mentioned
), heard AS (SELECT pmid, {stems('mention')} AS m FROM said),
forms AS (SELECT DISTINCT pmid, term, {stems('f')} AS f FROM (SELECT pmid, term, unnest({forms}) AS f FROM (SELECT DISTINCT pmid, term FROM lines))),
support AS (SELECT forms.pmid, term, coalesce(bool_or({match('f', 'm')}), false) AS grounded FROM forms LEFT JOIN heard ON forms.pmid = heard.pmid GROUP BY ALL)"""


SUPPORT = support("[term]")
GSLICES = slices(SUPPORT + f", ginc AS (SELECT p.pmid, term, yr, in_a, in_c, grounded FROM p JOIN support ON p.pmid = support.pmid WHERE (in_a OR in_c) AND term NOT IN ({ANCHORS}))", "ginc") + CLOSED_CAND
GSCORED = sweep(ranked(GSLICES, CLOSED_METHODS)) + ", labels AS (SELECT ranks.*, n_star, hit_count >= n_star AS hit FROM ranks, star)"
HINTS = sorted({h.strip() for k in STUDY.known for h in k.hint.split(";") if h.strip()})
KNOWN = ", ".join(f"('{k.label}', '{k.hint}')" for k in STUDY.known)
GATE = CLOSED + f""", hints AS (
  SELECT label, unnest(list_filter(list_transform(string_split(hint, ';'), lambda h: trim(h)), lambda h: h <> '')) AS hint FROM (VALUES {KNOWN}) v(label, hint)
), gate AS (SELECT label, min_by(term, rank) AS best_descriptor, min(rank) AS best_rank FROM hints LEFT JOIN ranked ON hint = term GROUP BY label)"""

STRIPPED = f"""answers AS (SELECT p_partkey, trim({ANSWER}) AS t FROM part),
opened AS (SELECT p_partkey, t LIKE '```%' AS fenced, CASE WHEN t LIKE '```%' AND contains(t, chr(10)) THEN regexp_replace(t, '^```[^\\n]*\\n', '') ELSE t END AS t FROM answers),
closed AS (SELECT p_partkey, fenced, CASE WHEN fenced THEN trim(regexp_replace(t, '\\s*```\\s*$', '')) ELSE t END AS t FROM opened),
bare AS (SELECT p_partkey, CASE WHEN fenced AND t LIKE 'json%' THEN trim(t[5:]) ELSE t END AS t FROM closed),
parsed AS (SELECT p_partkey, CASE WHEN json_valid(t) THEN json_type(t, '$.relations') = 'ARRAY' ELSE false END AS ok, t FROM bare),
triples AS (
  SELECT p_partkey, i, trim(r->>'subject') AS s, trim(r->>'predicate') AS p, trim(r->>'object') AS o, trim(r->>'evidence') AS e
  FROM (SELECT p_partkey, unnest(range(0, json_array_length(t, '$.relations')::BIGINT)) AS i, json_extract(t, '$.relations[' || i || ']') AS r FROM parsed WHERE ok)
), kept AS (SELECT p_partkey, count(*) AS n, string_agg(s || '|' || p || '|' || o || '|' || e, ';' ORDER BY i) AS relations FROM triples WHERE s <> '' AND p <> '' AND o <> '' GROUP BY p_partkey)"""


def month(m: str) -> str:
    names = " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1))
    return f"CASE WHEN regexp_full_match(trim({m}), '[0-9]+') THEN CASE WHEN trim({m})::INT BETWEEN 1 AND 12 THEN trim({m})::INT END ELSE CASE lower(substr(trim({m}), 1, 3)) {names} END END"


def year_of(x: str) -> str:
    return f"CASE WHEN regexp_full_match(substr(trim({x}), 1, 4), '[0-9]+') THEN substr(trim({x}), 1, 4)::INT END"


def dated(source: str) -> str:
    """From a source with k, y, m, d, med, other."""
    return f"""dm AS (SELECT *, nullif(trim(y), '') AS yy, {month('m')} AS mm, trim(d) AS dd FROM ({source})),
dd AS (
  SELECT *, CASE WHEN yy IS NULL THEN nullif(med, '') WHEN mm IS NULL THEN yy WHEN regexp_full_match(dd, '[0-9]+') THEN yy || '-' || lpad(mm::VARCHAR, 2, '0') || '-' || CASE WHEN length(dd) < 2 THEN lpad(dd, 2, '0') ELSE dd END
         ELSE yy || '-' || lpad(mm::VARCHAR, 2, '0') END AS own_date,
         CASE WHEN yy IS NULL THEN {year_of("nullif(med, '')")} ELSE {year_of('yy')} END AS own_year, {year_of('other')} AS other_year
  FROM dm
), dates AS (SELECT *, coalesce(own_date, CASE WHEN own_year IS NULL THEN other_year::VARCHAR END) AS pub_date, coalesce(own_year, other_year) AS pub_year FROM dd)"""


def extracted(where: str) -> str:
    return f"""e AS (
  SELECT o_orderkey::VARCHAR AS pmid, CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE '{MODEL}' END AS model, md5(o_orderkey || '/' || try) AS prompt_hash, o_orderdate AS created_at
  FROM (SELECT *, unnest(range(1, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 2 END)) AS try FROM orders WHERE {where})
)"""


TARGETS = PAPERS + ", targets AS (SELECT pmid FROM p WHERE abstract IS NOT NULL AND abstract <> '' AND yr <= 1999 AND (in_a OR in_c))"
PRICES = STUDY.prices
DEDUPE = "[p_name, upper(p_name), trim(' ' || p_type || ' '), lower(p_type), p_brand]"


def oracle_sql() -> dict[str, str]:
    w = "WITH "
    return {
        "incidence": w + inc() + " SELECT pmid, term, yr::BIGINT AS yr, in_a::BIGINT AS in_a, in_c::BIGINT AS in_c, grounded::BIGINT AS grounded FROM inc",
        "anchor_exclusion": w + inc() + " SELECT pmid, term FROM inc",
        "term_stats": w + STATS + " SELECT term, a_df::BIGINT AS a_df, c_df::BIGINT AS c_df, total_df::BIGINT AS total_df, a_first_year::BIGINT AS a_first_year, c_first_year::BIGINT AS c_first_year FROM stats",
        "edge_evidence": w + inc() + ", s AS (SELECT 'A' AS side, * FROM inc WHERE in_a UNION ALL SELECT 'C', * FROM inc WHERE in_c) SELECT side, term, 'cooccurrence' AS source, count(*)::BIGINT AS weight, string_agg(pmid, ',' ORDER BY pmid) AS pmids, string_agg(yr::VARCHAR, ',' ORDER BY yr) AS years, min(yr)::BIGINT AS first_year FROM s GROUP BY side, term",
        "bridge_intersect": w + STATS + " SELECT term FROM stats WHERE a_df > 0 INTERSECT SELECT term FROM stats WHERE c_df > 0",
        "corridor_sizes": w + slices(inc()) + " SELECT split, cutoff::BIGINT AS cutoff, n_a::BIGINT AS n_a, n_c::BIGINT AS n_c FROM sizes",
        "corridor_overlap": w + PAPERS + " SELECT count(*) FILTER (in_a)::BIGINT AS n_a, count(*) FILTER (in_c)::BIGINT AS n_c, count(*) FILTER (in_a OR in_c)::BIGINT AS n_union, count(*) FILTER (in_a AND in_c)::BIGINT AS n_overlap FROM p",
        "corridor_union": w + PAPERS + " SELECT pmid, min(corridor) AS corridor FROM corridor GROUP BY pmid",
        "df_filter": w + STATS + f" SELECT term, total_df::BIGINT AS total_df FROM stats, total WHERE total_df BETWEEN {R.df_min} AND {R.df_max_ratio} * total_papers",
        "closed_discovery": w + CLOSED + " SELECT term, a_df::BIGINT AS a_df, c_df::BIGINT AS c_df, total_df::BIGINT AS total_df, round(score, 9) AS score, rank::BIGINT AS rank FROM ranked",
        "closed_topk": w + CLOSED + f" SELECT term, a_df::BIGINT AS a_df, c_df::BIGINT AS c_df, total_df::BIGINT AS total_df, round(score, 9) AS score, rank::BIGINT AS rank FROM ranked WHERE rank <= {TOP}",
        "known_term_gate": w + GATE + " SELECT label, best_descriptor, best_rank::BIGINT AS best_rank FROM gate",
        "gate_verdict": w + GATE + f" SELECT count(best_rank)::BIGINT AS found, count(*)::BIGINT AS known, (count(best_rank) >= {R.gate_least})::BIGINT AS passed FROM gate",
        "closed_slices": w + CSLICES + " SELECT split, term, a_pre::BIGINT AS a_pre, c_pre::BIGINT AS c_pre, a_post::BIGINT AS a_post, c_post::BIGINT AS c_post, ga_pre::BIGINT AS ga_pre, gc_pre::BIGINT AS gc_pre FROM cand",
        "pmi_scores": w + SCORED + " SELECT split, term, score, rank::BIGINT AS rank FROM ranks WHERE method = 'pmi'",
        "grounded_scores": w + SCORED + " SELECT split, term, score, rank::BIGINT AS rank FROM ranks WHERE method = 'grounded'",
        "hit_sweep_closed": w + SCORED + " " + SHOW_SWEEP,
        "threshold_selection": w + SCORED + " SELECT n_star::BIGINT AS n_star FROM star",
        "precision_recall": w + SCORED + METRICS + " " + SHOW_METRICS,
        "top_false_positives": w + SCORED + " SELECT split, method, rank::BIGINT AS rank, term FROM labels WHERE rank <= 10 AND NOT hit",
        "verdict": w + SCORED + METRICS + VERDICT,
        "grounded_verdict": w + GSCORED + METRICS + VERDICT,
        "open_verdict": w + OSCORED + METRICS + VERDICT,
        "grounded_slices": w + GSLICES + " SELECT split, term, a_pre::BIGINT AS a_pre, c_pre::BIGINT AS c_pre, a_post::BIGINT AS a_post, c_post::BIGINT AS c_post, ga_pre::BIGINT AS ga_pre, gc_pre::BIGINT AS gc_pre FROM cand",
        "grounded_precision": w + GSCORED + METRICS + " " + SHOW_METRICS,
        "node_counts": w + CLOSED + """ SELECT (SELECT total_papers FROM total)::BIGINT AS total_papers, (SELECT count(*) FROM p WHERE in_a)::BIGINT AS a_df, (SELECT count(*) FROM p WHERE in_c)::BIGINT AS c_df,
 (SELECT count(*) FROM stats)::BIGINT AS terms, (SELECT count(*) FROM ranked)::BIGINT AS candidates""",
        "membership_flags": w + PAPERS + " SELECT pmid, in_a::BIGINT AS in_a, in_c::BIGINT AS in_c FROM p",
        "article_terms": f"""WITH raw AS (SELECT {RAW_ARTICLE} AS j FROM orders), c AS (SELECT json_extract(j, '$.MedlineCitation') AS c FROM raw)
 SELECT DISTINCT c->>'PMID' AS pmid, term FROM (SELECT c, unnest(json_extract_string(c, '$.MeshHeadingList[*].DescriptorName')) AS term FROM c WHERE json_extract(c, '$.Article') IS NOT NULL) WHERE term <> ''""",
        "supported_descriptors": w + SUPPORT + """ SELECT pmid, coalesce(string_agg(term, '|' ORDER BY term) FILTER (grounded), '') AS supported FROM support WHERE pmid IN (SELECT pmid FROM said) GROUP BY pmid""",
        "payload_usage": f"""WITH j AS (SELECT p_partkey, ({PAYLOADS})::JSON AS j FROM part)
 SELECT p_partkey, j->>'model' AS model, (CASE WHEN j->>'$.relations[0].object' <> '' THEN 1 ELSE 0 END)::BIGINT AS n_relations, coalesce((j->>'$.usage.prompt_tokens')::BIGINT, 0) AS prompt_tokens,
  coalesce((j->>'$.usage.output_tokens')::BIGINT, 0) AS output_tokens, coalesce((j->>'$.usage.total_tokens')::BIGINT, 0) AS total_tokens, coalesce((j->>'parse_ok')::BOOLEAN, true)::BIGINT AS parse_ok FROM j""",
        "point_lookup": w + PAPERS + " SELECT w.pmid, pub_date, yr::BIGINT AS pub_year, (p.pmid IS NOT NULL)::BIGINT AS found FROM (SELECT DISTINCT l_orderkey::VARCHAR AS pmid FROM lineitem) w LEFT JOIN (SELECT * FROM p WHERE yr <= 1998) p ON w.pmid = p.pmid",
        "open_slices": w + OSLICES + " SELECT split, term, present, present_pre::BIGINT AS present_pre, hit_count::BIGINT AS absent_post, grounded_pre::BIGINT AS grounded_pre FROM cand",
        "hit_sweep_open": w + OSCORED + " " + SHOW_SWEEP,
        "open_precision": w + OSCORED + METRICS + " " + SHOW_METRICS,
        "tokenize": f"SELECT doc_id, len({toks('text')})::BIGINT AS n_tokens, md5(array_to_string({toks('text')}, ' ')) AS tokens_md5 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        "tokenize_stem": f"SELECT doc_id, len(list_distinct({stems('text')}))::BIGINT AS n_stems, md5(array_to_string({stems('text')}, ' ')) AS stems_md5 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        "mention_match": f"""SELECT p_partkey, {match(stems('p_name'), stems('p_type'))}::BIGINT AS by_type, {match(stems('substr(p_name, 2, 3)'), stems('p_name'))}::BIGINT AS by_substring,
 {match(stems("p_name || ' ' || p_brand"), stems("p_brand || 's ' || p_name"))}::BIGINT AS by_subset FROM part""",
        "mention_match_synonyms": f"""WITH x AS (SELECT p_partkey, {stems("p_brand || ' ' || p_name")} AS f1, {stems('p_name')} AS f2, {stems('p_type')} AS m1, {stems("'the ' || p_name || 's'")} AS m2 FROM part)
 SELECT p_partkey, ({match('f1', 'm1')} OR {match('f1', 'm2')} OR {match('f2', 'm1')} OR {match('f2', 'm2')})::BIGINT AS matched, ({match('f1', 'm1')} OR {match('f1', 'm2')})::BIGINT AS plain FROM x""",
        "relations_exploded": w + inc() + ", t AS (SELECT DISTINCT pmid, term, p_type FROM lines WHERE mentioned) SELECT pmid, unnest([term, p_type]) AS mention FROM t",
        "grounded_incidence": w + SUPPORT + " SELECT pmid, term, grounded::BIGINT AS grounded FROM support",
        "llm_json_parse": w + STRIPPED + " SELECT parsed.p_partkey, ok::BIGINT AS parse_ok, coalesce(n, 0)::BIGINT AS n_relations, coalesce(relations, '') AS relations FROM parsed LEFT JOIN kept ON parsed.p_partkey = kept.p_partkey",
        "prompt_hash": w + PAPERS + f""" SELECT pmid, sha256('{MODEL}' || chr(0) || '{PROMPT_VERSION}' || chr(0) || 't=0.0' || chr(0) || '{INSTRUCTIONS}' || chr(10) || chr(10) || 'Title: ' || pub_date || chr(10) || 'Abstract: ' || trim(coalesce(abstract, '')) || chr(0)) AS prompt_hash FROM p""",
        "request_key": w + PAPERS + """ SELECT pmid, sha256('fetch|{"id": "' || pmid || '", "year": ' || yr || '}') AS cache_key FROM p""",
        "synonym_dedupe": f"""WITH x AS (SELECT p_partkey, {DEDUPE} AS f FROM part), y AS (SELECT p_partkey, unnest(f) AS f, unnest(range(1, len(f) + 1)) AS i FROM x),
 z AS (SELECT p_partkey, arg_min(f, i) AS f, min(i) AS i FROM y GROUP BY p_partkey, lower(f)) SELECT p_partkey, count(*)::BIGINT AS n_forms, string_agg(f, '|' ORDER BY i) AS forms FROM z GROUP BY p_partkey""",
        "coverage_report": w + SUPPORT + ", c AS (SELECT pmid, count(*) AS n, count(*) FILTER (grounded) AS s FROM support GROUP BY pmid) SELECT sum(n)::BIGINT AS descriptors, sum(s)::BIGINT AS supported, count(*)::BIGINT AS papers, count(*) FILTER (s > 0)::BIGINT AS papers_with_support, round(sum(s) / sum(n), 9) AS support_share FROM c",
        "known_coverage": w + SUPPORT + f""", sforms AS (SELECT pmid, term, {stems("term")} AS f FROM (SELECT DISTINCT pmid, term FROM lines) UNION SELECT pmid, term, {stems("regexp_replace(term, '^[^ ]+ ', '')")} FROM (SELECT DISTINCT pmid, term FROM lines)),
 syn AS (SELECT sforms.pmid, term, coalesce(bool_or({match('f', 'm')}), false) AS grounded FROM sforms LEFT JOIN heard ON sforms.pmid = heard.pmid GROUP BY ALL)
 SELECT a.term, count(*)::BIGINT AS seen, count(*) FILTER (a.grounded)::BIGINT AS plain, count(*) FILTER (b.grounded)::BIGINT AS synonym FROM support a JOIN syn b ON a.pmid = b.pmid AND a.term = b.term WHERE a.term IN ({', '.join(f"'{h}'" for h in HINTS)}) GROUP BY a.term""",
        "parse_article": f"""WITH raw AS (SELECT {RAW_ARTICLE} AS j FROM orders), c AS (SELECT json_extract(j, '$.MedlineCitation') AS c FROM raw),
 a AS (SELECT c, json_extract(c, '$.Article') AS a, json_extract(c, '$.Article.Journal.JournalIssue.PubDate') AS q, json_extract(c, '$.Article.Abstract.AbstractText') AS x FROM c WHERE (c->>'PMID') IS NOT NULL AND json_extract(c, '$.Article') IS NOT NULL),
 {dated("SELECT c, a, x, c->>'PMID' AS pmid, q->>'Year' AS y, q->>'Month' AS m, q->>'Day' AS d, q->>'MedlineDate' AS med, coalesce(c->>'$.DateCompleted.Year', c->>'$.DateRevised.Year') AS other FROM a")}
 SELECT pmid, pub_date, pub_year::BIGINT AS pub_year, a->>'$.Journal.Title' AS journal, a->>'ArticleTitle' AS title,
  CASE WHEN json_type(x) = 'ARRAY' THEN nullif(array_to_string(list_filter(x::VARCHAR[], lambda p: trim(p) <> ''), chr(10)), '') ELSE nullif(trim(x->>'$'), '') END AS abstract,
  array_to_string(list_filter(list_distinct(json_extract_string(c, '$.MeshHeadingList[*].DescriptorName')), lambda n: n <> ''), '|') AS descriptors FROM dates""",
        "abstract_join": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE array_to_string(list_filter([p_name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END, ' end '], lambda p: p IS NOT NULL AND trim(p) <> ''), chr(10)) END AS abstract FROM part""",
        "pubdate_normalize": "WITH " + dated("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 3 THEN ' ' || year(o_orderdate) END AS y, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%b') WHEN 1 THEN month(o_orderdate)::VARCHAR WHEN 2 THEN '13' END AS m,
 day(o_orderdate)::VARCHAR AS d, CASE WHEN o_orderkey % 8 = 3 THEN year(o_orderdate) || ' Winter' WHEN o_orderkey % 16 = 7 THEN 'Spring' END AS med, year(o_orderdate)::VARCHAR AS other FROM orders""") + " SELECT k AS o_orderkey, pub_date, pub_year::BIGINT AS pub_year FROM dates",
        "papers_by_year": w + PAPERS + " SELECT yr::BIGINT AS pub_year, count(*)::BIGINT AS n FROM p GROUP BY yr",
        "papers_upto": w + PAPERS + " SELECT pmid, yr::BIGINT AS pub_year FROM p WHERE yr IS NOT NULL AND yr <= 1997",
        "papers_between": w + PAPERS + " SELECT pmid, yr::BIGINT AS pub_year FROM p WHERE yr BETWEEN 1998 AND 1999",
        "split_sizes": w + PAPERS + " " + " UNION ALL ".join(f"SELECT '{s.name}' AS split, count(*) FILTER (yr <= {s.cutoff})::BIGINT AS pre, count(*) FILTER (yr BETWEEN {s.first} AND {s.last})::BIGINT AS post FROM p" for s in STUDY.splits),
        "corpus_report": w + PAPERS + """ SELECT count(*)::BIGINT AS papers, count(*) FILTER (abstract <> '')::BIGINT AS with_abstract, round(count(*) FILTER (abstract <> '') / count(*), 9) AS abstract_share,
 count(*) FILTER (in_a)::BIGINT AS n_a, count(*) FILTER (in_c)::BIGINT AS n_c, count(*) FILTER (in_a AND in_c)::BIGINT AS n_overlap, min(yr)::BIGINT AS first_year, max(yr)::BIGINT AS last_year FROM p""",
        "per_year_sample": w + PAPERS + f", r AS (SELECT *, row_number() OVER (PARTITION BY corridor, yr ORDER BY pub_date DESC, pmid) AS pos FROM corridor) SELECT corridor, yr::BIGINT AS pub_year, pmid, pos::BIGINT AS pos FROM r WHERE pos <= {CAP}",
        "sampling_report": w + PAPERS + f", y AS (SELECT corridor, yr, count(*) AS n FROM corridor GROUP BY ALL) SELECT corridor, sum(n)::BIGINT AS total_hits, sum(least(n, {CAP}))::BIGINT AS sampled, count(*) FILTER (n > {CAP})::BIGINT AS capped_years, (max(n) > {CAP})::BIGINT AS truncated FROM y GROUP BY corridor",
        "flat_sample": w + PAPERS + f" SELECT pmid, pub_date FROM corridor WHERE corridor = 'A' ORDER BY pub_date DESC, pmid LIMIT {FLAT}",
        "sample_first_n": w + PAPERS + f" SELECT pmid, abstract FROM p WHERE abstract <> '' ORDER BY pmid LIMIT {SAMPLE}",
        "upsert_latest": w + extracted("true") + " SELECT pmid, max(prompt_hash) AS prompt_hash FROM e GROUP BY pmid",
        "corridor_insert_ignore": w + PAPERS + " SELECT DISTINCT pmid, corridor FROM corridor WHERE pmid >= '5'",
        "missing_ids_anti": w + PAPERS + " SELECT DISTINCT l_orderkey::VARCHAR AS pmid FROM lineitem WHERE l_orderkey::VARCHAR NOT IN (SELECT pmid FROM p WHERE yr <= 1998)",
        "extraction_targets": w + TARGETS + " SELECT pmid FROM targets",
        "extraction_pending": w + TARGETS + ", " + extracted("o_orderkey % 4 <> 0") + f" SELECT pmid FROM targets WHERE pmid NOT IN (SELECT pmid FROM e WHERE model = '{MODEL}') ORDER BY pmid LIMIT {BUDGET}",
        "extraction_progress": w + TARGETS + """, r AS (SELECT pmid, count(*) AS n FROM (SELECT DISTINCT l_orderkey::VARCHAR AS pmid, p_brand, p_name, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R') GROUP BY pmid)
 SELECT count(*)::BIGINT AS targets, count(n)::BIGINT AS extracted, count(*) FILTER (n IS NULL)::BIGINT AS remaining, coalesce(sum(n), 0)::BIGINT AS relations, count(*) FILTER (n > 0)::BIGINT AS papers_with_relations FROM targets LEFT JOIN r ON targets.pmid = r.pmid""",
        "cost_estimate": w + TARGETS + f""", papers AS (SELECT count(*)::DOUBLE AS n_papers FROM targets), s AS (SELECT o_orderkey % 13 <> 0 AS ok, o_orderkey % 17 <> 0 AS pok, o_orderkey % 3 = 0 AS cached, o_orderkey % 5 AS n, o_orderkey % 700 AS i, o_orderkey % 400 AS o FROM orders),
 a AS (SELECT count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (ok AND NOT pok) AS parse_failures, count(*) FILTER (ok AND cached) AS cached, count(*) FILTER (ok AND NOT cached) AS fresh, sum(n) FILTER (ok) AS relations, count(*) FILTER (ok AND n > 0) AS with_relations, avg(i) FILTER (ok) AS mean_in, avg(o) FILTER (ok) AS mean_out FROM s)
 SELECT attempts::BIGINT AS attempts, successes::BIGINT AS successes, parse_failures::BIGINT AS parse_failures, cached::BIGINT AS cached, fresh::BIGINT AS fresh, relations::BIGINT AS relations, with_relations::BIGINT AS with_relations, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out,
 round(mean_in * n_papers, 3) AS total_in, round(mean_out * n_papers, 3) AS total_out, round((mean_in * n_papers * {PRICES.input_per_million} + mean_out * n_papers * {PRICES.output_per_million}) / 1e6, 6) AS cost,
 round(n_papers / {PRICES.requests_per_day}, 6) AS days, round(n_papers / {PRICES.requests_per_minute}, 6) AS minutes FROM a, papers""",
    }
