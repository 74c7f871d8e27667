"""Every query by name, over the driver's tables, and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType

from ..functions import records as R
from ..functions import text as T
from ..operators import discovery, relations, sampling, slicing, store
from ..operators import incidence as inc_
from ..sources import benchdata as B

STUDY, RANKING, OPEN = B.STUDY, B.STUDY.ranking, B.OPEN_RANKING
SPLITS = STUDY.splits
CAP, FLAT, SAMPLE, TOP, BUDGET = 40, 100, 100, 25, 200


def plain(df: DataFrame) -> DataFrame:
    """Counts as BIGINT, booleans as 0 and 1, doubles to nine digits."""
    def cast(f):
        c = F.col(f.name)
        return (c.cast("long") if isinstance(f.dataType, (BooleanType, IntegerType)) else F.round(c, 9) if isinstance(f.dataType, DoubleType) else c).alias(f.name)

    return df.select(*[cast(f) for f in df.schema])


def _inc(s, d):
    return inc_.incidence(B.papers(s, d), B.terms(s, d), STUDY.anchors)


def _grounded_inc(s, d):
    """The incidence whose ``grounded`` tells whether the paper's extracted relations mention the term."""
    return inc_.incidence(B.papers(s, d), _support(s, d), STUDY.anchors)


def _stats(s, d):
    return inc_.term_stats(_inc(s, d))


def _total(s, d):
    return B.papers(s, d).filter("in_a OR in_c").agg(F.count(F.lit(1)).alias("total_papers"))


def _sizes(s, d):
    return inc_.corridor_sizes(B.papers(s, d), [(x.name, x.cutoff) for x in SPLITS])


def _closed(s, d, inc=_inc):
    return slicing.closed_slices(slicing.slice_counts(inc(s, d), SPLITS), _sizes(s, d), RANKING)


def _open(s, d):
    inc = inc_.incidence(B.papers(s, d), B.terms(s, d, "partkey", STUDY.anchors))
    return slicing.open_slices(slicing.slice_counts(inc, SPLITS), _sizes(s, d), OPEN)


def _sweep(s, d, inc=_inc):
    return slicing.hit_sweep(_closed(s, d, inc), F.least("a_post", "c_post"), SPLITS, RANKING)


def _open_sweep(s, d):
    return slicing.hit_sweep(_open(s, d), F.col("absent_post"), SPLITS, OPEN)


def _labels(s, d, inc=_inc):
    return slicing.labelled(slicing.ranked(slicing.scored(_closed(s, d, inc)), RANKING.seed), slicing.threshold(_sweep(s, d, inc), RANKING))


def _grounded_metrics(s, d):
    return slicing.precision_recall(_labels(s, d, _grounded_inc), RANKING)


def _open_labels(s, d):
    return slicing.labelled(slicing.ranked(slicing.open_scored(_open(s, d)), OPEN.seed), slicing.threshold(_open_sweep(s, d), OPEN))


def _support(s, d, with_synonyms=False):
    pairs = B.lines(s, d).select("pmid", "term").distinct()
    return inc_.ground(pairs, B.relations(s, d), B.synonyms(s, d) if with_synonyms else None)


def _articles(s, d):
    return B.table(s, d, "orders").select(F.expr(B.RAW_ARTICLE).alias("raw"), "o_orderkey")


def _gate(s, d):
    return discovery.known_term_gate(discovery.closed_discovery(_stats(s, d), _total(s, d), RANKING), STUDY.known)


def _ranks_of(method):
    def run(s, d):
        ranks = slicing.ranked(slicing.scored(_closed(s, d)).filter(F.col("method") == method), RANKING.seed)
        return ranks.select("split", "term", "score", "rank")
    return run


def incidence(s, d):
    return _inc(s, d).select("pmid", "term", "yr", "in_a", "in_c", "grounded")


def anchor_exclusion(s, d):
    return inc_.incidence(B.papers(s, d), B.terms(s, d), STUDY.anchors).select("pmid", "term")


def edge_evidence(s, d):
    e = inc_.edge_evidence(_inc(s, d))
    return e.select("side", "term", "source", "weight", F.array_join("pmids", ",").alias("pmids"), F.array_join("years", ",").alias("years"), "first_year")


def corridor_union(s, d):
    rows = B.corridor(s, d).withColumn("pos", F.col("pmid"))  # a corridor's order is that of its ids
    return sampling.corridor_union(rows).select("pmid", "corridor")


def tokenize(s, d):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return B.table(s, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def tokenize_stem(s, d):
    t = T.stems(F.coalesce("text", F.lit("")))
    return B.table(s, d, "documents").select("doc_id", F.size(F.array_distinct(t)).alias("n_stems"), F.md5(F.array_join(t, " ")).alias("stems_md5"))


def mention_match(s, d):
    ok = T.matches(T.stems(F.col("p_name")), T.stems(F.col("p_type")))
    sub = T.matches(T.stems(F.substring("p_name", 2, 3)), T.stems(F.col("p_name")))
    swap = T.matches(T.stems(F.concat_ws(" ", "p_name", "p_brand")), T.stems(F.concat_ws("s ", "p_brand", "p_name")))
    return B.table(s, d, "part").select("p_partkey", ok.alias("by_type"), sub.alias("by_substring"), swap.alias("by_subset"))


def mention_match_synonyms(s, d):
    forms = F.transform(F.array(F.concat_ws(" ", "p_brand", "p_name"), F.col("p_name")), T.stems)
    heard = F.transform(F.array(F.col("p_type"), F.concat(F.lit("the "), F.col("p_name"), F.lit("s"))), T.stems)
    return B.table(s, d, "part").select("p_partkey", T.any_form_matches(forms, heard).alias("matched"), T.any_form_matches(F.slice(forms, 1, 1), heard).alias("plain"))


def relations_exploded(s, d):
    return B.relations(s, d).select("pmid", F.explode("relations").alias("r")).select("pmid", F.explode(T.mention_texts(F.array("r"))).alias("mention"))


def llm_json_parse(s, d):
    found, ok = T.parse_relations(F.col("answer"))
    rows = B.table(s, d, "part").select("p_partkey", F.expr(B.ANSWER).alias("answer")).select("p_partkey", found.alias("r"), ok.alias("parse_ok"))
    return rows.select("p_partkey", "parse_ok", F.size("r").alias("n_relations"), F.array_join(F.transform("r", lambda x: F.concat_ws("|", x["subject"], x["predicate"], x["object"], x["evidence"])), ";").alias("relations"))


def prompt_hash(s, d):
    p = B.papers(s, d)
    return p.select("pmid", T.prompt_hash(STUDY.model, "0.0", T.build_prompt(F.col("pub_date"), F.col("abstract"))).alias("prompt_hash"))


def request_key(s, d):
    body = F.concat(F.lit('{"id": "'), F.col("pmid"), F.lit('", "year": '), F.col("pub_year").cast("string"), F.lit("}"))
    return B.papers(s, d).select("pmid", T.request_key(F.lit("fetch"), body).alias("cache_key"))


def synonym_dedupe(s, d):
    forms = T.dedupe_forms(F.col("p_name"), F.array(F.upper("p_name"), F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")), F.lower("p_type"), F.lit(""), F.col("p_brand")))
    return B.table(s, d, "part").select("p_partkey", F.size(forms).alias("n_forms"), F.array_join(forms, "|").alias("forms"))


def coverage_report(s, d):
    return relations.coverage(_support(s, d))


def known_coverage(s, d):
    hints = sorted({h.strip() for k in STUDY.known for h in k.hint.split(";") if h.strip()})
    return relations.known_term_coverage(_support(s, d, True), hints)


def parse_article(s, d):
    a = R.parse_articles(_articles(s, d))
    return a.select("pmid", "pub_date", "pub_year", "journal", "title", "abstract", F.array_join("descriptors", "|").alias("descriptors"))


def abstract_join(s, d):
    parts = F.array(F.col("p_name"), F.lit("  "), F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.col("p_type")), F.lit(" end "))
    blank = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(parts)
    return B.table(s, d, "part").select("p_partkey", R.join_abstract(blank).alias("abstract"))


def pubdate_normalize(s, d):
    k = F.col("o_orderkey")
    year, month, day = (F.date_format("o_orderdate", f) for f in ("yyyy", "MMM", "d"))
    y = F.when(k % 4 != 3, F.concat(F.lit(" "), year))
    m = F.when(k % 4 == 0, month).when(k % 4 == 1, F.month("o_orderdate").cast("string")).when(k % 4 == 2, "13")
    med = F.when((k % 4 == 3) & (k % 8 == 3), F.concat(year, F.lit(" Winter"))).when(k % 16 == 7, "Spring")
    when, yr = R.pub_date(y, m, day, med, F.lit(None).cast("string"), year)
    return B.table(s, d, "orders").select("o_orderkey", when.alias("pub_date"), yr.alias("pub_year"))


def per_year_sample(s, d):
    return sampling.per_year_sample(B.members(s, d), CAP).select("corridor", "pub_year", "pmid", "pos")


def flat_sample(s, d):
    return sampling.flat_sample(B.members(s, d).filter("corridor = 'A'"), FLAT).select("pmid", "pub_date")


def sample_first_n(s, d):
    return sampling.first_with_abstract(B.papers(s, d), SAMPLE).select("pmid", "abstract")


def upsert_latest(s, d):
    e = B.extractions(s, d)  # every paper's
    old, new = e.filter("prompt_hash < '8'"), e.filter("prompt_hash >= '8'")
    return store.upsert_latest(old, new, ["pmid"], [F.desc("created_at"), F.desc("prompt_hash")]).select("pmid", "prompt_hash")


def corridor_insert_ignore(s, d):
    pairs = B.corridor(s, d)
    return store.insert_ignore(pairs.filter("pmid < '5'"), pairs.unionByName(pairs.filter("pmid >= '7'")), ["pmid", "corridor"])


def missing_ids_anti(s, d):
    return sampling.missing_ids(B.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("pmid")), B.papers(s, d).filter("pub_year <= 1998"))


def _targets(s, d):
    return relations.targets(B.papers(s, d), B.corridor(s, d), 1999)


def extraction_pending(s, d):
    return relations.pending(_targets(s, d), B.extractions(s, d, gaps=True), STUDY.model, BUDGET)


def extraction_progress(s, d):
    return relations.progress(_targets(s, d), B.relations(s, d))


def cost_estimate(s, d):
    k = F.col("o_orderkey")
    sample = B.table(s, d, "orders").select(
        (k % 13 != 0).alias("ok"), (k % 17 != 0).alias("parse_ok"), (k % 3 == 0).alias("cached"), (k % 5).alias("n_relations"), (k % 700).alias("input_tokens"), (k % 400).alias("output_tokens"))
    return relations.cost_estimate(sample, _targets(s, d).count(), STUDY.prices)


def membership_flags(s, d):
    bare = B.papers(s, d).drop("in_a", "in_c")
    return inc_.flag_papers(bare, B.corridor(s, d)).select("pmid", "in_a", "in_c")


def article_terms(s, d):
    return inc_.distinct_terms(R.parse_articles(_articles(s, d)).select("pmid", "descriptors"))


def supported_descriptors(s, d):
    """Descriptors of a paper that its mentions support: the terms of its lines against the types it mentions."""
    own = B.lines(s, d).groupBy("pmid").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    heard = B.relations(s, d).select("pmid", T.mention_texts(F.col("relations")).alias("mentions"))
    return own.join(heard, "pmid").select("pmid", F.array_join(T.supported(F.col("terms"), F.col("mentions")), "|").alias("supported"))


def payload_usage(s, d):
    rows = B.table(s, d, "part").select("p_partkey", F.expr(B.PAYLOADS).alias("payload")).select("p_partkey", T.payload_view(F.col("payload")).alias("v"))
    return rows.select("p_partkey", "v.model", F.size("v.relations").alias("n_relations"), F.col("v.usage.prompt_tokens").alias("prompt_tokens"), F.col("v.usage.output_tokens").alias("output_tokens"), F.col("v.usage.total_tokens").alias("total_tokens"), F.col("v.parse_ok").alias("parse_ok"))


def point_lookup(s, d):
    """Papers asked for by id, and whether the store has them, in one join."""
    wanted = B.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("pmid")).distinct()
    return store.lookup(B.papers(s, d).filter("pub_year <= 1998").select("pmid", "pub_date", "pub_year"), wanted, "pmid")


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "incidence": incidence,
    "anchor_exclusion": anchor_exclusion,
    "term_stats": _stats,
    "edge_evidence": edge_evidence,
    "bridge_intersect": lambda s, d: inc_.bridges(_stats(s, d)),
    "corridor_sizes": _sizes,
    "corridor_overlap": lambda s, d: inc_.corridor_overlap(B.papers(s, d)),
    "corridor_union": corridor_union,
    "df_filter": lambda s, d: discovery.df_filter(_stats(s, d), _total(s, d), RANKING).select("term", "total_df"),
    "closed_discovery": lambda s, d: discovery.closed_discovery(_stats(s, d), _total(s, d), RANKING),
    "closed_topk": lambda s, d: discovery.closed_topk(_stats(s, d), _total(s, d), RANKING, TOP),
    "known_term_gate": _gate,
    "gate_verdict": lambda s, d: discovery.gate_verdict(_gate(s, d), RANKING),
    "closed_slices": lambda s, d: _closed(s, d).select("split", "term", "a_pre", "c_pre", "a_post", "c_post", "ga_pre", "gc_pre"),
    "pmi_scores": _ranks_of("pmi"),
    "grounded_scores": _ranks_of("grounded"),
    "hit_sweep_closed": _sweep,
    "threshold_selection": lambda s, d: slicing.threshold(_sweep(s, d), RANKING),
    "precision_recall": lambda s, d: slicing.precision_recall(_labels(s, d), RANKING),
    "top_false_positives": lambda s, d: slicing.false_positives(_labels(s, d)),
    "verdict": lambda s, d: slicing.verdict(slicing.precision_recall(_labels(s, d), RANKING), RANKING),
    "open_slices": lambda s, d: _open(s, d).select("split", "term", "present", "present_pre", "absent_post", "grounded_pre"),
    "hit_sweep_open": _open_sweep,
    "open_precision": lambda s, d: slicing.precision_recall(_open_labels(s, d), OPEN),
    "tokenize": tokenize,
    "tokenize_stem": tokenize_stem,
    "mention_match": mention_match,
    "mention_match_synonyms": mention_match_synonyms,
    "relations_exploded": relations_exploded,
    "grounded_incidence": lambda s, d: _support(s, d).select("pmid", "term", "grounded"),
    "llm_json_parse": llm_json_parse,
    "prompt_hash": prompt_hash,
    "request_key": request_key,
    "synonym_dedupe": synonym_dedupe,
    "coverage_report": coverage_report,
    "known_coverage": known_coverage,
    "parse_article": parse_article,
    "abstract_join": abstract_join,
    "pubdate_normalize": pubdate_normalize,
    "papers_by_year": lambda s, d: sampling.papers_by_year(B.papers(s, d)),
    "papers_upto": lambda s, d: sampling.papers_upto(B.papers(s, d), 1997).select("pmid", "pub_year"),
    "papers_between": lambda s, d: sampling.papers_between(B.papers(s, d), 1998, 1999).select("pmid", "pub_year"),
    "split_sizes": lambda s, d: sampling.split_sizes(B.papers(s, d), SPLITS),
    "corpus_report": lambda s, d: sampling.corpus_report(B.papers(s, d)),
    "per_year_sample": per_year_sample,
    "sampling_report": lambda s, d: sampling.sampling_report(B.members(s, d), CAP),
    "flat_sample": flat_sample,
    "sample_first_n": sample_first_n,
    "upsert_latest": upsert_latest,
    "corridor_insert_ignore": corridor_insert_ignore,
    "missing_ids_anti": missing_ids_anti,
    "extraction_targets": _targets,
    "extraction_pending": extraction_pending,
    "extraction_progress": extraction_progress,
    "cost_estimate": cost_estimate,
    "membership_flags": membership_flags,
    "article_terms": article_terms,
    "supported_descriptors": supported_descriptors,
    "point_lookup": point_lookup,
    "payload_usage": payload_usage,
    "node_counts": lambda s, d: inc_.node_counts(B.papers(s, d), _stats(s, d), discovery.closed_scores(_stats(s, d), _total(s, d), RANKING)),
    "grounded_slices": lambda s, d: _closed(s, d, _grounded_inc).select("split", "term", "a_pre", "c_pre", "a_post", "c_post", "ga_pre", "gc_pre"),
    "grounded_precision": _grounded_metrics,
    "grounded_verdict": lambda s, d: slicing.verdict(_grounded_metrics(s, d), RANKING),
    "open_verdict": lambda s, d: slicing.verdict(slicing.precision_recall(_open_labels(s, d), OPEN), OPEN),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda s, d, f=f: plain(f(s, d))) for name, f in _QUERIES.items()}
