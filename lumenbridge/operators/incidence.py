"""The central relation: (pmid, term, year, in_a, in_c, grounded), one row per paper and term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def memberships(corridor: DataFrame) -> DataFrame:
    """(pmid, in_a, in_c) from (pmid, corridor) rows."""
    return corridor.groupBy("pmid").agg(F.max(F.col("corridor") == "A").alias("in_a"), F.max(F.col("corridor") == "C").alias("in_c"))


def flag_papers(papers: DataFrame, corridor: DataFrame) -> DataFrame:
    """``papers`` with ``in_a`` and ``in_c``, false where a paper is in no corridor."""
    return papers.join(memberships(corridor), "pmid", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_a", "in_c")})


def incidence(papers: DataFrame, terms: DataFrame, anchors: tuple[str, ...] = ()) -> DataFrame:
    """Papers (pmid, yr, in_a, in_c) of A or C with their distinct terms (pmid, term[, grounded]), anchors left out."""
    terms = terms if "grounded" in terms.columns else terms.withColumn("grounded", F.lit(False))
    terms = terms.select("pmid", "term", "grounded")
    if anchors:
        terms = terms.filter(~F.col("term").isin(*anchors))
    return papers.filter("in_a OR in_c").select("pmid", "yr", "in_a", "in_c").join(terms, "pmid")


def distinct_terms(descriptors: DataFrame) -> DataFrame:
    """(pmid, term) once each, from (pmid, descriptors array)."""
    return descriptors.select("pmid", F.explode(F.array_distinct("descriptors")).alias("term"))


def ground(papers_terms: DataFrame, relations: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(pmid, term, plain, grounded): whether a relation of the paper mentions the term, and whether it mentions a form of it.

    ``papers_terms`` has (pmid, term), ``relations`` (pmid, relations); the
    match is made inside a paper's own row, so no pair of papers ever meets.
    Without synonyms, the term is its only form.
    """
    if synonyms is not None:
        forms = papers_terms.join(synonyms.select(F.col("descriptor").alias("term"), "forms"), "term", "left")
        one = F.struct("term", F.coalesce("forms", F.array("term")).alias("forms"))
    else:
        forms, one = papers_terms, F.struct("term", F.array("term").alias("forms"))
    own = forms.groupBy("pmid").agg(F.collect_list(one).alias("own"))
    said = relations.groupBy("pmid").agg(F.flatten(F.collect_list(T.mention_texts(F.col("relations")))).alias("mentions"))
    said = said.select("pmid", F.transform(F.array_distinct("mentions"), T.stems).alias("heard"))  # stemmed once a paper, below the join
    rows = own.join(said, "pmid", "left").withColumn("heard", F.coalesce("heard", F.array().cast("array<array<string>>")))

    def judged(t):
        plain = T.any_form_matches(F.array(T.stems(t["term"])), F.col("heard"))
        forms = plain if synonyms is None else T.any_form_matches(F.transform(t["forms"], T.stems), F.col("heard"))
        return F.struct(t["term"].alias("term"), plain.alias("plain"), forms.alias("grounded"))

    return rows.select("pmid", F.explode(F.transform("own", judged)).alias("t")).select("pmid", "t.*")


def node_counts(papers: DataFrame, stats: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row (total_papers, a_df, c_df, terms, candidates): papers of either side, of each side, terms next to one, and candidates that are left."""
    sides = papers.agg(F.count_if(F.col("in_a") | F.col("in_c")).alias("total_papers"), F.count_if("in_a").alias("a_df"), F.count_if("in_c").alias("c_df"))
    found = stats.agg(F.count(F.lit(1)).alias("terms")), candidates.agg(F.count(F.lit(1)).alias("candidates"))
    return sides.join(F.broadcast(found[0])).join(F.broadcast(found[1]))  # one row each


def term_stats(inc: DataFrame) -> DataFrame:
    """Papers of each term per side and in all, and the first year per side; papers without a year count but have none."""
    return inc.groupBy("term").agg(
        F.count_if("in_a").alias("a_df"), F.count_if("in_c").alias("c_df"), F.count(F.lit(1)).alias("total_df"),
        F.min(F.when(F.col("in_a"), F.col("yr"))).alias("a_first_year"), F.min(F.when(F.col("in_c"), F.col("yr"))).alias("c_first_year"),
    )


def edge_evidence(inc: DataFrame, source: str = "cooccurrence") -> DataFrame:
    """Edges of the star: (side, term, source, weight, pmids, years, first_year), lists sorted.

    The only operator that gathers a term's papers: its result is those lists.
    """
    sides = inc.select("term", "pmid", "yr", F.explode(F.filter(F.array(F.when(F.col("in_a"), "A"), F.when(F.col("in_c"), "C")), lambda s: s.isNotNull())).alias("side"))
    return sides.groupBy("side", "term").agg(
        F.count(F.lit(1)).alias("weight"), F.array_sort(F.collect_list("pmid")).alias("pmids"), F.array_sort(F.collect_list("yr")).alias("years"), F.min("yr").alias("first_year"),
    ).withColumn("source", F.lit(source))


def bridges(stats: DataFrame) -> DataFrame:
    """Terms next to both sides, as a set operation."""
    return stats.filter("a_df > 0").select("term").intersect(stats.filter("c_df > 0").select("term"))


def corridor_sizes(papers: DataFrame, cutoffs: list[tuple[str, int]]) -> DataFrame:
    """(split, cutoff, n_a, n_c): papers per side up to each cutoff; papers without a year don't count."""
    aggs = [F.count_if(F.col(side) & (F.col("yr") <= year)).alias(f"{side}{k}") for k, (_, year) in enumerate(cutoffs) for side in ("in_a", "in_c")]
    rows = F.array(*[F.struct(F.lit(n).alias("split"), F.lit(y).alias("cutoff"), F.col(f"in_a{k}").alias("n_a"), F.col(f"in_c{k}").alias("n_c")) for k, (n, y) in enumerate(cutoffs)])
    return papers.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def corridor_overlap(papers: DataFrame) -> DataFrame:
    both, either = F.col("in_a") & F.col("in_c"), F.col("in_a") | F.col("in_c")
    return papers.agg(F.count_if("in_a").alias("n_a"), F.count_if("in_c").alias("n_c"), F.count_if(either).alias("n_union"), F.count_if(both).alias("n_overlap"))
