"""Corpus sampling and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Split


def per_year_sample(members: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` papers of each (corridor, year): columns corridor, pub_year, pmid, pub_date, pos."""
    w = Window.partitionBy("corridor", "pub_year").orderBy(F.desc("pub_date"), "pmid")
    return members.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= cap)


def sampling_report(members: DataFrame, cap: int) -> DataFrame:
    """(corridor, total_hits, sampled, capped_years, truncated)."""
    by = members.groupBy("corridor", "pub_year").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("corridor").agg(
        F.sum("n").alias("total_hits"), F.sum(F.least("n", F.lit(cap))).alias("sampled"), F.count_if(F.col("n") > cap).alias("capped_years"), (F.max("n") > cap).alias("truncated"))


def flat_sample(members: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` papers whatever their year (biased to recent years)."""
    return members.orderBy(F.desc("pub_date"), "pmid").limit(n)


def corridor_union(members: DataFrame) -> DataFrame:
    """Each paper once, under the corridor and position where it first stands: corridors in order, then position."""
    w = Window.partitionBy("pmid").orderBy("corridor", "pos")
    return members.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def first_with_abstract(papers: DataFrame, n: int) -> DataFrame:
    """The first ``n`` papers by id that have an abstract."""
    return papers.filter(F.col("abstract").isNotNull() & (F.col("abstract") != "")).orderBy("pmid").limit(n)


def papers_by_year(papers: DataFrame) -> DataFrame:
    """(pub_year, n), papers without a year as a group of their own."""
    return papers.groupBy("pub_year").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first("pub_year"))


def papers_upto(papers: DataFrame, year: int) -> DataFrame:
    return papers.filter(F.col("pub_year").isNotNull() & (F.col("pub_year") <= year))


def papers_between(papers: DataFrame, first: int, last: int) -> DataFrame:
    return papers.filter(F.col("pub_year").between(first, last))


def split_sizes(papers: DataFrame, splits: tuple[Split, ...]) -> DataFrame:
    """(split, pre, post) of all papers."""
    yr = F.col("pub_year")
    aggs = [c for s in splits for c in (F.count_if(yr <= s.cutoff).alias(f"pre_{s.name}"), F.count_if(yr.between(s.first, s.last)).alias(f"post_{s.name}"))]
    rows = F.array(*[F.struct(F.lit(s.name).alias("split"), F.col(f"pre_{s.name}").alias("pre"), F.col(f"post_{s.name}").alias("post")) for s in splits])
    return papers.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def corpus_report(papers: DataFrame) -> DataFrame:
    """One row: papers, with abstract, and its share, per corridor and in all."""
    some = F.col("abstract").isNotNull() & (F.col("abstract") != "")
    n, m = F.count(F.lit(1)), F.count_if(some)
    return papers.agg(
        n.alias("papers"), m.alias("with_abstract"), F.round(F.coalesce(m / F.nullif(n, F.lit(0)), F.lit(0.0)), 9).alias("abstract_share"),
        F.count_if("in_a").alias("n_a"), F.count_if("in_c").alias("n_c"), F.count_if(F.col("in_a") & F.col("in_c")).alias("n_overlap"), F.min("pub_year").alias("first_year"), F.max("pub_year").alias("last_year"))


def missing_ids(wanted: DataFrame, stored: DataFrame, key: str = "pmid") -> DataFrame:
    """Wanted ids that the store lacks."""
    return wanted.select(key).distinct().join(stored.select(key), key, "left_anti")
