"""Closed discovery over term statistics, and the gate of known terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KnownTerm, Ranking
from ..functions import text as T


def df_filter(stats: DataFrame, total_papers: DataFrame, ranking: Ranking) -> DataFrame:
    """Terms neither too rare nor too common; ``total_papers`` is one row (total_papers), broadcast as a scalar."""
    with_total = stats.join(F.broadcast(total_papers.select("total_papers")))
    return with_total.filter(F.col("total_df").between(ranking.df_min, F.lit(ranking.df_max_ratio) * F.col("total_papers")))


def closed_discovery(stats: DataFrame, total_papers: DataFrame, ranking: Ranking) -> DataFrame:
    """Terms on both sides, scored by a_df * c_df / total_df and ranked: score, balance, name."""
    return _ranked(closed_scores(stats, total_papers, ranking))  # one row per term


def closed_scores(stats: DataFrame, total_papers: DataFrame, ranking: Ranking) -> DataFrame:
    rows = df_filter(stats, total_papers, ranking).filter("a_df > 0 AND c_df > 0")
    return rows.select("term", "a_df", "c_df", "total_df", (F.col("a_df") * F.col("c_df") / F.col("total_df")).alias("score"))


def _order():
    return F.desc("score"), F.desc(F.least("a_df", "c_df")), F.asc("term")


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*_order())))


def closed_topk(stats: DataFrame, total_papers: DataFrame, ranking: Ranking, top: int = 25) -> DataFrame:
    """The first ``top`` of them: each task keeps its own first ones, and only these are ranked."""
    return _ranked(closed_scores(stats, total_papers, ranking).orderBy(*_order()).limit(top))


def known_term_gate(candidates: DataFrame, known: tuple[KnownTerm, ...]) -> DataFrame:
    """(label, best_descriptor, best_rank) of every known term: its best-ranked hint, null if none is a candidate."""
    spark = candidates.sparkSession
    listed = spark.createDataFrame([(k.label, k.hint) for k in known], "label string, hint string")  # the study's own short list
    hints = listed.select("label", F.explode_outer(T.split_hints(F.col("hint"))).alias("hint"))
    found = candidates.select("term", "rank").join(F.broadcast(hints), F.col("hint") == F.col("term"), "right")
    return found.groupBy("label").agg(F.min_by("term", "rank").alias("best_descriptor"), F.min("rank").alias("best_rank"))


def gate_verdict(gate: DataFrame, ranking: Ranking) -> DataFrame:
    """(found, known, passed) of the gate."""
    n = F.count("best_rank")
    return gate.agg(n.alias("found"), F.count(F.lit(1)).alias("known"), (n >= ranking.gate_least).alias("passed"))
