"""Extracted relations: sources, targets, progress, coverage and cost."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MissingExtractions, Prices
from ..functions import text as T


class RelationSource(Protocol):
    """Anything that gives (pmid, relations) for papers (pmid)."""

    def relations_for(self, papers: DataFrame) -> DataFrame: ...


class EntitySource(Protocol):
    """Anything that gives (pmid, term) for papers (pmid): which terms a paper has."""

    def terms_for(self, papers: DataFrame) -> DataFrame: ...


class RankingMetric(Protocol):
    """A score of a candidate as a Column, from its counts on both sides and the sides' sizes."""

    def __call__(self, a: Column, c: Column, n_a: Column, n_c: Column) -> Column: ...


class TableSource:
    """Relations from the stored extractions of one model."""

    def __init__(self, extractions: DataFrame, model: str):
        self.latest = latest_extractions(extractions, model)

    def relations_for(self, papers: DataFrame) -> DataFrame:
        relations, _ = T.parse_relations(F.col("payload"))
        return papers.select("pmid").join(self.latest, "pmid").select("pmid", relations.alias("relations"))

    def require(self) -> TableSource:
        if not self.latest.limit(1).count():
            raise MissingExtractions("the model has no extractions")
        return self


def latest_extractions(extractions: DataFrame, model: str) -> DataFrame:
    """One extraction per paper: the latest, then by prompt hash."""
    w = Window.partitionBy("pmid").orderBy(F.desc("created_at"), F.desc("prompt_hash"))
    return extractions.filter(F.col("model") == model).withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def targets(papers: DataFrame, corridor: DataFrame, max_year: int | None = None) -> DataFrame:
    """Papers of a corridor with an abstract, up to a year if given, by id."""
    rows = papers.filter(F.col("abstract").isNotNull() & (F.col("abstract") != ""))
    if max_year:
        rows = rows.filter(F.col("pub_year").isNotNull() & (F.col("pub_year") <= max_year))
    return rows.join(corridor.select("pmid"), "pmid", "left_semi").select("pmid").orderBy("pmid")


def pending(wanted: DataFrame, extractions: DataFrame, model: str, budget: int | None = None) -> DataFrame:
    """Targets without an extraction of the model, the first ``budget`` of them."""
    rows = wanted.join(extractions.filter(F.col("model") == model).select("pmid"), "pmid", "left_anti").orderBy("pmid")
    return rows.limit(budget) if budget is not None else rows


def progress(wanted: DataFrame, relations: DataFrame) -> DataFrame:
    """(targets, extracted, remaining, relations, papers_with_relations); ``relations`` has one row per extracted paper."""
    joined = wanted.select("pmid").join(relations.select("pmid", F.size("relations").alias("n")), "pmid", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("targets"), F.count("n").alias("extracted"), F.count_if(F.col("n").isNull()).alias("remaining"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("relations"), F.count_if(F.col("n") > 0).alias("papers_with_relations"))


def coverage(descriptor_support: DataFrame) -> DataFrame:
    """Totals of (pmid, term, grounded): pairs, supported pairs, papers, papers with support."""
    per = descriptor_support.groupBy("pmid").agg(F.count(F.lit(1)).alias("n"), F.count_if("grounded").alias("s"))
    n, s = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))
    return per.agg(n.alias("descriptors"), s.alias("supported"), F.count(F.lit(1)).alias("papers"), F.count_if(F.col("s") > 0).alias("papers_with_support"), F.round(F.coalesce(s / F.nullif(n, F.lit(0)), F.lit(0.0)), 9).alias("support_share"))


def known_term_coverage(support: DataFrame, hints: list[str]) -> DataFrame:
    """(term, seen, plain, synonym): papers with each known term, and those where it is supported without and with synonyms (``ground``)."""
    known = support.filter(F.col("term").isin(*hints))
    return known.groupBy("term").agg(F.count(F.lit(1)).alias("seen"), F.count_if("plain").alias("plain"), F.count_if("grounded").alias("synonym"))


def cost_estimate(sample: DataFrame, papers: int, prices: Prices) -> DataFrame:
    """Cost of ``papers`` extractions from a sample (ok, parse_ok, cached, n_relations, input_tokens, output_tokens).

    Means are over successful rows; 0 where there are none.
    """
    ok = F.col("ok")

    def mean(c: str):
        return F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))

    rows = sample.agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(ok & ~F.col("parse_ok")).alias("parse_failures"), F.count_if(ok & F.col("cached")).alias("cached"), F.count_if(ok & ~F.col("cached")).alias("fresh"),
        F.coalesce(F.sum(F.when(ok, F.col("n_relations"))), F.lit(0)).alias("relations"), F.count_if(ok & (F.col("n_relations") > 0)).alias("with_relations"), mean("input_tokens").alias("mean_in"), mean("output_tokens").alias("mean_out"))
    cost = (F.col("mean_in") * papers * prices.input_per_million + F.col("mean_out") * papers * prices.output_per_million) / 1e6
    return rows.select(
        "attempts", "successes", "parse_failures", "cached", "fresh", "relations", "with_relations", F.round("mean_in", 6).alias("mean_in"), F.round("mean_out", 6).alias("mean_out"),
        F.round(F.col("mean_in") * papers, 3).alias("total_in"), F.round(F.col("mean_out") * papers, 3).alias("total_out"), F.round(cost, 6).alias("cost"),
        F.lit(round(papers / prices.requests_per_day, 6) if prices.requests_per_day else None).cast("double").alias("days"), F.lit(round(papers / prices.requests_per_minute, 6) if prices.requests_per_minute else None).cast("double").alias("minutes"))
