"""Temporal hold-out: slices, scores, hits, thresholds, precision and recall, verdicts.

One conditional aggregate over the incidence gives the counts of every split.
Nothing after a cutoff enters a score; N* is read from DEV rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Ranking, Split
from .relations import RankingMetric


def _exploded(inc_agg: DataFrame, splits: tuple[Split, ...], names: tuple[str, ...]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(s.name).alias("split"), *[F.col(f"{n}_{s.name}").alias(n) for n in names]) for s in splits])
    return inc_agg.select("term", F.explode(rows).alias("r")).select("term", "r.*")


def slice_counts(inc: DataFrame, splits: tuple[Split, ...]) -> DataFrame:
    """(split, term, a_pre, c_pre, a_post, c_post, ga_pre, gc_pre) of every split and term."""
    aggs, yr = [], F.col("yr")
    for s in splits:
        pre, post = yr <= s.cutoff, yr.between(s.first, s.last)
        for name, cond in (("a_pre", F.col("in_a") & pre), ("c_pre", F.col("in_c") & pre), ("a_post", F.col("in_a") & post), ("c_post", F.col("in_c") & post), ("ga_pre", F.col("in_a") & pre & F.col("grounded")), ("gc_pre", F.col("in_c") & pre & F.col("grounded"))):
            aggs.append(F.count_if(cond).alias(f"{name}_{s.name}"))
    return _exploded(inc.groupBy("term").agg(*aggs), splits, ("a_pre", "c_pre", "a_post", "c_post", "ga_pre", "gc_pre"))


def with_sizes(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``counts`` with n_a and n_c of the split (a row per split)."""
    return counts.join(F.broadcast(sizes.select("split", "n_a", "n_c")), "split")


def closed_slices(counts: DataFrame, sizes: DataFrame, ranking: Ranking) -> DataFrame:
    """Candidates known on both sides before the cutoff, within the document-frequency bounds."""
    both = F.col("a_pre") + F.col("c_pre")
    return with_sizes(counts, sizes).filter("a_pre >= 1 AND c_pre >= 1").filter(both.between(ranking.df_min, F.lit(ranking.df_max_ratio) * (F.col("n_a") + F.col("n_c"))))


def open_slices(counts: DataFrame, sizes: DataFrame, ranking: Ranking) -> DataFrame:
    """Candidates known on exactly one side: (split, term, present, present_pre, absent_post, grounded_pre)."""
    on_a = F.col("a_pre") >= 1
    rows = with_sizes(counts, sizes).filter(on_a != (F.col("c_pre") >= 1)).select(
        "split", "term", F.when(on_a, "A").otherwise("C").alias("present"), F.when(on_a, F.col("a_pre")).otherwise(F.col("c_pre")).alias("present_pre"),
        F.when(on_a, F.col("c_post")).otherwise(F.col("a_post")).alias("absent_post"), F.when(on_a, F.col("ga_pre")).otherwise(F.col("gc_pre")).alias("grounded_pre"), "n_a", "n_c",
    )
    return rows.filter(F.col("present_pre").between(ranking.df_min, F.lit(ranking.df_max_ratio) * (F.col("n_a") + F.col("n_c"))))


def pmi(a: Column, c: Column, n_a: Column, n_c: Column) -> Column:
    """Sum over both sides of ln(share on the side / base share); 0 where a size or the base is 0.

    Rounded to nine digits: equal values come out in several last digits, and
    ranks must not depend on them.
    """
    base = (a + c) / F.nullif(n_a + n_c, F.lit(0))

    def side(x: Column, n: Column) -> Column:
        return F.when(x > 0, F.ln((x / F.nullif(n, F.lit(0))) / base)).otherwise(F.lit(0.0))

    return F.when((n_a > 0) & (n_c > 0) & (a + c > 0), F.round(side(a, n_a) + side(c, n_c), 9)).otherwise(F.lit(0.0))


def scored(slices: DataFrame, grounded: bool = True, metric: RankingMetric = pmi) -> DataFrame:
    """(split, method, term, score, hit_count) of closed candidates by every scored method; ``metric`` takes the place of PMI."""
    a, c, n_a, n_c = (F.col(x) for x in ("a_pre", "c_pre", "n_a", "n_c"))
    methods = [("pmi", metric(a, c, n_a, n_c)), ("frequency", (a + c).cast("double"))]
    if grounded:
        methods.insert(0, ("grounded", metric(F.col("ga_pre"), F.col("gc_pre"), n_a, n_c)))
    return _by_method(slices.withColumn("hit_count", F.least("a_post", "c_post")), methods)


def open_scored(slices: DataFrame) -> DataFrame:
    """The same of open candidates."""
    return _by_method(slices.withColumn("hit_count", F.col("absent_post")), [("grounded", F.col("grounded_pre").cast("double")), ("frequency", F.col("present_pre").cast("double"))])


def _by_method(slices: DataFrame, methods: list[tuple[str, Column]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("method"), s.alias("score")) for m, s in methods], F.struct(F.lit("random").alias("method"), F.lit(None).cast("double").alias("score")))
    return slices.select("split", "term", "hit_count", F.explode(rows).alias("m")).select("split", "m.method", "term", "m.score", "hit_count")


def ranked(scores: DataFrame, seed: int) -> DataFrame:
    """``scores`` with ``rank`` per split and method: by score, then name; the random method by a hash of seed and name."""
    shuffled = F.when(F.col("method") == "random", F.md5(F.concat(F.lit(f"{seed}:"), "term"))).otherwise("")
    order = Window.partitionBy("split", "method").orderBy(F.desc_nulls_last("score"), shuffled, "term")  # one row per candidate
    return scores.withColumn("rank", F.row_number().over(order))


def hit_sweep(slices: DataFrame, hit_count: Column, splits: tuple[Split, ...], ranking: Ranking) -> DataFrame:
    """(split, n, candidates, hits, rate) for every threshold; rate 0 without candidates."""
    aggs = [F.count_if(hit_count >= n).alias(f"h{n}") for n in ranking.sweep]
    per = slices.groupBy("split").agg(F.count(F.lit(1)).alias("candidates"), *aggs)
    names = slices.sparkSession.createDataFrame([(s.name,) for s in splits], "split string")
    per = names.join(per, "split", "left").fillna(0)
    rows = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"h{n}").alias("hits")) for n in ranking.sweep])
    per = per.select("split", "candidates", F.explode(rows).alias("r")).select("split", "r.n", "candidates", "r.hits")
    return per.withColumn("rate", F.when(F.col("candidates") > 0, F.round(F.col("hits") / F.nullif(F.col("candidates"), F.lit(0)), 9)).otherwise(0.0))


def threshold(sweep: DataFrame, ranking: Ranking, dev: str = "dev") -> DataFrame:
    """One row: the smallest N of DEV with enough hits and a low enough rate, else 1."""
    ok = (F.col("hits") >= ranking.least_hits) & (F.col("rate") <= ranking.most_rate)
    return sweep.filter(F.col("split") == dev).agg(F.coalesce(F.min(F.when(ok, F.col("n"))), F.lit(1)).alias("n_star"))


def labelled(ranks: DataFrame, n_star: DataFrame) -> DataFrame:
    """Ranks with ``hit`` at N* (one row, broadcast as a scalar)."""
    return ranks.join(F.broadcast(n_star)).withColumn("hit", F.col("hit_count") >= F.col("n_star"))


def precision_recall(labels: DataFrame, ranking: Ranking) -> DataFrame:
    """(split, method, k, n_star, precision, recall): precision divides by k, recall by the hits among candidates."""
    aggs = [F.count_if(F.col("hit") & (F.col("rank") <= k)).alias(f"k{k}") for k in ranking.top_k]
    per = labels.groupBy("split", "method").agg(F.max("n_star").alias("n_star"), F.count_if("hit").alias("all_hits"), *aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("top_hits")) for k in ranking.top_k])
    per = per.select("split", "method", "n_star", "all_hits", F.explode(rows).alias("r")).select("split", "method", "n_star", "all_hits", "r.*")
    return per.select(
        "split", "method", "k", "n_star", F.round(F.col("top_hits") / F.col("k"), 9).alias("precision"),
        F.when(F.col("all_hits") > 0, F.round(F.col("top_hits") / F.nullif(F.col("all_hits"), F.lit(0)), 9)).otherwise(0.0).alias("recall"),
    )


def false_positives(labels: DataFrame, first: int = 10) -> DataFrame:
    """(split, method, rank, term) of the first ranks that are no hits."""
    return labels.filter((F.col("rank") <= first) & ~F.col("hit")).select("split", "method", "rank", "term")


def verdict(metrics: DataFrame, ranking: Ranking, split: str = "test") -> DataFrame:
    """(model, model_p, frequency_p, random_p, passed) at the first k: above frequency and at least random."""
    p = metrics.filter((F.col("split") == split) & (F.col("k") == ranking.top_k[0]))

    def of(m: str) -> Column:
        return F.max(F.when(F.col("method") == m, F.col("precision")))

    rows = p.agg(of("grounded").alias("g"), of("pmi").alias("p"), of("frequency").alias("frequency_p"), of("random").alias("random_p"))
    rows = rows.select(F.when(F.col("g").isNotNull(), "grounded").otherwise("pmi").alias("model"), F.coalesce("g", "p").alias("model_p"), "frequency_p", "random_p")
    return rows.withColumn("passed", (F.col("model_p") > F.col("frequency_p")) & (F.col("model_p") >= F.col("random_p")))
