"""Mixing sources to target weights by Poisson replication (DataFrame operations only).

Each source has a mean repetition rate ``target weight * all rows / its rows``.
A document's copies are the inverse of that Poisson distribution at a uniform
number hashed from the seed and its id, so a rerun or a retried task gives the
same copies. Copies are exploded in place and put in a global random order by
another hash. As that hash is uniform, its first digits tell the partition of
each copy: the global sort needs no sampling pass, and every text moves once.

Target weights default to ``rows ** alpha``, which lifts small sources and
lowers large ones. The table of the sources' distribution functions is
broadcast if it has at most ``BROADCAST_CELLS`` numbers (8 bytes each); beyond,
it is joined by shuffle, and AQE splits the partitions of a hot source.

Defined cases: a null source is a source of its own; null or empty texts are
replicated like others, very long ones whole; a null id counts as the MD5 of
its text; repeated rows with the same id get the same number of copies each,
and such copies have the same ``shuffle_key`` and stand side by side in any
order; a weight of zero, or a source that an explicit table leaves out, gives
no copies; an empty table gives no rows. Columns of the input are kept except
those named like the added ones, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

ALPHA, SEED = 0.5, 20
#: Numbers in the broadcast table of distribution functions: 16 MB.
BROADCAST_CELLS = 2_000_000
#: Of the shuffle key, so many hex digits choose the partition.
DIGITS = 8
ADDED = ("n_copies", "copy_no", "shuffle_key")


def rates(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, source_col: str = "source") -> DataFrame:
    """(mix_source, rate) of every source."""
    n = docs.groupBy(docs[source_col].alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        listed = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        n = n.join(listed, n.mix_source.eqNullSafe(listed.k), "left").select("mix_source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    all_n, all_w = n.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()  # two numbers
    rate = F.col("w") * all_n / (F.lit(all_w) * F.col("n")) if all_w else F.lit(0.0)
    return n.select("mix_source", rate.alias("rate"))


def poisson_cdf(rate: DataFrame) -> DataFrame:
    """(mix_source, cdf): the distribution function at 0, 1, ... up to where it is one in double precision."""
    k = rate.select("mix_source", "rate", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 25).cast("int"))).alias("k"))
    upto = Window.partitionBy("mix_source").orderBy("k")
    k = k.withColumn("log_k", F.sum(F.ln(F.greatest(F.col("k"), F.lit(1)))).over(upto))
    k = k.withColumn("cdf", F.sum(F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_k"))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))).over(upto))
    return k.groupBy("mix_source").agg(F.array_sort(F.collect_list("cdf")).alias("cdf"))


def uniform(*parts):
    """A number in [0, 1) from 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cells(rate: DataFrame) -> int:
    """Numbers in the distribution functions of all sources."""
    return rate.agg(F.coalesce(F.sum(F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 26)), F.lit(0))).first()[0]


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The input's columns, each row as often as drawn, plus ``n_copies``, ``copy_no`` and ``shuffle_key``, in global random order."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    rate = rates(docs, weights, alpha, source_col)
    cdf = poisson_cdf(rate)
    names, own = docs.columns, docs[id_col].cast("string")
    if text_col in names:
        own = F.coalesce(own, F.md5(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    docs = docs.withColumn("_own", F.coalesce(own, F.lit("")))
    joined = docs.join(F.broadcast(cdf) if cells(rate) <= BROADCAST_CELLS else cdf, docs[source_col].eqNullSafe(cdf.mix_source))
    drawn = F.size(F.filter("cdf", lambda c: c <= F.col("_u")))
    rows = joined.withColumn("_u", uniform(F.lit(str(seed)), F.col("_own"))).withColumn("n_copies", drawn)
    rows = rows.filter(F.col("n_copies") > 0).select(*names, "_own", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.col("_own"), "copy_no"))).drop("_own")
    n = shuffle_partitions(docs.sparkSession)
    part = F.conv(F.substring("shuffle_key", 1, DIGITS), 16, 10).cast("long") * n / (1 << 4 * DIGITS)
    return rows.repartitionById(n, F.floor(part).cast("int")).sortWithinPartitions("shuffle_key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs)


OP7_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS all_n, sum(pow(n::DOUBLE, {ALPHA})) AS all_w FROM n),
r AS (SELECT source, pow(n::DOUBLE, {ALPHA}) * all_n / (all_w * n) AS rate FROM n, t),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 25)::INT + 1)) AS k FROM r),
l AS (SELECT *, sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k) AS log_k FROM k),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - log_k)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM l),
a AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (
  SELECT d.*, len(list_filter(a.cdf, lambda x: x <= ('0x' || substr(md5('{SEED}:' || own), 1, 13))::BIGINT / {float(1 << 52)})) AS n_copies
  FROM (SELECT *, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS own FROM documents) d JOIN a ON d.source IS NOT DISTINCT FROM a.source
), e AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM d)
SELECT doc_id, text, lang, source, n_chars, n_copies::INT AS n_copies, copy_no::INT AS copy_no,
       md5('{SEED}-order:' || own || ':' || copy_no) AS shuffle_key
FROM e
"""
