"""Exact dedup by content sort (DataFrame operations only).

1. *Splitters.* A sample of the normalised texts, ``PER_PARTITION`` to a
   shuffle partition and ``MAX_SPLITTERS`` at most, cuts all texts into ranges
   of their bytes. A splitter is shortened where its first characters tell it
   from the other sampled texts, since any string can cut.
2. *Ranges.* A binary search in the sorted splitters gives each text's range;
   ranges are dealt to partitions and sorted there, so that equal texts are
   neighbours, and neighbours are compared in full.
3. *Texts with many copies* are sampled more than once, in proportion. Such a
   splitter is kept whole, and rows whose whole text equals it are dealt by
   their place in the input over as many ranges. What the neighbours of each
   range give (count and smallest id) is then merged over those ranges.

The smallest id of equal texts stays. Each text is read once to be sampled and
once to be sorted. Splitters travel as a constant of the plan.

Defined cases: a null text counts as empty; empty texts equal each other; very
long texts are compared whole; repeated rows (same id and text) are members of
one group of which one row stays; a null id never stays while its group has an
id; an empty table gives no rows. Other columns of the input, whatever their
names, are ignored.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table

#: Sampled texts to a shuffle partition, and the most splitters.
PER_PARTITION, MAX_SPLITTERS = 16, 50_000
#: Lengths at which a splitter ends if no other sampled text begins so, and at the latest if it was sampled once.
CUTS, LAST = (64, 1024), 16_384
#: Seed of the sample.
SEED = 9

SPACE = r"[\x20\x09-\x0D]+"


def normalise(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACE, " ")


def splitters(docs: DataFrame, text_col: str, most: int) -> list[tuple[str, int, int]]:
    """(text, upto, times) in the order of the texts' bytes: the number of sampled texts up to this one, and how often it was sampled."""
    n = docs.count()
    sampled = docs.sample(min(1.0, most / n), SEED) if n > most else docs
    texts = sampled.select(normalise(docs[text_col]).alias("norm")).groupBy("norm").agg(F.count(F.lit(1)).alias("times"))
    for k in CUTS:  # how many sampled texts begin alike
        texts = texts.withColumn(f"like{k}", F.count(F.lit(1)).over(Window.partitionBy(F.substring("norm", 1, k))))
    short = F.when(F.col("times") > 1, F.col("norm"))
    for k in CUTS:
        short = short.when(F.col(f"like{k}") == 1, F.substring("norm", 1, k))
    cuts = texts.select(short.otherwise(F.substring("norm", 1, LAST)).alias("text"), "times").groupBy("text").agg(F.max("times").alias("times"))
    found = sorted(cuts.collect(), key=lambda r: r["text"].encode())  # about `most` rows at most
    upto = itertools.accumulate(r["times"] for r in found)
    return [(r["text"], k, r["times"]) for r, k in zip(found, upto)]


def literal(values: list, kind: str) -> Column:
    """An array that the optimiser folds to a constant, which travels with the tasks."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_partition: int = PER_PARTITION) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    n = shuffle_partitions(docs.sparkSession)
    cuts = splitters(docs, text_col, min(MAX_SPLITTERS, n * per_partition))
    texts, upto, times = literal([c[0] for c in cuts], "string"), literal([c[1] for c in cuts], "bigint"), literal([c[2] for c in cuts], "bigint")
    rows = docs.select(docs[id_col].alias("doc_id"), normalise(docs[text_col]).alias("norm"), F.monotonically_increasing_id().alias("place"))
    # number of splitters at or below the text, by binary search
    steps = [1 << k for k in reversed(range(max(1, len(cuts).bit_length())))]
    below = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(texts, at + step - 1) <= F.col("norm")), at + step).otherwise(at))
    rows = rows.withColumn("at", below)
    last = F.col("at") - 1
    hot = F.when((F.get(times, last) > 1) & (F.get(texts, last) == F.col("norm")), F.get(times, last))
    part = F.coalesce(F.get(upto, last), F.lit(0)) - F.coalesce(F.pmod(F.xxhash64("place"), hot), F.lit(0))
    slot = F.floor(part * n / (cuts[-1][1] + 1 if cuts else 1)).cast("int")  # as many ranges to each partition
    rows = rows.select("doc_id", "norm", slot.alias("part"), F.when(hot.isNotNull(), F.col("at")).alias("hot"))
    equal = Window.partitionBy("part", "norm").orderBy(F.asc_nulls_last("doc_id"))
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = rows.repartitionById(n, F.col("part")).select(
        "doc_id", "part", "hot", F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"),
        F.row_number().over(equal).alias("nth"), F.first("doc_id").over(whole).alias("low"), F.count(F.lit(1)).over(whole).alias("n"))
    found = materialise(found, "exact-groups")
    # of a text dealt over several partitions: all its rows, its smallest id, and the first partition that has it; a row for each such text
    first = F.min(F.struct(F.col("low").isNull(), "low", "part"))
    over = found.filter(F.col("hot").isNotNull() & (F.col("nth") == 1)).groupBy("hot").agg(F.sum("n").alias("all_n"), first.alias("of"))
    over = over.select(F.col("hot").alias("key"), "all_n", F.col("of.low").alias("all_low"), F.col("of.part").alias("of_part"))
    merged = found.join(F.broadcast(over), found["hot"] == over["key"], "left")
    return merged.select(
        "doc_id", F.when(F.col("key").isNull(), F.col("low")).otherwise(F.col("all_low")).alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        ((F.col("nth") == 1) & (F.col("key").isNull() | (F.col("part") == F.col("of_part")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) AS nth
  FROM n
)
SELECT doc_id, keep_id, group_size, (nth = 1) AS kept, sha256(norm) AS text_sha256 FROM w
"""
