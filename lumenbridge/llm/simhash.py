"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

The 64 bits are split into four blocks of 16. Two fingerprints that differ in
at most two bits agree on at least two whole blocks, so each distinct
fingerprint is filed under its six pairs of blocks (keys of 32 bits), members
of a key are joined, and the Hamming distance is verified.

A key with more than ``PAIRS`` members (one large group of near copies) is not
joined pairwise. There, each member is filed under itself and under every
fingerprint one bit away outside the key: members that share such a neighbour
differ in at most two bits, and any two that do, share one. At most 33 members
meet at a neighbour, and linking them to the smallest of them keeps every
component, so the work stays linear in the size of the key's group.

Components are found on distinct fingerprints by alternating large-star and
small-star steps whose edge tables are written to the shared folder.

Defined cases: a null or empty text, or one of white space only, has the
fingerprint zero; texts of fewer than three words hash their whole sequence;
repeated rows share their fingerprint and component; a null id is never a
component's id unless all ids in it are null; very long texts are hashed whole,
a piece at a time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TO_LOWER, materialise, table

WORDS, SEED, DISTANCE = 3, 42, 2
#: The most members of a key that are compared pairwise.
PAIRS = 24
BLOCKS = 4
#: Hashes that are held at once.
PIECE = 100_000
#: Up to this many ids a list is broadcast; beyond, it is joined by shuffle.
BROADCAST_IDS = 200_000


def hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of the words, repeats included."""
    n = len(words)
    if n >= size:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
        n = n - size + 1
    else:
        shingles, n = ([b" ".join(words)], 1) if n else ((), 0)
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)


def fingerprint(text: bytes | None, size: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit integer."""
    h = hashes((text or b"").translate(TO_LOWER).split(), size)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), PIECE):
        part = h[i: i + PIECE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]) if len(h) else 0


def _fingerprints(batches):
    for batch in batches:
        found = [fingerprint(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {docs.schema[id_col].dataType.simpleString()}, text_hash long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a > b: links of distinct fingerprints that keep all components of 'at most two bits apart'."""
    width = 64 // BLOCKS
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]

    def block(k: int):
        return F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1))

    keys = [F.shiftleft(F.lit(t).cast("long"), 2 * width) + F.shiftleft(block(i), width) + block(j) for t, (i, j) in enumerate(pairs)]
    filed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    filed = materialise(filed.join(sizes, "key"), "simhash-blocks", few_files=True)
    few, many = filed.filter(F.col("n") <= PAIRS), filed.filter(F.col("n") > PAIRS)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    direct = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter((F.col("a") > F.col("b")) & near)
    # outside the key's two blocks a bit may differ
    inside = F.element_at(F.array(*[F.lit(_signed(((1 << width) - 1) << i * width | ((1 << width) - 1) << j * width)) for i, j in pairs]), (F.shiftright("key", 2 * width) + 1).cast("int"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)])
    around = many.select("key", "fp", F.explode(F.filter(flips, lambda m: m.bitwiseAND(inside) == 0)).alias("flip"))
    around = around.select("key", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"), "fp")
    met = around.groupBy("key", "hub").agg(F.collect_set("fp").alias("met")).filter(F.size("met") > 1)  # 33 at most
    starred = met.select(F.explode("met").alias("a"), F.array_min("met").alias("b")).filter((F.col("a") > F.col("b")) & near)
    return direct.select("a", "b").union(starred).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots themselves; a root is its component's smallest node."""
    edges = materialise(edges, "simhash-edges", few_files=True)
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = materialise(large, "simhash-large", few_files=True)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").filter("a > b").distinct(), "simhash-edges", few_files=True)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row; root is the component's smallest fingerprint."""
    rows = materialise(fingerprints(docs, id_col, text_col), "simhash-fps")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct", few_files=True)
    roots = materialise(components(links(fps.select("fp"))), "simhash-roots", few_files=True)
    own = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = own.groupBy("root").agg(F.min("low").alias("component_id"))
    known = own.join(lowest, "root").select("fp", "root", "component_id")
    return rows.join(known, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    return members(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, columns unchanged: of each component the one with its smallest id (of rows that share that id, the one of the smallest text hash)."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    by = dict(zip(docs.columns, names))
    return _drop_near_copies(docs.toDF(*names).withColumnsRenamed({by["doc_id"]: "doc_id", by["text"]: "text"})).toDF(*docs.columns)


def _drop_near_copies(docs: DataFrame) -> DataFrame:
    found = materialise(members(docs).select("doc_id", "text_hash", "root", "component_id"), "simhash-members", few_files=True)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ties = found.filter(first).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("low_hash")).filter("n > 1").select("root", "low_hash")
    tied = ties.limit(1).count() > 0
    if tied:
        found = found.join(ties, "root", "left")
        first &= F.col("text_hash") == F.coalesce("low_hash", "text_hash")
    gone = found.filter(~first).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
    if tied:  # rows that repeat an id and its text: one of them stays
        left = left.withColumn("_text_hash", F.xxhash64(left["text"])).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return left
