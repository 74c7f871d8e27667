"""Benchmark decontamination with an FM-index per training shard.

Each Arrow batch of documents is a shard. Its words are numbered by the
benchmark's vocabulary; a run of known words shorter than every window can't
hold one, so only the other runs are indexed, a separator between them. The
index is a suffix array (prefix doubling), its Burrows-Wheeler transform in a
wavelet matrix, and every ``STRIDE``-th suffix position. All windows of the
benchmark are searched backward at once; matching rows are walked to a sampled
position; hit words are merged into spans and mapped back to documents.

The benchmark is the smaller side: its windows are broadcast as arrays of word
numbers, up to ``MAX_BYTES`` of text at once (the driver holds some 25 times
that while it builds them); beyond, its items are searched in blocks of that
size and the blocks' spans are merged by shuffle.

Defined cases: null and empty texts have no words; items without words match
nothing; a null item id counts as the empty string; items that repeat an id
count once; repeated documents get equal results; a very long text is indexed
whole, in one index; an empty table gives no rows; other columns are ignored,
whatever their names; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

WINDOW, STRIDE = 10, 16
MAX_BYTES = 8_000_000
#: A-Z to a-z, 0-9, a-z and bytes over 7F unchanged, others to a space.
WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD).split()


class FMIndex:
    """Counts and places of phrases in a sequence of symbols 1.. (0 is the end mark).

    Kept are the wavelet matrix of the Burrows-Wheeler transform, and every ``STRIDE``-th position of the suffix array.
    """

    def __init__(self, seq: np.ndarray):
        text = np.append(seq, 0).astype(np.int64)
        self.n = n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        order, step = np.argsort(rank, kind="stable"), 1
        while rank[order[-1]] < n - 1 or len(np.unique(rank)) < n:
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            step *= 2
        bwt = text[order - 1].astype(np.int32)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 2))))
        self.sampled = order % STRIDE == 0
        self.before = np.cumsum(self.sampled, dtype=np.int32)  # sampled rows up to each, itself included
        self.places, self.levels = order[self.sampled], []
        for bit in reversed(range(max(1, int(text.max()).bit_length()))):
            ones = (bwt >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones, dtype=np.int32))), int(n - ones.sum())))
            bwt = np.concatenate((bwt[ones == 0], bwt[ones == 1]))

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        """The transform's symbol in each row, read from the wavelet matrix."""
        out, at = np.zeros(len(rows), dtype=np.int64), rows
        for bit, ones, zeros in self.levels:
            one = ones[at + 1] > ones[at]
            out |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        low, high = np.zeros_like(upto), upto
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of each phrase (one per line, of equal lengths)."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[live, k]
            ok = symbol < len(self.starts) - 1
            high[live[~ok]] = low[live[~ok]] = 0
            live, symbol = live[ok], symbol[ok]
            low[live] = self.starts[symbol] + self.rank(symbol, low[live])
            high[live] = self.starts[symbol] + self.rank(symbol, high[live])
            live = live[high[live] > low[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of the suffix in each row."""
        out, at, walked = np.full(len(rows), -1, dtype=np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.places[self.before[at[done]] - 1] + walked
            todo, at = todo[~done], at[~done]
            symbol = self.symbol(at)
            at, walked = self.starts[symbol] + self.rank(symbol, at), walked + 1
        return out


class Phrases:
    """The benchmark's windows as numbers: a vocabulary, and for each length the distinct windows with their items.

    Of ``lengths``, each has the windows (a row of word numbers each), the items' numbers, and where each window's items begin.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)], dtype=np.int32)
            size = min(window, len(words))
            if size:
                own = np.lib.stride_tricks.sliding_window_view(words, size)
                found.setdefault(size, []).append((own, np.full(len(own), number[item], dtype=np.int32)))
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted(found):
            windows, owners = (np.concatenate(x) for x in zip(*found[size]))
            order = np.lexsort((owners, *windows.T))
            windows, owners = windows[order], owners[order]
            new = np.append(True, (windows[1:] != windows[:-1]).any(axis=1))
            fresh = new | np.append(True, owners[1:] != owners[:-1])  # a window that an item repeats counts once
            self.lengths[size] = windows[new], owners[fresh], np.append(np.flatnonzero(new[fresh]), fresh.sum())
        self.least = min(self.lengths, default=0)

    @classmethod
    def of(cls, state: dict) -> Phrases:
        """From the plain attributes, which are what is broadcast."""
        found = cls.__new__(cls)
        found.__dict__.update(state)
        return found


def scan(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each text: number of words, merged hit spans (first word, last + 1), ids of occurring items."""
    number = phrases.vocabulary.get
    numbered, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        counts[i] = len(words)
        numbered.append(np.fromiter((number(w, 0) for w in words), dtype=np.int32, count=len(words)))
        numbered.append(np.zeros(1, dtype=np.int32))  # no window crosses documents
    starts = np.concatenate(([0], np.cumsum(counts + 1)))
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(int(c), [], []) for c in counts]
    if not phrases.least or not texts:
        return out
    ids = np.concatenate(numbered)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
    first, last = edge[::2], edge[1::2]
    long_ = last - first >= phrases.least
    first, last = first[long_], last[long_]
    if not len(first):
        return out
    # the indexed runs, a separator (symbol 1) after each; `origin` is each symbol's place in `ids`
    length = last - first + 1
    offset = np.cumsum(length) - length
    origin = np.arange(length.sum()) - np.repeat(offset - first, length)
    seq = ids[np.minimum(origin, len(ids) - 1)]
    seq[offset + length - 1] = 1
    index = FMIndex(seq)
    spans, found = [], []
    for size, (own, items, begins) in phrases.lengths.items():
        low, high = index.search(own)
        hit = np.flatnonzero(high > low)
        if len(hit):
            many = (high - low)[hit]
            which = np.repeat(hit, many)
            rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[hit], many)
            at = origin[index.locate(rows)]
            spans.append(np.stack((at, at + size), axis=1))
            found.append((np.searchsorted(starts, at, side="right") - 1, which, items, begins))
    if not spans:
        return out
    both = np.unique(np.concatenate(spans), axis=0)
    reach = np.maximum.accumulate(both[:, 1])
    new = np.concatenate(([True], both[1:, 0] > reach[:-1]))
    begin, end = both[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])
    doc = np.searchsorted(starts, begin, side="right") - 1
    for d, b, e in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist()):
        out[d][1].append((b, e))
    names: dict[int, set[int]] = {}
    for docs, which, items, begins in found:
        for d, p in np.unique(np.stack((docs, which), axis=1), axis=0).tolist():
            names.setdefault(d, set()).update(items[begins[p]: begins[p + 1]].tolist())
    for d, own in names.items():
        out[d][2].extend(sorted(phrases.items[k] for k in own))
    return out


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scanner(shared):
    def run(batches):
        phrases = Phrases.of(shared.value)
        for batch in batches:
            found = scan(batch.column("text").to_pylist(), phrases)
            at = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in at), pa.array([f[0] for f in found], pa.int64()),
                pa.array([[{"first": a, "last": b} for a, b in f[1]] for f in found], SPANS), pa.array([f[2] for f in found], pa.list_(pa.string())),
            ], [*(batch.schema.names[i] for i in at), "n_words", "spans", "items"])

    return run


def blocks_of(benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> list:
    """The benchmark's items as broadcast windows, in blocks of about ``max_bytes`` of text."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // max_bytes))
    out = []
    for k in range(n):
        own = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        out.append(spark.sparkContext.broadcast(Phrases([(r[0], None if r[1] is None else r[1].encode()) for r in own.collect()]).__dict__))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row; spans are merged word ranges to remove."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, spans array<struct<first: long, last: long>>, items array<string>"
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item_id"), benchmark["text"].alias("text"))
    blocks = blocks_of(items, max_bytes)
    if len(blocks) == 1:
        return rows.mapInArrow(_scanner(blocks[0]), schema)
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("sha"), "text")
    parts = [keyed.mapInArrow(_scanner(b), schema.replace(", n_words", ", sha string, n_words")) for b in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("doc_id", "sha", "n_words").agg(
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count(F.lit(1)) / len(blocks)).cast("int").alias("times"))
    begin = "aggregate(all, cast(array() as array<struct<first: bigint, last: bigint>>), (s, x) -> if(size(s) > 0 and x.first <= element_at(s, -1).last, concat(slice(s, 1, size(s) - 1), array(named_struct('first', element_at(s, -1).first, 'last', greatest(element_at(s, -1).last, x.last)))), concat(s, array(x))))"
    return merged.select("doc_id", "n_words", F.expr(begin).alias("spans"), "items", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_t")).drop("_t")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any hit, columns unchanged."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item_id"), benchmark["text"].alias("text"))
    for shared in blocks_of(items):
        docs = docs.mapInArrow(_dropper(shared), docs.schema)
    return docs


def _dropper(shared):
    def run(batches):
        phrases = Phrases.of(shared.value)
        for batch in batches:
            found = scan(batch.column("text").cast(pa.binary()).to_pylist(), phrases)
            yield batch.filter(pa.array([not f[1] for f in found], pa.bool_()))

    return run


OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least({WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0))
), q AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p))
), h AS (SELECT r, i, p.k, item_id FROM q JOIN p ON q.phrase = p.phrase AND q.k = p.k),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN t ON d.r = t.r
"""
