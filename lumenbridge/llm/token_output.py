"""Token ids as canonical, length-limited Huffman blocks.

Whole texts are encoded by a given tokenizer file of the ``tokenizers``
library. Where the file's steps are the usual ones (NFC, white space, lower
case, a pattern that finds the pieces, a byte-level model), a worker takes them
one by one: the file's own pattern finds the pieces of a whole text, and the
library's model encodes a piece once, as its ids go into a table of bounded
bytes. The pattern is used so for texts of Latin-1 characters only, and only if
every one of these characters, in several places, gives the library's own
result; other texts are cut at blanks and line ends, which no step crosses, and
their chunks are given to the library as they stand. With a file of any other
kind the library encodes whole texts.

File format (Parquet rows, so that any store Spark writes to will do, and a
retried or lost task never leaves half a file):

* ``codebook``: (id, length) of every id that occurs; codes are canonical, so
  lengths alone define them, and no code is over ``LIMIT`` bits (package-merge).
* ``blocks``: documents in order, many to a block. A block is independent:
  ``part`` and ``first_id``, the ids before it in its part, tell its place,
  ``payload`` holds the documents' codes, each document from a byte's start,
  ``doc_ids``, ``doc_tokens`` and ``doc_bytes`` describe them, and
  ``checkpoints`` give the bit offset of every ``EVERY``-th id of a document,
  from which decoding can start. All checkpoints of a batch are decoded side by
  side by table lookup.
* ``parts``: (part, base), the ids before each part.

The order is by doc_id: a bounded sample, weighted by ids, cuts the documents
into ranges of even numbers of ids, one part each. ``keep_order`` keeps the
order of the input instead, for input that is shuffled already: a part is then
what one task reads, and nothing is exchanged.

Defined cases: a null or empty text has the end id alone; rows that repeat an
id are all written, ordered by a hash of their ids, and may fall into several
parts; null doc_ids come last; very long texts are a block of their own; an
empty table writes no blocks; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import sys
import types
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, scratch_dir, table
from .exchange import mix64

END_ID, LIMIT, EVERY = 2, 20, 128
#: Ids to a block and to a part; the most parts; sampled rows to a part.
BLOCK_IDS, RANGE_IDS, MAX_RANGES, PER_RANGE = 200_000, 4_000_000, 20_000, 50
#: Bytes of a worker's table of pieces, and the longest piece in it.
TABLE_BYTES, LONGEST = 48 << 20, 200
#: Bytes of text that are encoded at once, but for one longer text.
AT_ONCE = 4 << 20
#: Up to this many parts (16 bytes each) their table is broadcast to readers; beyond, it is joined by shuffle.
BROADCAST_PARTS = 1_000_000
VOCABULARY = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Table(dict):
    """Text to the bytes of its ids. When full, entries not met since it was last full go."""

    def __init__(self, compute):
        self.compute, self.bytes, self.old = compute, 0, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)  # the blank, which has no ids, stays so too
        if found is None:
            ids = self.compute(text)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= LONGEST:
            self.bytes += len(text) + len(found) + 180  # of two objects and a slot
            if self.bytes > TABLE_BYTES:
                self.old, self.bytes = self.copy(), 0
                self.clear()
            self[text] = found
        return found


def _characters(kind: str) -> str:
    return "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind)


class Encoder:
    """A tokenizer file's ids of whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts, self.chunks = Table(self.of_piece), Table(self.of_text)
        self.pattern = self.own_pattern()

    def own_pattern(self) -> re.Pattern | None:
        """The file's pattern for pieces, its classes limited to Latin-1; None where pieces so found aren't the library's."""
        steps = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        found = [s["pattern"]["Regex"] for s in steps.get("pretokenizers", [steps]) if s and s.get("type") == "Split" and "Regex" in s["pattern"]]
        if len(found) != 1 or any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            return None
        classes = {r"\p{L}": _characters("L"), r"\p{N}": _characters("N"), r"\s": "\t-\r \x85\xa0"}
        try:
            self.pattern = re.compile(re.sub(r"\\p\{[LN]\}|\\s", lambda m: classes[m[0]], found[0]) + "| ")
            self.parts[" "] = b""
            probes = [x for c in map(chr, range(256)) for x in (c, f"a{c}b", f"1{c}{c}'{c}!{c}", f"It's{c}we'll '{c}", f" {c} ")]
            if self.of_latin(probes) != [struct.pack(f"<{len(ids)}I", *ids) for ids in map(self.of_text, probes)]:
                return None
        except (re.error, AttributeError, TypeError, KeyError):  # a pattern or model of another kind
            return None
        return self.pattern

    def of_text(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of_piece(self, piece: str) -> list[int]:
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join(map(BYTE_CHARS.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(piece)]

    def of_latin(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of Latin-1 characters without added tokens.

        The pattern runs over the distinct chunks between ASCII white space, which no piece crosses; a blank stands between two.
        """
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        chunks = lists.flatten().dictionary_encode()
        n = len(chunks.dictionary)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), chunks.dictionary), " ")[0].as_py()
        pieces = list(map(self.parts.__getitem__, self.pattern.findall(joined)))
        ids = np.frombuffer(b"".join(pieces), dtype="<u4")
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) >> 2
        ends = np.cumsum(sizes)
        bounds = np.concatenate(([0], ends[sizes == 0], [len(ids)]))  # only the blank between two chunks has no ids
        at = chunks.indices.to_numpy()
        size = np.diff(bounds)[at] if n else np.zeros(0, dtype=np.int64)
        upto = np.cumsum(size)
        place = np.repeat((bounds[at] - upto + size).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)
        out = ids[place].tobytes()
        cuts = (4 * np.concatenate(([0], upto))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        return [out[i:j] for i, j in zip(cuts, cuts[1:])]

    def is_latin(self, text: str) -> bool:
        """Whether all characters are of Latin-1, and no added token stands in the text."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not any(t in text for t in self.added)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of whole texts, each with the end id (little-endian, unsigned, 32 bits)."""
        whole = [(x or b"").decode("utf-8", "replace") for x in texts]
        if self.pattern is None:
            return [struct.pack(f"<{len(ids)}I", *ids) + END for ids in map(self.of_text, whole)]
        latin = [self.is_latin(x) for x in whole]
        found = self.of_latin([x if ok else "" for x, ok in zip(whole, latin)])
        for k, (x, ok) in enumerate(zip(whole, latin)):
            if not ok:
                chunks = x.replace("\n", " ").split(" ")
                narrow = [self.is_latin(c) for c in chunks]
                found[k] = b"".join([a if ok else self.chunks[c] for a, c, ok in zip(self.of_latin([c if ok else "" for c, ok in zip(chunks, narrow)]), chunks, narrow)])
        return [x + END for x in found]


END = np.array([END_ID], dtype="<u4").tobytes()
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; later tasks of the worker find it filled."""
    home = sys.modules.setdefault("_lumen_encoders", types.ModuleType("_lumen_encoders"))
    if not hasattr(home, "by_path"):
        home.by_path = {}
    if path not in home.by_path:
        home.by_path[path] = Encoder(path)
    return home.by_path[path]


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``AT_ONCE`` bytes of text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
    bounds = np.flatnonzero(np.diff(upto // AT_ONCE, prepend=0)).tolist()
    for i, j in zip([0, *bounds], [*bounds, batch.num_rows]):
        if j > i:
            yield batch.slice(i, j - i)


def _tokenise(path: str):
    """Each row's ids, a hash of them, a number of its own that spreads rows evenly, and, in a batch's first row, the batch's counts of ids."""

    def run(batches):
        encode = encoder(path).encode
        row = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in _cut(whole)):
            ids = encode(batch.column("text").to_pylist())
            wide = np.frombuffer(b"".join(ids), dtype="<u4")
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ties = np.fromiter(map(xxhash.xxh64_intdigest, ids), dtype=np.uint64, count=len(ids))
            narrow = wide.astype("<u2") if wide.max() < 1 << 16 else wide
            ends = np.cumsum(sizes) * narrow.itemsize
            blob, counts = narrow.tobytes(), np.bincount(wide)
            at = np.flatnonzero(counts)
            salts = mix64(np.arange(row, row + len(ids), dtype=np.uint64))
            row += len(ids)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes),
                pa.array([blob[e - s * narrow.itemsize: e] for s, e in zip(sizes.tolist(), ends.tolist())], pa.binary()),
                pa.array((ties >> np.uint64(1)).astype(np.int64)), pa.array((salts >> np.uint64(1)).astype(np.int64)),
                pa.array([at.astype("<i8").tobytes() + counts[at].astype("<i8").tobytes(), *[None] * (len(ids) - 1)], pa.binary()),
            ], ["doc_id", "n_tokens", "ids", "tie", "salt", "counts"])
            del ids, wide, narrow, blob
            pa.default_memory_pool().release_unused()  # the worker's memory stays that of one part

    return run


def _array(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4")


def _count(batches):
    seen = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for counts in batch.column("counts").to_pylist():
            at, n = np.frombuffer(counts, dtype="<i8").reshape(2, -1)
            if len(seen) <= at[-1]:
                seen = np.concatenate((seen, np.zeros(at[-1] + 1 - len(seen), dtype=np.int64)))
            seen[at] += n
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["id", "n"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of the code of each symbol (counts over zero) by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    leaves, items = [np.ones(n, dtype=bool)], weights
    for _ in range(limit - 1):
        packs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        items = np.concatenate((weights, packs))
        by = np.argsort(items, kind="stable")
        leaves.append(by < n)
        items = items[by]
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes from (ids, lengths)."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((ids, lengths))
        ids, lengths = np.asarray(ids)[by], np.asarray(lengths)[by]
        top = int(ids.max()) + 1 if len(ids) else 1
        self.codes, self.lengths = np.zeros(top, dtype=np.uint32), np.zeros(top, dtype=np.int64)
        spans = np.int64(1) << (LIMIT - lengths)
        begin = np.cumsum(spans) - spans
        self.codes[ids], self.lengths[ids] = begin >> (LIMIT - lengths), lengths
        self.symbol, self.length = np.zeros(1 << LIMIT, dtype=np.uint32), np.ones(1 << LIMIT, dtype=np.uint8)
        self.symbol[: spans.sum()], self.length[: spans.sum()] = np.repeat(ids, spans), np.repeat(lengths, spans)

    def encode(self, docs: list[np.ndarray]) -> tuple[list[bytes], list[np.ndarray]]:
        """Each document's bytes, and the bit offset of its every EVERY-th id."""
        ids = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, dtype=np.int64)
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        bits = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(bits)))
        last = np.cumsum(sizes)
        doc_bits = ends[last] - ends[last - sizes]
        doc_bytes = (doc_bits + 7) >> 3
        base = np.cumsum(doc_bytes) - doc_bytes
        begin = ends[:-1] + np.repeat(base * 8 - ends[last - sizes], sizes)
        word = self.codes[ids].astype(np.int64) << (32 - (begin & 7) - bits)
        at, total = begin >> 3, int(doc_bytes.sum()) + 4
        out = np.zeros(total)
        for k in range(4):
            out += np.bincount(at + k, weights=(word >> (24 - 8 * k)) & 255, minlength=total)
        blob = out.astype(np.uint8).tobytes()
        begin -= np.repeat(base * 8, sizes)
        marks = [begin[e - s: e: EVERY].astype("<u4") for s, e in zip(sizes.tolist(), last.tolist())]
        return [blob[b: b + n] for b, n in zip(base.tolist(), doc_bytes.tolist())], marks

    def decode(self, payload: bytes, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids from each checkpoint (bit offset) on, ``sizes`` of them (EVERY at most), in a row."""
        if not len(sizes):
            return np.zeros(0, dtype=np.uint32)
        raw = np.frombuffer(payload + bytes(EVERY * LIMIT // 8 + 8), dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, out = offsets.astype(np.int64), np.empty((int(sizes.max()), len(sizes)), dtype=np.uint32)
        for k in range(len(out)):
            peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
            out[k] = self.symbol[peek]
            at += self.length[peek]
        return out.T[np.arange(len(out)) < sizes[:, None]]


Key = tuple[bool, int, int, int]  # null id?, id, hash of the ids, salt


def cuts_of(tokens: DataFrame, n: int) -> list[Key]:
    """Keys that cut the documents, in order of doc_id, into ``n`` ranges of about as many ids each, from a sample of some ``PER_RANGE`` rows to a range."""
    if n <= 1:
        return []
    share = min(1.0, n * PER_RANGE / max(1, tokens.count()))
    rows = tokens.select("doc_id", "tie", "salt", "n_tokens").filter(F.pmod("salt", F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    null, ids, tie, salt = _keys(rows)
    order = np.lexsort((salt, tie, ids, null))
    upto = np.cumsum(rows.column("n_tokens").to_numpy()[order])
    if not len(upto):
        return []
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, n) / n))
    return [(bool(null[i]), int(ids[i]), int(tie[i]), int(salt[i])) for i in order[np.minimum(at, len(order) - 1)]]


def _keys(rows) -> tuple[np.ndarray, ...]:
    ids = rows.column("doc_id")
    return ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), rows.column("tie").to_numpy(), rows.column("salt").to_numpy()


def parts_of(rows, cuts: list[Key]) -> np.ndarray:
    """Number of the range of each row: of the cuts at or below its key."""
    null, ids, tie, salt = _keys(rows)
    known = np.array([c[1] for c in cuts if not c[0]], dtype=np.int64)
    low, high = np.searchsorted(known, ids, side="left"), np.searchsorted(known, ids, side="right")
    out = np.where(null, len(known), low)
    close = np.flatnonzero((low < high) & ~null | null & (len(known) < len(cuts)))  # rows that share their id with a cut
    for i in close.tolist():
        out[i] = bisect.bisect_right(cuts, (bool(null[i]), int(ids[i]), int(tie[i]), int(salt[i])))
    return out.astype(np.int32)


def _pack(shared):
    """Codes of single documents, and the part of each; without cuts, what a task reads is a part."""

    def run(batches):
        ids, lengths, cuts = shared.value
        book = Codebook(ids, lengths)
        for batch in batches:
            n = batch.column("n_tokens").to_pylist()
            size, docs, payloads, marks = 0, [], [], []
            for ids, k in zip(batch.column("ids").to_pylist(), n):
                docs.append(_array(ids, k))
                size += k
                if size > 2_000_000:
                    p, m = book.encode(docs)
                    payloads, marks, docs, size = payloads + p, marks + m, [], 0
            p, m = book.encode(docs)
            payloads, marks = payloads + p, marks + m
            part = np.full(len(n), TaskContext.get().partitionId(), dtype=np.int32) if cuts is None else parts_of(batch, cuts)
            yield pa.RecordBatch.from_arrays([
                pa.array(part), *(batch.column(c) for c in ("doc_id", "tie", "salt", "n_tokens")), pa.array(payloads, pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())], PACKED_NAMES)

    return run


PACKED = "part int, doc_id long, tie long, salt long, n_tokens long, payload binary, marks binary"
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]
BLOCKS = "part int, first_id long, n_tokens long, doc_ids binary, doc_null binary, doc_tokens binary, doc_bytes binary, payload binary, checkpoints binary"
_BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
_BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _write(batches):
    """Documents in order to blocks; ``first_id`` counts from the part's beginning."""
    held: list[tuple] = []
    part, first, size = None, 0, 0

    def block():
        sizes = np.array([h[1] for h in held], dtype="<i8")
        bytes_ = np.array([len(h[2]) for h in held], dtype="<i8")
        base = (np.cumsum(bytes_) - bytes_) * 8
        marks = np.concatenate([np.frombuffer(h[3], dtype="<u4").astype("<i8") + b for h, b in zip(held, base.tolist())])
        row = [part, first, int(sizes.sum()), np.array([h[0] or 0 for h in held], dtype="<i8").tobytes(), bytes(h[0] is None for h in held), sizes.tobytes(), bytes_.tobytes(), b"".join(h[2] for h in held), marks.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCK_TYPES)], _BLOCK_NAMES)

    for batch in batches:
        for p, doc, n, payload, marks in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "payload", "marks"))):
            if held and (p != part or size + n > BLOCK_IDS):
                yield block()
                first, held, size = first + size, [], 0
            if p != part:
                part, first = p, 0
            held.append((doc, n, payload, marks))
            size += n
    if held:
        yield block()


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, keep_order: bool = False) -> None:
    """Encode every row and write ``path``/codebook, ``path``/blocks and ``path``/parts."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    tokens = materialise(rows.mapInArrow(_tokenise(tokenizer or default_tokenizer()), "doc_id long, n_tokens long, ids binary, tie long, salt long, counts binary"), "token-ids", "zstd")
    counts = tokens.select("counts").filter(F.col("counts").isNotNull()).mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted((r[0], r[1]) for r in counts.collect())  # one row per id of the vocabulary
    ids, lengths = np.array([f[0] for f in found], dtype=np.int64), code_lengths(np.array([f[1] for f in found], dtype=np.int64))
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length long").coalesce(1).write.parquet(f"{path}/codebook")
    n = max(1, min(MAX_RANGES, -(-int(sum(f[1] for f in found)) // RANGE_IDS)))
    cuts = None if keep_order else cuts_of(tokens, n)
    pack, rows = _pack(spark.sparkContext.broadcast((ids, lengths, cuts))), tokens.drop("counts")
    if keep_order:
        blocks = rows.mapInArrow(lambda batches: _write(pack(batches)), BLOCKS)
    else:
        packed = rows.mapInArrow(pack, PACKED).repartitionById(n, F.col("part"))
        blocks = packed.sortWithinPartitions("part", F.asc_nulls_last("doc_id"), "tie", "salt").mapInArrow(_write, BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    discard(tokens)
    parts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row to a part
    parts.select("part", base.alias("base")).write.parquet(f"{path}/parts")


def _read(shared):
    def run(batches):
        book = Codebook(*shared.value)
        for batch in batches:
            doc_ids, starts, counts, extra = [], [], [], []
            for first, ids, null, tokens, payload, marks in zip(*(batch.column(c).to_pylist() for c in ("first_id", "doc_ids", "doc_null", "doc_tokens", "payload", "checkpoints"))):
                n = np.frombuffer(tokens, dtype="<i8")
                lanes = -(-n // EVERY)
                sizes = np.full(int(lanes.sum()), EVERY, dtype=np.int64)
                sizes[np.cumsum(lanes) - 1] = n - (lanes - 1) * EVERY
                got = book.decode(payload, np.frombuffer(marks, dtype="<i8"), sizes).astype("<u4")
                end = np.cumsum(n)
                doc_ids += [None if x else d for d, x in zip(np.frombuffer(ids, dtype="<i8").tolist(), null)]
                starts += (first + end - n).tolist()
                counts += n.tolist()
                extra += [zlib.crc32(got[e - k: e].tobytes()) for k, e in zip(n.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(extra, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files at ``path``."""
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").toArrow()
    shared = spark.sparkContext.broadcast((book.column("id").to_numpy(), book.column("length").to_numpy()))
    parts = spark.read.parquet(f"{path}/parts")
    few = parts.count() <= BROADCAST_PARTS
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(F.broadcast(parts) if few else parts, "part")
    return blocks.withColumn("first_id", F.col("first_id") + F.col("base")).mapInArrow(_read(shared), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, keep_order: bool = False) -> DataFrame:
    """Write ``docs`` in the file format (to the shared folder unless ``path`` is given), and read the digests back."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/lumen-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, keep_order=keep_order)
    return read_digests(spark, path)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
