"""Chunks of documents, and packed exchanges between chunks and shards of keys.

A *chunk* is one row of a table in the shared folder: some whole documents
packed together, so that numpy works on long arrays and the texts themselves
are never shuffled. In an *exchange* every chunk sends each *shard* (a range of
a hash) one packed blob of keys; the shard answers each chunk with one blob,
and the answers are written by chunk into the shared folder, where later passes
over the chunk table look up their own. Only packed keys and answers move.

With over ``FAN`` shards, every chunk would send as many tiny blobs, and get as
many back. Then blobs travel in two steps, over groups of about the root of
that many shards: a chunk sends a group one blob, tasks that hold a group's
blobs of some chunks deal them to the group's shards, and the answers come back
over groups of chunks in the same way. So blobs keep their size while their
number grows with the input to the power of 1.5, not 2.

Chunk rows are durable, so a retried task or a lost executor sees the same
chunks. The shared folder is opened from Python through ``pyarrow.fs``, which
takes local and mounted folders as well as the usual object stores' URIs.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_dir

#: Bytes of text to a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 6_000_000
#: The answers are dealt to files sorted by chunk, of about so many chunks each but to SLOTS files at least.
PER_SLOT, SLOTS = 16, 24
STORE = "chunk long, size long, payload binary"
#: Parquet looks at sizes after 100 rows only, and would keep all chunks of a task in one page.
CHUNK_TO_GROUP = {"parquet.block.row.count.limit": "1"}
#: The most shards that chunks send to, and hear from, directly.
FAN = 1000


def dump(x) -> bytes:
    return pickle.dumps(x, protocol=5)


load = pickle.loads


def chunk_store(docs: DataFrame, id_col: str, text_col: str, pack: Callable, label: str, target: int = CHUNK_BYTES, *, by_file: bool = False) -> DataFrame:
    """Table of chunks; ``pack(doc_ids, texts)`` gives (size, object) of one.

    With ``by_file``, each chunk is a row group of its own, and the table has
    the names of the files in place of the payloads: Python workers open them
    themselves, so that the JVM holds no chunk when they are read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        part = TaskContext.get().partitionId()
        ids, texts, held, n = [], [], 0, 0

        def chunk():
            size, packed = pack(ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([part * 1_000_003 + n], pa.int64()), pa.array([size], pa.int64()), pa.array([dump(packed)], pa.binary())], ["chunk", "size", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if ids and held + len(text) > target:
                    yield chunk()
                    ids, texts, held, n = [], [], 0, n + 1
                ids.append(doc)
                texts.append(text)
                held += len(text)
        if ids:
            yield chunk()

    if not by_file:
        return materialise(rows.mapInArrow(run, STORE), label, "zstd")
    table = materialise(rows.mapInArrow(run, STORE), label, "zstd", options=CHUNK_TO_GROUP)
    store = table.select("chunk", "size", F.col("_metadata.file_name").alias("file"))
    store.lumen_path = table.lumen_path
    return store


def over_chunks(store: DataFrame, work: Callable[[int, object], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(chunk, object)`` of every chunk."""
    if "file" in store.columns:
        path = store.lumen_path

        def opened(batches):
            import pyarrow.fs as fs

            files, root = fs.FileSystem.from_uri(path)
            for batch in batches:
                for chunk, name in zip(batch.column("chunk").to_pylist(), batch.column("file").to_pylist()):
                    for payload in _of_chunk(files, f"{root}/{name}", chunk, "payload"):
                        yield from work(chunk, load(payload))

        return store.select("chunk", "file").mapInArrow(opened, schema)

    def run(batches):
        for batch in batches:
            chunks, payloads = batch.column("chunk").to_pylist(), batch.column("payload")
            for k, chunk in enumerate(chunks):
                yield from work(chunk, load(payloads[k].as_py()))

    return store.select("chunk", "payload").mapInArrow(run, schema)


ROUTED = "to long, source long, blob binary"


def _routed(to: list[int], source: list[int], blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(source, pa.int64()), pa.array([dump(x) for x in blobs], pa.binary())], ["to", "source", "blob"])


def _opened(group: pa.Table) -> list:
    """The items of a group's blobs (lists), in the order of their sources."""
    order = np.argsort(group.column("source").to_numpy(), kind="stable").tolist()
    return [x for k in order for x in load(group.column("blob")[k].as_py())]


def _dealt(rows: DataFrame, sources: int, groups: int) -> DataFrame:
    """Second step of a route: items (final address, source, content) that share a group and a few sources go on as one blob to each address."""

    def deal(group: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for to, source, x in _opened(group):
            by.setdefault(to, []).append((source, x))
        some = group.column("source").to_numpy().min() if len(group) else 0
        return pa.Table.from_batches([_routed([*by], [int(some)] * len(by), [*by.values()])])

    bucket = F.pmod(F.xxhash64("source"), F.lit(max(1, -(-sources // groups))))
    return rows.withColumn("bucket", bucket).groupBy("to", "bucket").applyInArrow(deal, ROUTED)


def exchange(store: DataFrame, ask: Callable[[int, object], Iterator[tuple[int, object]]], answer: Callable[[list[tuple[int, object]]], list[tuple[int, object]]], label: str, shards: int, tasks: int | None = None) -> str:
    """Ask the shards and write their answers by chunk; the path is returned.

    ``ask(chunk, object)`` gives (shard, question)s, shards numbered below
    ``shards``; ``answer`` takes the (chunk, question)s of one shard and gives
    (chunk, answer)s, where chunk -1 is for what concerns all. With ``tasks``,
    that many tasks answer, whatever the size of the questions: for answers
    that take long for their bytes.
    """
    spark, chunks = store.sparkSession, store.count()
    slots = max(SLOTS, chunks // PER_SLOT)
    wide, groups, slot_groups = shards > FAN, math.isqrt(shards) + 1, math.isqrt(slots) + 1

    def grouped(items: list, of: Callable[[int], int]) -> dict[int, list]:
        """(address, content)s by the group of their address."""
        by: dict[int, list] = {}
        for to, x in items:
            by.setdefault(of(to), []).append((to, x))
        return by

    def asked(chunk, packed):
        if not wide:
            for shard, question in ask(chunk, packed):
                yield _routed([shard], [chunk], [[(chunk, question)]])
            return
        for group, own in grouped(ask(chunk, packed), lambda shard: shard * groups // shards).items():
            yield _routed([group], [chunk], [[(shard, chunk, question) for shard, question in own]])

    def answered(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        found = answer(sorted(_opened(group), key=lambda x: x[0]))
        if not wide:
            return pa.Table.from_batches([_routed([c for c, _ in found], [shard] * len(found), [[(shard, x)] for _, x in found])])
        by = grouped(found, lambda chunk: chunk % slots * slot_groups // slots if chunk >= 0 else -1)
        return pa.Table.from_batches([_routed([*by], [shard] * len(by), [[(chunk, shard, x) for chunk, x in own] for own in by.values()])])

    questions = over_chunks(store, asked, ROUTED)
    if wide:
        questions = _dealt(questions, chunks, groups)
    if tasks:
        questions = questions.withColumn("to", F.col("to").cast("int")).repartitionById(tasks, F.col("to"))  # a hash would put some shards together
    answers = questions.groupBy("to").applyInArrow(answered, ROUTED)
    if wide:
        answers = _dealt(answers, shards, slot_groups)
    path = f"{scratch_dir(spark)}/lumen-{label}-{uuid.uuid4().hex}-{slots}"
    rows = answers.select(F.col("to").alias("chunk"), "blob").withColumn("slot", F.pmod(F.col("chunk"), F.lit(slots))).repartition("slot").sortWithinPartitions("slot", "chunk")
    rows.write.option("compression", "zstd").option("parquet.block.size", str(1 << 18)).partitionBy("slot").parquet(path)
    return path


def _of_chunk(files, path: str, chunk: int, column: str) -> list[bytes]:
    """A chunk's values in a file: only the row groups that hold the chunk are read."""
    import pyarrow.parquet as pq

    found = []
    with files.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        at = file.schema_arrow.get_field_index("chunk")
        for k in range(file.num_row_groups):
            span = file.metadata.row_group(k).column(at).statistics
            if span is None or not span.has_min_max or span.min <= chunk <= span.max:
                t = file.read_row_group(k, columns=["chunk", column])
                found += t.filter(pc.equal(t.column("chunk"), chunk)).column(column).to_pylist()
    return found


def answers_of(path: str, chunk: int) -> list:
    """(shard, answer)s of a chunk, by shard."""
    import pyarrow.fs as fs

    store, root = fs.FileSystem.from_uri(path)
    found, slots = [], int(path.rpartition("-")[2])
    for info in store.get_file_info(fs.FileSelector(f"{root}/slot={chunk % slots}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            found += [x for blob in _of_chunk(store, info.path, chunk, "blob") for x in load(blob)]
    return sorted(found, key=lambda x: x[0])


def summed(spark: SparkSession, path: str, size: int) -> list[float]:
    """Sums of the ``size`` numbers that each shard of an exchange says of all."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/slot=*"))
    if not len(there):  # nothing was asked
        return [0.0] * size

    def opened(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([list(x) for blob in batch.column("blob").to_pylist() for _, x in load(blob)], pa.list_(pa.float64()))], ["x"])

    said = spark.read.parquet(path).filter("chunk = -1").select("blob").mapInArrow(opened, "x array<double>")
    return list(said.agg(*[F.coalesce(F.sum(F.col("x")[k]), F.lit(0.0)).alias(f"x{k}") for k in range(size)]).first())


def shards_for(store: DataFrame, per_shard: int) -> int:
    """A power of two: shards of about ``per_shard`` units of the chunks' sizes."""
    total = store.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return 1 << max(0, int(np.ceil(np.log2(max(1, total) / per_shard))))


def to_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, by its highest bits."""
    bits = shards.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
