"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: ASCII letters, the only ones the contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same as a table for ``bytes.translate``.
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only where none is set and the master is local, as in tests."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(spark, "_lumen_scratch", None)
        if path is None:
            path = tempfile.mkdtemp(prefix="lumen-scratch-")
            spark._lumen_scratch = path
    return path.rstrip("/")


def materialise(df: DataFrame, label: str, compression: str = "snappy", few_files: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage and survives lost executors: the table is durable, and
    the committed files are the only copy that later stages read.
    ``few_files`` is for tables of short rows: a file for every shuffle
    partition would be tiny, so each of twice as many tasks as there are cores
    writes the partitions it takes, one after another, into one file.
    """
    spark = df.sparkSession
    if few_files:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{scratch_dir(spark)}/lumen-{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lumen_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        discard_path(df.sparkSession, df.lumen_path)


def discard_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch: bounds what a Python worker and its JVM side hold at once, besides one row.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session leaves their size at Spark's default of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") in (str(64 << 20), "64m"):
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
