"""Write semantics of the store: upsert, insert-ignore, append, atomic replacement, run log."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas


def upsert_latest(stored: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """All rows, of each key the last in ``order`` (descending columns that settle ties)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return stored.unionByName(batch).withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def insert_ignore(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``batch`` whose key is new, once each."""
    return batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def lookup(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted key once, with the stored row's other columns and ``found``; a join in place of lookups one by one."""
    rows = stored.withColumn("found", F.lit(True))
    return wanted.select(key).distinct().join(rows, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _fs(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def open_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, empty if it isn't there yet; a replacement that is complete but not yet in place is read instead."""
    fs, make = _fs(spark, path)
    for place in (f"{path}.next", path):
        if fs.exists(make(place)):
            return spark.read.schema(schema).parquet(place)
    return spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    settle(df.sparkSession, path)
    df.write.mode("append").parquet(path)


def settle(spark: SparkSession, path: str) -> None:
    """Put a complete replacement in its place; a crash before the end leaves it to be found by readers and the next writer."""
    fs, make = _fs(spark, path)
    if fs.exists(make(f"{path}.next")):
        fs.delete(make(path), True)
        if not fs.rename(make(f"{path}.next"), make(path)):
            raise OSError(f"{path} couldn't be replaced")


def replace(df: DataFrame, path: str) -> None:
    """Write beside ``path``, then swap. One rename, to ``path``.next, commits: ``open_table`` finds the old table before it and the new one after it, never none."""
    spark, new = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    settle(spark, path)  # what an earlier run has left
    fs, make = _fs(spark, path)
    if not fs.rename(make(new), make(f"{path}.next")):
        raise OSError(f"{path} couldn't be replaced")
    settle(spark, path)


def upsert(spark: SparkSession, path: str, batch: DataFrame, schema: StructType, keys: list[str], order: list) -> None:
    replace(upsert_latest(open_table(spark, path, schema), batch, keys, order), path)


def log_run(spark: SparkSession, path: str, config: dict, split: str, max_date: str, code_version: str = "") -> str:
    """Append one row to the run log; its id is returned."""
    run = uuid.uuid4().hex
    row = (run, datetime.now(timezone.utc).replace(tzinfo=None), code_version, json.dumps(config, sort_keys=True), split, max_date)
    append(spark.createDataFrame([row], schemas.RUNS), path)
    return run


def test_was_run(spark: SparkSession, path: str, split: str = "test") -> bool:
    """Whether the log has a run on ``split`` already: a TEST split is to be used once."""
    return open_table(spark, path, schemas.RUNS).filter(F.col("split") == split).limit(1).count() > 0
