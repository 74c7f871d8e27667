"""Resumable ingest: new files of extractions appended once, in one bounded run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_new_files(spark: SparkSession, source: str, target: str, schema: StructType, checkpoint: str, keys: list[str]) -> None:
    """Append rows of files in ``source`` that no earlier run has taken, of each key in a batch once and none that ``target`` has.

    Files already taken are remembered in ``checkpoint``, so a stopped run goes on where it was.
    """
    from ..operators.store import insert_ignore, open_table

    def put(batch: DataFrame, _: int) -> None:
        insert_ignore(open_table(spark, target, schema), batch, keys).write.mode("append").parquet(target)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
