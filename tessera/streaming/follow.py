"""Following a change log that grows: each micro-batch of records updates the rows of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.changelog import SCHEMA


def follow(spark: SparkSession, log_path: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call ``apply`` with each batch of new records (JSON lines) and its number; it may be called again after a failure."""
    records = spark.readStream.schema(SCHEMA).json(log_path)
    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
