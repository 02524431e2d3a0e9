"""Intake of records as they arrive, into the same plans as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sluice.sources.schema import CANONICAL


def arriving_records(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Canonical JSONL files of a folder as a stream, a bounded number of them a batch."""
    return spark.readStream.schema(CANONICAL).option("maxFilesPerTrigger", max_files).json(folder)


def append(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to a table and stop; files are taken in once, whatever fails between."""
    return records.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(out)
