"""Incremental ingestion: new measurement files are read once, aggregated exactly, and late layers correct a sample's statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import features as A


def measurement_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of long measurement rows from Parquet files that appear below `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def statistics_stream(stream: DataFrame) -> DataFrame:
    """The ten exact statistics as a streaming aggregation (complete or update mode)."""
    return A.ten_statistics(stream)


def ingest_available(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append all files not seen before to `target` and stop: the checkpoint makes it exactly once."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
