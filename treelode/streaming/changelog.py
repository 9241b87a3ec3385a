"""Continuous queries over the version log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.schema import VERSIONS
from treelode.session import Budget


def read_log(spark: SparkSession, log_dir: str, max_files: int = Budget().batch_max_files, schema: str = VERSIONS) -> DataFrame:
    """Versions as they are appended; ``max_files`` bounds one micro-batch, nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(log_dir)


def latest_changes(log: DataFrame, since: int = 0) -> DataFrame:
    """Latest change per path after ``since``, kept up to date (update or complete mode).

    State is one row per path; ordering is by sequence number, never by event time, so no
    watermark is needed and a late file cannot overwrite a newer version.
    """
    recent = log.filter(F.col("seq") > since)
    newest = F.max(F.struct("seq", "op", "timestamp_ms")).alias("v")
    return recent.groupBy("path").agg(newest).select("path", "v.op", "v.seq", "v.timestamp_ms")
