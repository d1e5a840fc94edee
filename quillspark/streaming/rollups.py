"""Extensions of batch operators to streams: file-source ingest and watermarked monitoring roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_summary(metrics: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Requests, errors and mean time of each endpoint and window; rows later than `late` are dropped."""
    return (
        metrics.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "endpoint")
        .agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("status_code") >= 400, 1)).alias("errors"), F.round(F.avg("response_time_ms"), 6).alias("avg_ms"))
    )
