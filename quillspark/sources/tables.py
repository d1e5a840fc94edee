"""Tables of a data folder, and the views of them that the entities of the model have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A table of fewer partitions than this and than there are cores is dealt out before work on its texts.
FEW_PARTITIONS = 64


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it is small enough to have come in fewer (as one row group); large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= min(cores, FEW_PARTITIONS) else df


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, question (the first eight words of an item) and answer (its whole text)."""
    words = F.slice(F.split("text", r"\s+"), 1, 8)
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("question"), F.col("text").alias("answer"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def trusted(spark: SparkSession, folder: str) -> DataFrame:
    """Scope of documents whose label says quality 1."""
    return table(spark, folder, "labels").where("quality = 1").select("doc_id")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Events as API metrics: endpoint, status_code, response_time_ms, user_id, ts."""
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return table(spark, folder, "events").select("event_id", F.col("event_type").alias("endpoint"), status.alias("status_code"), F.col("value").alias("response_time_ms"), "user_id", "ts")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, project (its source), title, text."""
    return table(spark, folder, "documents").select("doc_id", F.col("source").alias("project"), F.concat(F.lit("doc-"), "doc_id").alias("title"), "text")


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, at and path: short lines stand for headings."""
    return lines.where(F.length(F.trim("text")).between(1, 40)).select("doc_id", F.col("line").alias("at"), F.col("text").alias("path"))


def with_heading(lines: DataFrame) -> DataFrame:
    """lines (with head) with `heading`: a document's first line, if it is short, heads the others."""
    return lines.withColumn("heading", F.when((F.col("line") > 0) & F.length("head").between(1, 40), F.col("head"))).drop("head")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as transcript segments: conv_id, at, start and end in seconds, duration, text."""
    start, duration = F.col("turn") * 7.5, F.length("text") / 16.0
    return table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("at"), start.alias("start"), (start + duration).alias("end"), duration.alias("duration"), "text")
