"""Streams over files: ingest states, a cache with lifetimes, sessions. Each can be replayed in available-now mode and begun again from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def logged(rows: DataFrame, by: str, key: str, path: str, times: int = 3, files: int = 4) -> None:
    """rows as a log that has grown: equal spans of `by` (a number), one written after the other, as a stream reads older files first. A key's rows of a span are in one file, so that they come in order."""
    least, most = rows.agg(F.min(by), F.max(by)).first()
    least, most = (0, 0) if least is None else (least, most)
    span = (most - least) / times
    for k in range(times):
        part = rows.where((F.col(by) >= least + k * span) & ((F.col(by) < least + (k + 1) * span) if k + 1 < times else F.lit(True)))
        part.repartition(files, key).write.mode("append").parquet(path)


def replayed(rows: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs all files that are there through `batch`; files before the checkpoint do not come again."""
    rows.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that may repeat: each batch has its own folder, which a repeated batch writes again."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest(docs: DataFrame, made: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """States of documents (doc_id, text) as they come in: queued with their batch, then ready with the number of their chunks, or error if there are none.

    made: chunks (doc_id, ...) of a batch of documents.
    """

    def batch(rows: DataFrame, number: int) -> None:
        ids = rows.select("doc_id")
        counted = made(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
        done = ids.join(counted, "doc_id", "left").select("doc_id", F.when(F.col("chunks") > 0, "ready").otherwise("error").alias("status"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
        queued = ids.select("doc_id", F.lit("queued").alias("status"), F.lit(0).cast("long").alias("chunks"))
        stored(path)(queued.withColumn("step", F.lit(0)).unionByName(done.withColumn("step", F.lit(1))), number)

    replayed(docs, checkpoint, batch)


def cache_answers(asked: DataFrame, seconds: float) -> DataFrame:
    """asked (a stream of key, at (seconds), id) with `hit`: whether an answer stored for the key at most `seconds` ago was there; if not, one is stored. A hit doesn't prolong it.

    State is one number for each key; keys without a question for a day of event time would be dropped by a timeout, which a replay needs not.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (since,) = state.get if state.exists else (float("-inf"),)
        rows = pd.concat(frames).sort_values(["at", "id"])
        hits = []
        for at in rows["at"]:
            hits.append(at - since <= seconds)
            if not hits[-1]:
                since = at
        state.update((since,))
        yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "hit": hits})

    return asked.groupBy("key").applyInPandasWithState(run, "key long, id long, hit boolean", "since double", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """First and last time and number of the events (key, ts) of each session: a pause of `gap` or more ends it (the batch operator needs more than the gap)."""
    by = F.session_window("ts", gap)
    found = events.withWatermark("ts", late).groupBy(by.alias("session"), key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    return found.select(key, "first", "last", "events")
