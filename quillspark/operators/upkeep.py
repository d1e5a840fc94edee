"""Changes of stored tables, as the tables after them: replaced, deleted and appended rows, encoded passages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def replaced(rows: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows without those of the keys that new has, and new."""
    return deleted(rows, new, key).unionByName(new.select(*rows.columns))


def deleted(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)


def appended(rows: DataFrame, new: DataFrame, path: str | None = None) -> DataFrame:
    """rows and new ones, which a path also stores: one append, so that either all of them are stored or none."""
    if path:
        new.write.mode("append").parquet(path)
    return rows.unionByName(new.select(*rows.columns))


def passage(title: Column, heading: Column, text: Column) -> Column:
    """"title > heading", a blank line and the text; what is null or empty is left out."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws("\n\n", some(F.concat_ws(" > ", some(title), some(heading))), text)


def keyed(texts: DataFrame, role: str) -> DataFrame:
    """id, text under a role's prefix, and key of texts (id, text)."""
    rows = texts.select("id", F.concat(F.lit(f"{role}: "), "text").alias("text"))
    return rows.withColumn("key", F.sha2(F.concat("text", F.lit("True")), 256))


def normalised(raw: DataFrame) -> DataFrame:
    """key and vector (of length one; zeros stay) of rows of key and raw."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            norms = np.sqrt(np.bincount(owner, flat * flat, len(sizes)))
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            made = pa.ListArray.from_arrays(ends, pa.array(flat / np.where(norms == 0, 1, norms)[owner]), mask=lists.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["key", "vector"])

    return raw.select("key", "raw").mapInArrow(run, "key string, vector array<double>")


def encoded(texts: DataFrame, encoder: Callable[[DataFrame], DataFrame], role: str = "passage", known: DataFrame | None = None) -> DataFrame:
    """id, key and vector (of length one) of texts (id, text) under a role's prefix; texts whose key is known (key, vector) are not encoded again.

    encoder: from rows of key and text rows of key and raw (arrays of doubles), such as a model applied to Arrow batches.
    """
    rows = keyed(texts, role)
    fresh = rows.select("key", "text").dropDuplicates(["key"])
    if known is not None:
        fresh = fresh.join(known.select("key"), "key", "left_anti")
    made = normalised(encoder(fresh))
    return rows.select("id", "key").join(made if known is None else made.unionByName(known.select("key", "vector")), "key")


def letter_counts(letters: str) -> Callable[[DataFrame], DataFrame]:
    """An encoder that stands where there is no model: how often each letter stands in a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([pc.fill_null(pc.count_substring(batch.column(1), c), 0).to_numpy(zero_copy_only=False) for c in letters], axis=1)
            ends = pa.array(np.arange(batch.num_rows + 1) * len(letters), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(counts.ravel().astype(np.float64)))], names=["key", "raw"])

    return lambda rows: rows.select("key", "text").mapInArrow(run, "key string, raw array<double>")


def dispatched(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Chunks by the kind of their document (docs: doc_id, kind, title, pages, seconds; lines: doc_id, line, of, text, heading).

    A pdf's chunks get a page, a web page's its title where there is no heading
    (the section stays null), a video's equal shares of its time; other kinds
    are plain; a document without content has none.
    """
    rows = lines.join(docs, "doc_id").where("text <> ''")
    slot = lambda n: F.when(F.col("kind") == "youtube", F.round(F.col("seconds") * n / F.col("of"), 6))
    return rows.select(
        "doc_id",
        "line",
        F.when(F.col("kind") == "pdf", 1 + F.floor(F.col("line") * F.col("pages") / F.col("of"))).cast("long").alias("page"),
        F.when(F.col("kind") == "url", F.coalesce(F.nullif("heading", F.lit("")), F.nullif("title", F.lit("")))).otherwise(F.col("heading")).alias("heading_path"),
        F.col("heading").alias("section"),
        slot(F.col("line")).alias("ts_start"),
        slot(F.col("line") + 1).alias("ts_end"),
    )


def upload_error(name: Column, size: Column, known: Column, most_mb: float) -> Column:
    """The first check that an upload fails: kind, size, name given before; null if none."""
    limit = f"{most_mb:g}MB limit"
    return (
        F.when(~F.lower(name).endswith(".pdf"), F.concat(name, F.lit(" is not a supported PDF file")))
        .when(size > most_mb * 1024 * 1024, F.concat(name, F.lit(f" exceeds {limit}")))
        .when(known, F.concat(name, F.lit(" already added")))
    )


def transcript_choice(tracks: DataFrame) -> DataFrame:
    """Of each video's caption tracks (video, lang, is_generated, track) one: by hand before generated ones, by language, others last."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in K.CAPTION_LANGUAGES)), F.col("lang")), F.lit(0))
    known = F.when(rank > 0, rank).otherwise(len(K.CAPTION_LANGUAGES) + 1)
    order = F.struct(F.when(rank > 0, F.col("is_generated").cast("int")).otherwise(2).alias("a"), known.alias("b"), F.col("track").alias("track"))
    best = F.min_by(F.struct("track", "lang", "is_generated"), order)
    return tracks.groupBy("video").agg(best.alias("x")).select("video", "x.*")


def transcript(segments: DataFrame, by: str) -> DataFrame:
    """Of each group of segments (at, start, duration, text): text without blank ones, number of them and where the last ends."""
    kept = segments.where(F.trim("text") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text")))), lambda x: x["text"])
    return kept.groupBy(by).agg(F.array_join(ordered, " ").alias("text"), F.count(F.lit(1)).alias("segments"), F.round(F.max(F.col("start") + F.col("duration")), 6).alias("duration"))


def source_head(rank: Column, title: Column, page: Column, seconds: Column, heading: Column) -> Column:
    """[Source i: title, page, time, heading]: a page or time of 0 and a heading like the title are left out."""
    return F.concat(
        F.lit("[Source "), rank, F.lit(": "), title,
        F.when(page != 0, F.concat(F.lit(", Page "), page)).otherwise(""),
        F.when(seconds != 0, F.concat(F.lit(", "), F.format_string("%.1f", seconds), F.lit("s"))).otherwise(""),
        F.when((heading != "") & (heading != title), F.concat(F.lit(", "), heading)).otherwise(""),
        F.lit("]"),
    )
