"""Retrieval of chunks: where each chunk stands, its vector, and the hybrid search over the chunks of a scope."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.arrow import pieces
from . import fusion, lexical, sequences, vectors

#: Numbers of a hashed vector.
DIMENSIONS = 64
#: Chunks of a document have ids from its id times this on.
CHUNK_IDS = 1_000_000
#: Tokens whose places a task keeps.
CACHED = 1 << 16


def hashed_features(rows: DataFrame) -> DataFrame:
    """An encoder (key, text to key, raw): every token adds one to a place that its hash gives, or takes one away."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = lru_cache(CACHED)(lambda t: int(md5(t.encode()).hexdigest()[:4], 16) % (2 * DIMENSIONS))
        for batch in pieces(batches):
            lists, n = batch.column(1), batch.num_rows
            tokens = lists.flatten().dictionary_encode()
            flat = np.array([place(t) for t in tokens.dictionary.to_pylist()], np.int64)[tokens.indices.to_numpy()]
            owner = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            out = np.bincount(owner * DIMENSIONS + flat % DIMENSIONS, np.where(flat < DIMENSIONS, 1.0, -1.0), n * DIMENSIONS)
            vectors_made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * DIMENSIONS, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors_made], names=["key", "raw"])

    return rows.select("key", T.tokens(F.col("text")).alias("tokens")).mapInArrow(run, "key string, raw array<double>")


def chunk_id(chunks: DataFrame) -> Column:
    return chunks["doc_id"] * CHUNK_IDS + chunks["chunk_index"]


def dispatched(chunks: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks with page, ts_start, ts_end and heading_path by the kind of their document (docs: doc_id, kind, title, seconds; pages: doc_id, page, size).

    A pdf's chunks get the page they start on, a web page's its title where no
    heading stands above (the section stays null), a video's equal shares of its
    time; other kinds are plain.
    """
    # All kinds in one, as two halves would make the chunks twice; a document without pages has none.
    rows = chunks.join(docs, "doc_id").withColumn("start", F.col("start_char"))
    rows = sequences.page_of(rows, pages.join(docs.where("kind = 'pdf'"), "doc_id", "left_semi")).drop("start")
    slot = lambda n: F.when(F.col("kind") == "youtube", F.round(F.col("seconds") * n / F.col("total_chunks"), 6))
    heading = F.when(F.col("kind") == "url", F.coalesce(F.nullif("heading_path", F.lit("")), F.nullif("title", F.lit("")))).otherwise(F.col("heading_path"))
    return rows.select(*(c for c in chunks.columns if c != "heading_path"), heading.alias("heading_path"), "page", slot(F.col("chunk_index")).alias("ts_start"), slot(F.col("chunk_index") + 1).alias("ts_end"))


def hybrid(chunks: DataFrame, known: DataFrame, questions: DataFrame, asked: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """The k best chunks (id, heading_path, text) for each question (query_id, question), with `source` (their rank), score and text.

    known and asked are the vectors (id, vector) of chunks and questions. Both
    searches see the same chunks; their lists are fused, and of chunks that are
    nearly alike the better one stays. A chunk's text goes along from the fused
    list on, so chunks are joined once.
    """
    dense = vectors.block_search(known, asked, K.CANDIDATES).withColumnRenamed("id", "doc_id")
    searched = chunks.select(F.col("id").alias("doc_id"), F.concat_ws(" ", "heading_path", "text").alias("text"))
    lists = [dense, lexical.best(searched, questions, K.CANDIDATES)]
    fused = fusion.fused(lists).select("query_id", "doc_id", "position", (F.col("best") + F.col("total")).alias("score"))
    found = fused.join(chunks.select(F.col("id").alias("doc_id"), "text", F.col("text").alias("whole")), "doc_id")
    kept = fusion.deduped(found)
    source = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return kept.withColumn("source", source).where(F.col("source") <= k).select("query_id", "source", F.col("doc_id").alias("id"), "score", F.col("whole").alias("text"))
