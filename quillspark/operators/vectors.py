"""Vector search: exact dot product and cosine, one question or a block of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import Best
from ..sources.shared import shared_dir
from .lexical import ranked

#: Questions that one pass over the vectors answers at once (their matrix goes to every task).
BLOCK = 1024
#: Scores that a task holds at once.
HELD = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def search(vectors: DataFrame, question: list[float], floor: float | None = None, measure: str = "dot") -> DataFrame:
    """id and score of every vector (id, vector) for one question; only scores from the floor on."""
    q = F.array(*(F.lit(float(x)) for x in question))
    out = vectors.select("id", (dot if measure == "dot" else cosine)(F.col("vector"), q).alias("score"))
    return out if floor is None else out.where(F.col("score") >= floor)


def batch_search(vectors: DataFrame, questions: list[tuple[int, list[float]]], k: int | None, floor: float | None = None, measure: str = "dot") -> DataFrame:
    """query_id, id and score of the k best (all) of each task for a block of questions, from a floor on: a matrix product of some vectors at a time.

    The rows left are k for each question and task; `ranked` takes the k best of all.
    """
    if len(questions) > BLOCK:
        raise ValueError(f"at most {BLOCK} questions in a block")
    ids = np.array([i for i, _ in questions], np.int64)
    matrix = _measured(np.array([v for _, v in questions], np.float64), measure).T

    def rows(query: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(keys), pa.array(scores)], names=["query_id", "id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        least = -np.inf if floor is None else floor
        best = Best(len(ids), k, least) if k is not None else None
        step = max(16, HELD // len(ids))
        for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            keys, scores = batch.column(0).to_numpy(), _measured(_matrix(batch.column(1)), measure) @ matrix
            if best is not None:
                best.add(keys, scores)
                continue
            at, query = np.nonzero(scores >= least)
            yield rows(query, keys[at], scores[at, query])
        if best is not None:
            yield rows(*best.found)

    return vectors.select("id", "vector").mapInArrow(run, "query_id long, id long, score double")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (lists.null_count or np.any(sizes != sizes[0])):
        raise ValueError("vectors of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)


def _measured(rows: np.ndarray, measure: str) -> np.ndarray:
    """Rows as they are, or for cosines of length one (a row of zeros stays)."""
    if measure == "dot" or not rows.size:
        return rows
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def block_search(vectors: DataFrame, questions: DataFrame, k: int | None, floor: float | None = None, measure: str = "dot") -> DataFrame:
    """query_id, id, score and rank of the k best (all) for any number of questions (id, vector), a block at a time.

    Of several blocks the best of each are written (to the shared folder) before the next one is read, and ranked again at
    the end: the driver holds one block, and the plan is that of one table. Without k there is no rank.
    """
    spark = vectors.sparkSession
    rows = ((r["id"], r["vector"]) for r in questions.select("id", "vector").toLocalIterator(prefetchPartitions=True))
    block, path = list(islice(rows, BLOCK)), ""
    best_of = lambda df: ranked(df, k, "id") if k else df
    while True:
        best = best_of(batch_search(vectors, block, k, floor, measure)).select("query_id", "id", "score")
        block = list(islice(rows, BLOCK))
        if not block and not path:
            return best_of(best)
        path = path or f"{shared_dir(spark)}/block-search-{uuid.uuid4().hex}"
        best.write.mode("append").parquet(path)
        if not block:
            return best_of(spark.read.schema(best.schema).parquet(path))
