"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import discarded, shared_dir, written

__all__ = ["discarded", "shared_dir", "written"]

#: Text bytes that one step of a vectorised operator holds at once (one longer text is a step of its own).
SLICE_BYTES = 2 << 20


def inner(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with doc_id and text under these names and all other columns under plain ones (by place, so that no name of theirs clashes or needs quotes), and the names to give back."""
    names = docs.columns
    return docs.toDF(*(n if n in ("doc_id", "text") else f"column_{i}" for i, n in enumerate(names))), names


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` text bytes, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_offsets(batch.column(batch.schema.get_field_index(column)))[1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of the texts, from 0; a null has no bytes."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = column.buffers()[1]
    if raw is None or not len(column):
        return np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(raw, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return ends - ends[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column, one text after the other, and the offsets of the texts."""
    ends = text_offsets(column)
    if not ends[-1]:
        return np.zeros(0, np.uint8), ends
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    first = int(np.frombuffer(column.buffers()[1], kind)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8, int(ends[-1]), first), ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(2)
def _power_table(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(x: np.uint64, n: int) -> np.ndarray:
    """x**0 ... x**(n - 1) modulo 2**64; one table serves all slices of the usual size."""
    return _power_table(int(x), max(SLICE_BYTES, 1 << n.bit_length()) if n else 1)[:n]


#: A random 64-bit value for each byte, A-Z like a-z.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE[65:91] = _BYTE[97:123]


def hashed_words(data: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (a run of bytes that is_word has, A-Z as a-z), and for each text its first word's number.

    The hash of a run is a polynomial in random values of its bytes, had from
    prefix sums modulo 2**64 (the base is odd, so it has an inverse), then mixed.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True  # a word ends where its text ends
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    stops = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    value = (sums[stops] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    return mixed(value + (stops - starts).astype(np.uint64)), np.searchsorted(starts, ends)
