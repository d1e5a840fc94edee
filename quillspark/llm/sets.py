"""Shingle sets of texts, and the exact check of pairs of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, hashed_words, mixed, slices, text_bytes, written

#: Least bits of the parity sketch; one of a set of n has the least power of two that is no less than n.
LEAST_SKETCH = 256
#: Ids up to this many are broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_IS_WORD = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of `width` words as sorted 64-bit hashes; a shorter text is one shingle."""
    words, firsts = hashed_words(*text_bytes(column), _IS_WORD)
    if len(words) >= width:
        n = len(words) - width + 1
        grams = np.full(n, width, np.uint64)
        for k in range(width):
            grams = mixed(grams + words[k : k + n] * np.uint64(2 * k + 3))
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = mixed(h * np.uint64(5) + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the set's members in hash buckets: two sketches differ in no more bits than the sets in members."""
    bits = max(LEAST_SKETCH, 1 << (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((mixed(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)))
    return int(np.bitwise_count(x ^ y).sum())


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """u, v, digest_u and digest_v of pairs (with n_u, n_v, sketch_u, sketch_v) whose sketches allow a similarity of percent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|) for linked sets, and the sketches differ in no more bits than that.
            n, m, x, y = (batch.column(k).to_pylist() for k in range(4, 8))
            keep = [differing(p, q) * (100 + percent) <= (100 - percent) * (i + j) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "digest_u", "digest_v", "n_u", "n_v", "sketch_u", "sketch_v").mapInArrow(run, "u long, v long, digest_u binary, digest_v binary")


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """u and v of pairs (u, v, set_u, set_v) whose sets have a similarity of percent or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # merges two sorted runs
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long")


def with_ids(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """doc_id and text of the documents in ids (doc_id), which are no more than `most`."""
    few = most <= MOST_BROADCAST
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """digest and set (bytes) of every row of docs; a task gives equal sets once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, "text"):
            made = {}
            for s in shingle_sets(batch.column(0), width):
                if (d := digest(s)) not in seen:
                    seen.add(d)
                    made[d] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(made.keys(), pa.binary()), pa.array(made.values(), pa.binary())], names=["digest", "set"])

    return docs.select("text").mapInArrow(run, "digest binary, set binary")


def distinct_sets(docs: DataFrame, width: int) -> DataFrame:
    """digest and set (bytes) of docs' sets, each once."""
    return _sets(docs, width).dropDuplicates(["digest"])


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Of the pairs u, v of nodes (node, digest, doc_id, n, sketch) those that could link and were compared, and those that link.

    Sketches drop most pairs; the sets of the rest are made again from the texts of one document for each node.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("digest", "n", "sketch")))
    near = written(possible(pairs.join(side("u"), "u").join(side("v"), "v"), percent), f"{name}-pairs")
    wanted = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).distinct()
    ids = nodes.join(wanted, "node", "left_semi").select("doc_id")
    sets = written(_sets(with_ids(docs, ids, 2 * near.count()), width), f"{name}-sets")
    sets_of = lambda x: sets.select(F.col("digest").alias(f"digest_{x}"), F.col("set").alias(f"set_{x}"))
    links = written(linked(near.join(sets_of("u"), "digest_u").join(sets_of("v"), "digest_v"), percent), f"{name}-links")
    discarded(sets)
    return near.select("u", "v"), links
