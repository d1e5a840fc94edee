"""Connected components of a table of edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, written

#: Edges that one task contracts at a time.
LOCAL_EDGES = 100_000


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The same components with stars for edges inside each task's share (u > v, LOCAL_EDGES at a time): a chain in one task is one star at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}

        def root(x: int) -> int:
            path = []
            while (up := least.get(x, x)) != x:
                path.append(x)
                x = up
            for y in path:
                least[y] = x
            return x

        def stars() -> pa.RecordBatch:
            u = list(least)
            v = [root(x) for x in u]
            least.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        seen = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    least[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen >= LOCAL_EDGES:
                yield stars()
                seen = 0
        yield stars()

    return edges.select("u", "v").coalesce(tasks).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least reachable node) for every node of the edges u, v (longs).

    Each round relinks every node to a smaller one it can reach; the rounds end
    when all edges are stars around their least nodes (a number of rounds that
    grows with the square of the logarithm of the nodes at most). The edges of a
    round are written to the shared folder, so a lost executor costs one round;
    those of the round before are deleted. Before each round every task contracts
    its share of the edges, which is all of them if they are few. A hub's edges are joined with its one
    row of `least`, so the planner may split them among tasks.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _print(edges)
    while True:
        if before[0] < LOCAL_EDGES:  # one task's share (a full one would be cut)
            old, edges = edges, written(contracted(edges, 1), "edges")
            discarded(old)
            break
        whole, edges = edges, contracted(edges, before[0] // LOCAL_EDGES + 1)
        # Large star: each node's larger neighbours are linked to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each node and its smaller neighbours are linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        discarded(whole)
        if (now := _print(edges)) == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _print(edges: DataFrame) -> tuple:
    """Count and hash of a table of distinct edges, whatever their order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
