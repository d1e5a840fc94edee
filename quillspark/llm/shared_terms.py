"""Ranked lexical search for many items at once, by common subexpressions.

An item's score of a document is a sum over the item's terms, and items share
terms. The sums of a block of items are mined for what they have in common:
terms that exactly the same items hold are one shared set, and then, again and
again, the two sums that stand together in the most items become one node, as
long as any two stand together in two items. The nodes form a directed acyclic
graph whose leaves are terms (with how often an item repeats them) and whose
roots are the items. A task takes some documents at a time, makes the partial
accumulators of all documents for each shared node once, and adds them up along
the graph: what items share is added once for all of them.

1. The documents are read once: the places of the items' terms in each, and the
   number of all its terms, are written (for each document the numbers of the
   terms it holds and their counts, no text).
2. Sums over that table give the documents with a term, all terms, and each
   term's document frequency.
3. It is read again for the scores. A task keeps each item's ten best documents
   of those it has seen, so ten rows for each task and item are shuffled, and the
   best of them are taken in two steps.

Items are read in batches of bounded size, each of which goes over the documents
once: what a task holds of the items does not grow with their table. Terms are
told by 64-bit hashes. All but the terms' weights is whole-number arithmetic.

Defined results: null and empty texts have no terms and are no documents of the
statistics; rows that repeat count each and are ranked each; a document without
doc_id counts, but is not ranked; an item without terms, or whose terms stand
nowhere, has no rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discarded, documents, hashed_words, slices, text_bytes, written

TOP = 10
#: Items, and characters of their texts, that one pass over the documents answers at most (one longer item is a batch of its own).
BATCH_ITEMS, BATCH_CHARS = 20_000, 8 << 20
#: Items of a graph, and documents that a task scores at a time.
GRAPH_ITEMS, STEP_DOCS = 500, 512
#: Sums of one item that are looked at for pairs; the others are added as they are. It bounds the time of the mining, not what is added up.
MINED = 200
#: Buckets of the first step of taking the best.
BUCKETS = 64

_IS_TERM = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, and where each text's begin."""
    return hashed_words(*text_bytes(column), _IS_TERM)


class Graph:
    """The sums of a block of items as a directed acyclic graph.

    leaves: (term, times it is repeated); sums: for each shared node, in an order in
    which they can be made, the two nodes or more that it adds; items: the nodes that
    each item adds. Nodes are numbered leaves first.
    """

    def __init__(self, items: list[dict[int, int]]):
        holders: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, counts in enumerate(items):
            for leaf in sorted(counts.items()):
                holders[leaf].append(k)
        self.leaves = list(holders)
        self.sums: list[tuple[int, ...]] = []
        groups: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for node, held in enumerate(holders.values()):
            groups[tuple(held)].append(node)
        self.items: list[set[int]] = [set() for _ in items]
        for held, nodes in groups.items():
            node = self._node(tuple(nodes)) if len(nodes) > 1 and len(held) > 1 else None
            for k in held:
                self.items[k].update(nodes if node is None else [node])
        self._pair_up()

    def _node(self, added: tuple[int, ...]) -> int:
        self.sums.append(added)
        return len(self.leaves) + len(self.sums) - 1

    def _pair_up(self) -> None:
        uses = Counter(n for s in self.items for n in s)
        mined = [set(sorted((n for n in s if uses[n] > 1), key=lambda n: (-uses[n], n))[:MINED]) for s in self.items]
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for k, s in enumerate(mined):
            for a in s:
                for b in s:
                    if a < b:
                        where[a, b].add(k)
        heap = [(-len(h), p) for p, h in where.items() if len(h) > 1]
        heapq.heapify(heap)
        while heap:
            count, (a, b) = heapq.heappop(heap)
            held = [k for k in where[a, b] if a in mined[k] and b in mined[k]]
            if len(held) < 2:
                continue
            if len(held) < -count:  # others were paired up meanwhile
                heapq.heappush(heap, (-len(held), (a, b)))
                continue
            node, partners = self._node((a, b)), defaultdict(set)
            for k in held:
                self.items[k] -= {a, b}
                self.items[k].add(node)
                mined[k] -= {a, b}
                for x in mined[k]:
                    partners[x].add(k)
                mined[k].add(node)
            for x, ks in partners.items():
                if len(ks) > 1:
                    where[x, node] = ks
                    heapq.heappush(heap, (-len(ks), (x, node)))

    def scores(self, leaf_values: np.ndarray) -> np.ndarray:
        """For each item the sums of documents, from the leaves' values (leaves x documents)."""
        made = np.empty((len(self.leaves) + len(self.sums), leaf_values.shape[1]), np.int64)
        made[: len(self.leaves)] = leaf_values
        for k, added in enumerate(self.sums, len(self.leaves)):
            np.add(made[added[0]], made[added[1]], out=made[k])
            for n in added[2:]:
                made[k] += made[n]
        out = np.zeros((len(self.items), leaf_values.shape[1]), np.int64)
        for k, nodes in enumerate(self.items):
            for n in nodes:
                out[k] += made[n]
        return out


def _counted(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id, n (all terms) and, of the known terms (sorted hashes) it holds, their numbers and counts, for each document with a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, firsts = terms(batch.column(1))
            sizes = np.diff(firsts)
            near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[near] == hashes)
            rows = np.searchsorted(firsts, hit, side="right") - 1
            cells, counts = np.unique(rows * len(known) + near[hit], return_counts=True)
            ends = np.searchsorted(cells, np.arange(len(sizes) + 1) * len(known))
            keep = pa.array(sizes > 0)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)).filter(keep) for x in ((cells % len(known)).astype(np.int32), counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(sizes, pa.int64()).filter(keep), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def _best(scores: np.ndarray, ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(score, doc_id) of the TOP best of a row of scores that are positive and no less than `least`."""
    at = np.flatnonzero(scores >= max(1, least))
    at = at[np.lexsort((ids[at], -scores[at]))][:TOP]
    return list(zip(scores[at].tolist(), ids[at].tolist(), strict=True))


def _scored(counted: DataFrame, graphs: list[tuple[list[int], Graph]], weights: dict[int, int], documents: int, all_terms: int) -> DataFrame:
    """item, doc_id and score: of each task the best documents for each item (by its number)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = defaultdict(list)
        columns = {}
        for g, (_, graph) in enumerate(graphs):
            for leaf, (term, times) in enumerate(graph.leaves):
                columns.setdefault(term, []).append((g, leaf, times * weights.get(term, 0)))
        for batch in batches:
            for start in range(0, batch.num_rows, STEP_DOCS):
                step = batch.slice(start, STEP_DOCS)
                ids, sizes = step.column(0).to_numpy(), step.column(1).to_pylist()
                m = np.array([25 + 75 * n * documents // all_terms for n in sizes], np.int64)
                values = [np.zeros((len(graph.leaves), len(ids)), np.int64) for _, graph in graphs]
                per_doc, found, tf = step.column(2).value_lengths().to_numpy(), step.column(2).flatten().to_numpy(), step.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(len(ids)), per_doc)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                order = np.argsort(found, kind="stable")
                cuts = np.flatnonzero(np.diff(found[order], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    at = order[a:b]
                    for g, leaf, weight in columns.get(int(found[at[0]]), ()):
                        values[g][leaf, doc[at]] = weight * impact[at]
                for (numbers, graph), v in zip(graphs, values, strict=True):
                    scores = graph.scores(v)
                    top = scores.max(axis=1)
                    for k in np.flatnonzero(top > 0):
                        seen = best[numbers[k]]
                        least = seen[-1][0] if len(seen) == TOP else 1
                        if top[k] >= least:
                            best[numbers[k]] = heapq.nsmallest(TOP, seen + _best(scores[k], ids, least), key=lambda x: (-x[0], x[1]))
        rows = [(item, doc_id, score) for item, found in best.items() for score, doc_id in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], names=["item", "doc_id", "score"])

    return counted.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long")


def _batches(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items (item_id, text) in lists of bounded size."""
    batch, chars = [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if batch and (len(batch) == BATCH_ITEMS or chars + len(r["text"]) > BATCH_CHARS):
            yield batch
            batch, chars = [], 0
        batch.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if batch:
        yield batch


def _answered(docs: DataFrame, batch: list[tuple[int | None, str]]) -> DataFrame | None:
    """The best documents of each item of a batch; None if no item has a term."""
    hashes, firsts = terms(pa.array([t for _, t in batch], pa.string()))
    if not len(hashes):
        return None
    known, numbers = np.unique(hashes, return_inverse=True)
    counted = written(_counted(docs, known), "terms")
    total = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # as many rows as the batch has terms at most
    weights = {r["term"]: math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * r["df"] + 1))) for r in frequency}
    sums = [Counter(numbers[a:b].tolist()) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    graphs = [(list(range(k, min(k + GRAPH_ITEMS, len(sums)))), Graph(sums[k : k + GRAPH_ITEMS])) for k in range(0, len(sums), GRAPH_ITEMS)]
    best = _scored(counted, graphs, weights, total["documents"], total["terms"] or 1)
    order = [F.desc("score"), F.asc("doc_id")]
    number = F.row_number().over(Window.partitionBy("item", "bucket").orderBy(*order))
    best = best.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))).withColumn("rank", number).where(F.col("rank") <= TOP)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= TOP)
    ids = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(batch)], "item long, item_id long")
    out = written(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    discarded(counted)
    return out


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score: the TOP best documents for each row of items."""
    found = None
    for batch in _batches(items):
        if (answer := _answered(docs, batch)) is not None:
            found = answer if found is None else found.unionByName(answer)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def op12_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
