"""Near-duplicate classes by a MinHash LSH forest.

A document's set is its distinct four-word shingles. Two documents link when
the Jaccard similarity of their sets is at least 0.8. Equal sets are one node.

A forest has `TREES` trees. In each a node has a signature of `LEVELS` minimum
hashes of its set: two nodes agree on a level with the probability of their
similarity, so linked nodes have long common prefixes. Every tree's nodes are
sorted by signature. A region is what agrees on a prefix; it is deep if that
prefix is long.

1. Neighbours in the sorted orders, if they have the first two levels in common,
   are candidates: as many pairs as nodes for each tree, whatever the size of a
   group. The first two trees come first; then the neighbours of all trees that
   are not yet of one component.
2. In each region at depth two that still holds more than one component the
   depth adapts: if the pairs of nodes of different components are more than
   `CROWDED` times its nodes, it is cut by the next two levels, and so on. All
   pairs of different components in the regions that come out are candidates;
   nodes of a region's largest component are paired with the others only.
   At the last level all pairs are taken, however many.
   Before that, nodes of regions with more than `SWARM` times as many pairs as nodes
   (texts of one template, most of them just below 0.8) are bounded exactly. Of the
   shingles of all these nodes those are rare that fewer than `RARE` of them have.
   Two nodes share at most as many shingles as they share rare ones, and as the one
   with fewer common (not rare) ones has of these. Pairs that share rare ones are
   found by these, wherever they are: at most `RARE` / 2 for each. In a region, pairs
   are candidates only if the common shingles alone can be enough, and nodes
   whose common shingles are too few for any node of the region aren't looked at.
3. A linked partner is missed by a tree with probability 1 - 0.8 ** depth at
   most, so the depths of regions bound the probability to miss any partner. As
   trees where a node is by itself tell nothing of those where it meets a partner,
   the depth is that of the deepest cut of all regions at depth two that the node is
   in, for all trees. Nodes whose bound is above `MISSED` come into a next forest
   with other hashes, until there is none: crowded regions cost more trees, not recall.

Candidates are confirmed on full sets (parity sketches, which are never too
strict, drop most before). Verified links give components after each step.

Defined results: null and empty texts, and texts without a word, have an empty
set and are their own class; a text of fewer than four words has one shingle,
its whole sequence; rows that repeat are nodes of the same set; a row without
doc_id has no class (null) and is not kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, documents, inner, mixed, slices, text_bytes, written
from .components import components
from .sets import confirmed, digest, distinct_sets, shingle_sets, sketch, with_ids

SHINGLE, PERCENT = 4, 80
#: Trees of a forest; levels of a signature: two of 32 bits, which are the least depth, and eight of eight bits.
TREES, DEEPER = 14, 8
LEVELS = 2 + DEEPER
#: Depths at which a region may end.
DEPTHS = (2, 4, 6, 8, 10)
#: A region is cut further while it has more pairs of different components than so many times its nodes.
CROWDED = 8
#: A region is a swarm if it has more pairs of different components than so many times its nodes.
SWARM = 32
#: A shingle is rare if fewer nodes of swarms have it (a swarm has more nodes than that, so the words of its template are common).
RARE = 64
#: Regions of swarms' nodes may have so many times as many pairs before they are cut, as few of these become candidates.
FEW = 16
#: Probability to miss a partner of similarity 0.8 that a node's regions may have.
MISSED = 1e-5
#: Shingles that are hashed at a time.
STEP = 512
#: The first step takes the neighbours in so many trees.
FIRST_TREES = 2


def _constants(seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * TREES * LEVELS + 1, dtype=np.uint64) + np.uint64((seed + 1) << 32)).astype(np.uint32)
    return x[::2, None] | np.uint32(1), x[1::2, None]


def signature(shingles: np.ndarray, seed: int) -> np.ndarray:
    """The least value of each of TREES * LEVELS hash functions over a set that isn't empty."""
    odd, other = _constants(seed)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(odd), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), STEP):
        least = np.minimum(least, ((low[a : a + STEP] ^ other) * odd + high[a : a + STEP]).min(axis=1))
    return least


def _packed(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each tree's first two levels, and its others, as longs that sort like the signature."""
    trees = least.reshape(TREES, LEVELS).astype(np.uint64)
    region = trees[:, 0] << np.uint64(32) | trees[:, 1]
    rest = np.ascontiguousarray(trees[:, 2:].astype(np.uint8)).view(">u8")[:, 0].astype(np.uint64)
    return region.view(np.int64), (rest ^ np.uint64(1 << 63)).view(np.int64)


_LONGS = pa.list_(pa.int64())


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, n and, for sets that aren't empty, digest, sketch and each tree's signature in the first forest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = list(shingle_sets(batch.column(1), SHINGLE))
            packed = [_packed(signature(s, 0)) if len(s) else (None, None) for s in sets]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                *(pa.array([p[k] for p in packed], _LONGS) for k in (0, 1)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "digest", "sketch", "regions", "rests"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sketch binary, regions array<long>, rests array<long>")


def _planted_again(docs: DataFrame, seed: int) -> DataFrame:
    """digest and each tree's signature in a further forest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [s for s in shingle_sets(batch.column(1), SHINGLE) if len(s)]
            packed = [_packed(signature(s, seed)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), *(pa.array([p[k] for p in packed], _LONGS) for k in (0, 1))], names=["digest", "regions", "rests"])

    return docs.mapInArrow(run, "digest binary, regions array<long>, rests array<long>").dropDuplicates(["digest"])


def _trees(nodes: DataFrame) -> DataFrame:
    """tree, region, rest, node and n of nodes (with regions and rests); only regions with two nodes or more."""
    rows = nodes.select("node", "n", F.posexplode(F.arrays_zip("regions", "rests")).alias("tree", "at")).select("tree", "at.regions", "at.rests", "node", "n").toDF("tree", "region", "rest", "node", "n")
    shared = rows.groupBy("tree", "region").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("tree", "region")
    return rows.join(shared, ["tree", "region"], "left_semi")


#: Whether sets of n_u and n_v members that share no more than the lesser of two numbers of members can link (for the sizes themselves: 100 * least >= PERCENT * greatest).
_ENOUGH = f"{100 + PERCENT} * (least(most_u, most_v) + shared) >= {PERCENT} * (n_u + n_v)"


def _neighbours(table: DataFrame) -> DataFrame:
    """u and v: nodes of different components (table: tree, region, rest, node, n, component) that are next to each other in a tree's order, in one region.

    Partitions are ranges of the order. The last node of one and the first of the next are no pair here; their region is looked at in step 2.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            tree, region, node, n, component = (batch.column(k).to_numpy() for k in range(5))
            pair = (tree[1:] == tree[:-1]) & (region[1:] == region[:-1]) & (component[1:] != component[:-1])
            pair &= 100 * np.minimum(n[1:], n[:-1]) >= PERCENT * np.maximum(n[1:], n[:-1])
            u, v = np.maximum(node[1:], node[:-1])[pair], np.minimum(node[1:], node[:-1])[pair]
            last = batch.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    order = ["tree", "region", "rest", "node"]
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = table.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return ordered.select("tree", "region", "node", "n", "component").mapInArrow(run, "u long, v long").distinct()


def _placed(table: DataFrame, found: DataFrame | None) -> DataFrame:
    """table with each node's component."""
    if found is None:
        return table.withColumn("component", F.col("node"))
    return table.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(placed: DataFrame) -> DataFrame:
    """Rows of the regions that hold more than one component."""
    several = placed.groupBy("tree", "region").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("tree", "region")
    return placed.join(several, ["tree", "region"], "left_semi")


def _rare(sets: DataFrame) -> DataFrame:
    """nodes: for each shingle that fewer than RARE of the sets (node, set) have, the nodes that have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set"):
            data, ends = text_bytes(batch.column(1))
            shingles, owner = data.view(np.int64), np.repeat(batch.column(0).to_numpy(), np.diff(ends) // 8)
            order = np.argsort(shingles, kind="stable")
            shingles, owner = shingles[order], owner[order]
            starts = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1])))
            counts = np.diff(np.append(starts, len(shingles)))
            few = counts < RARE  # of a shingle that has more nodes already only their number is told
            ends = np.concatenate(([0], np.cumsum(np.where(few, counts, 0))))
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(owner[np.repeat(few, counts)]))
            yield pa.RecordBatch.from_arrays([pa.array(shingles[starts]), pa.array(counts), nodes], names=["shingle", "k", "nodes"])

    counted = sets.select("node", "set").mapInArrow(run, "shingle long, k long, nodes array<long>")
    return counted.groupBy("shingle").agg(F.sum("k").alias("k"), F.flatten(F.collect_list("nodes")).alias("nodes")).where(F.col("k") < RARE).select("nodes")


def _swarms(docs: DataFrame, nodes: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """node and common (shingles that aren't rare) of the nodes of swarms in table (open regions), and u and v of those that share rare shingles and can link; None if there is no swarm."""
    sizes = table.groupBy("tree", "region", "component").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("tree", "region").agg(F.sum("k").alias("nodes"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    swarms = sizes.where(F.col("nodes") * F.col("nodes") - F.col("squares") > 2 * SWARM * F.col("nodes"))
    swarming = table.join(swarms, ["tree", "region"], "left_semi").select("node", "component").distinct()
    swarming = written(swarming.join(nodes.select("node", "digest", "doc_id", "n"), "node"), "swarms")
    if not (many := swarming.count()):
        return None
    sets = distinct_sets(with_ids(docs, swarming.select("doc_id"), many), SHINGLE)
    rare = written(_rare(swarming.join(sets, "digest")), "rare")
    own = rare.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("rare"))
    common = written(swarming.join(own, "node", "left").select("node", "component", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common")), "common")
    pairs = rare.select("nodes", F.explode("nodes").alias("u")).select("u", F.explode(F.filter("nodes", lambda v: v < F.col("u"))).alias("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))
    side = lambda x: common.toDF(x, f"of_{x}", f"n_{x}", f"most_{x}")
    pairs = pairs.join(side("u"), "u").join(side("v"), "v").where(f"of_u <> of_v AND {_ENOUGH}")
    return common.select("node", "common"), pairs.select("u", "v")


def _bounded(table: DataFrame, common: DataFrame | None) -> DataFrame:
    """table with `limit`, the pairs for each node from which its region is crowded, and `most`, how many shingles a node can share with others of its region but for pairs that share rare ones, without the rows of nodes that can't link for that."""
    if common is None:
        return table.withColumn("most", F.col("n")).withColumn("limit", F.lit(float(CROWDED)))
    rows = table.join(common, "node", "left")
    regions = rows.groupBy("tree", "region").agg(F.min("n").alias("least"), (F.count("common") == F.count(F.lit(1))).alias("known"))  # bounds hold among nodes of swarms only
    rows = rows.join(regions, ["tree", "region"]).withColumn("most", F.when(F.col("known"), F.col("common")).otherwise(F.col("n")))
    enough = f"{100 * (100 + PERCENT)} * most >= {PERCENT} * (100 * n + greatest(100 * least, {PERCENT} * n))"
    return rows.where(enough).withColumn("limit", F.when(F.col("known"), float(FEW * CROWDED)).otherwise(float(CROWDED))).drop("common", "least", "known")


def _prefix(depth: int) -> Column:
    """What a signature begins with behind its first two levels, down to a depth."""
    return F.shiftright("rest", 8 * (LEVELS - depth)) if depth > 2 else F.lit(0).cast("long")


_REGION = ["tree", "region", "depth", "prefix"]


def _adapted(table: DataFrame) -> DataFrame:
    """table (open regions) with depth and prefix, the least at which each node's region isn't crowded, and that region's largest component and number of components (kinds)."""
    places = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in DEPTHS))).alias("place")
    rows = table.select("tree", "region", "node", "n", "most", "limit", "component", places).select("tree", "region", "node", "n", "most", "limit", "component", "place.*")
    sizes = rows.groupBy(*_REGION, "component").agg(F.count(F.lit(1)).alias("k"), F.first("limit").alias("limit"))
    k = F.col("k").cast("double")
    regions = sizes.groupBy(*_REGION).agg(F.sum(k).alias("nodes"), F.sum(k * k).alias("squares"), F.max_by("component", "k").alias("largest"), F.count(F.lit(1)).alias("kinds"), F.first("limit").alias("limit"))
    regions = written(regions.withColumn("crowded", (F.col("nodes") * F.col("nodes") - F.col("squares")) / 2 > F.col("limit") * F.col("nodes")), "regions")
    # A region is an end if it isn't crowded, or can't be cut, and the one above it is crowded. (One above that need not be: then both are ends, which only adds candidates.)
    above = F.when(F.col("depth") > 4, F.shiftright("prefix", 16)).otherwise(F.lit(0).cast("long"))
    crowded = regions.where(F.col("crowded") & (F.col("depth") < LEVELS)).select("tree", "region", (F.col("depth") + 2).alias("depth"), F.col("prefix").alias("above"))
    ends = regions.where(~F.col("crowded") | (F.col("depth") == LEVELS)).withColumn("above", above)
    ends = ends.where("depth = 2").drop("above").unionByName(ends.where("depth > 2").join(crowded, ["tree", "region", "depth", "above"], "left_semi").drop("above"))
    return rows.join(ends.select(*_REGION, "largest", "kinds"), _REGION)


def _pairs(adapted: DataFrame) -> DataFrame:
    """u and v: pairs of different components in the regions; of two of the largest one none is made."""
    adapted = adapted.where("kinds > 1")
    a = adapted.where("component <> largest").select(*_REGION, F.col("node").alias("x"), F.col("n").alias("n_u"), F.col("most").alias("most_u"), F.col("component").alias("of"))
    b = adapted.select(*_REGION, F.col("node").alias("y"), F.col("n").alias("n_v"), F.col("most").alias("most_v"), "component", "largest")
    pairs = a.join(b, _REGION).withColumn("shared", F.lit(0)).where(f"of <> component AND (component = largest OR of < component) AND {_ENOUGH}")
    return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: one row for each row of docs."""
    docs = inner(docs)[0].select("doc_id", "text")
    rows = written(_rows(docs), "forest-rows")
    first = [F.first(c).alias(c) for c in ("n", "sketch", "regions", "rests")]
    nodes = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *first)
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "forest-nodes")  # numbers are fixed once they are written
    planted, compared, links, found, again, swarms, forest = nodes, None, None, None, None, None, 0
    while True:
        table = written(_trees(planted), "trees")
        for step in ("first", "all", "regions"):
            if step != "regions" and forest:  # few nodes are left
                continue
            if step == "first":
                pairs = _neighbours(_placed(table.where(F.col("tree") < FIRST_TREES), None))
            else:
                old, table = table, written(_open(_placed(table.drop("component"), found)), "open")
                discarded(old)
                if step == "regions":
                    if not forest:  # nodes of further forests are some of this one's
                        swarms = _swarms(docs, nodes, table)
                    adapted = written(_adapted(_bounded(table, swarms and swarms[0])), "adapted")
                pairs = _neighbours(table) if step == "all" else _pairs(adapted)
                if step == "regions" and swarms and not forest:
                    pairs = pairs.unionByName(swarms[1]).distinct()
            if compared is not None:
                pairs = pairs.join(compared, ["u", "v"], "left_anti")
            tried, new = confirmed(docs, nodes, pairs, SHINGLE, PERCENT, f"forest-{forest}-{step}")
            compared, links = (tried, new) if compared is None else (compared.unionByName(tried), links.unionByName(new))
            found = components(links)
        # Logarithms of each node's probability to miss a partner: by the deepest cut of its regions, and in the forests before.
        missed = lambda d: log(1 - (PERCENT / 100) ** d)
        cut = adapted.where("kinds > 1").groupBy("tree", "region").agg(F.max("depth").alias("deepest")).where("deepest > 2")
        deepest = adapted.join(cut, ["tree", "region"]).groupBy("node").agg(F.max("deepest").alias("deepest"))
        bounds = deepest.select("node", F.coalesce(*(F.when(F.col("deepest") == d, F.lit(TREES * missed(d))) for d in DEPTHS)).alias("bound"))
        if again is not None:
            bounds = bounds.join(again.withColumnRenamed("bound", "before"), "node").select("node", (F.col("bound") + F.col("before")).alias("bound"))
        again = written(bounds.where(F.col("bound") > log(MISSED)), "again")
        discarded(table)
        if not (left := again.count()):
            break
        forest += 1
        chosen = nodes.join(again.select("node"), "node", "left_semi")
        texts = with_ids(docs, chosen.select("doc_id"), left)
        planted = chosen.drop("regions", "rests").join(_planted_again(texts, forest), "digest")
    ids = nodes.select("node", "digest", "doc_id")
    joined = ids.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(least, "component").select("digest", "component_id")
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
