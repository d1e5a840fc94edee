"""N-gram Jaccard join by size-aware heavy and light sets, and its classes.

A document's set is its distinct five-word shingles (hashed to 64 bits). Two
documents link when the Jaccard similarity of their sets is at least 0.75.

1. Equal sets are one node, told by a 128-bit digest (lists carry its first 64 bits as
   the node's number), so copies cost one row each.
2. Under any fixed order of shingles, two linked sets share at least c of their
   first n - ceil(0.75 n) + c (the c-prefix). Small sets enumerate all 2-subsets
   of their 2-prefix as keys; large sets, and small ones that a large one can
   still reach, post the shingles of their 1-prefix to inverted lists. The size
   that parts small from large is the one of least cost under the corpus's own
   histogram of sizes.
3. The order puts shingles that many documents share last (their counts come
   from a hashed sample of the documents, and the order is only a matter of
   cost: any order gives all links).
4. In some rounds every node of a list is paired with the list's leader: first
   with its most central node (the one found in most lists, as the text is that
   its near copies were made from), then with a random one. These are pairs that
   grow in number with the list, not its square. Verified links give components, and later rounds take
   only pairs whose components still differ. All such pairs that are left after
   the rounds are verified too, so no link between components is lost. A bound
   on the symmetric difference from bit parities (never too large) drops most
   pairs before their sets are compared exactly.

Defined results: null and empty texts, and texts without a word, have an empty
set and link with nothing; a text of fewer than five words has one shingle, its
whole sequence; rows that repeat are nodes of the same set; a row without
doc_id has no component (null); other columns of docs are not read by `classes`
and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discarded, documents, inner, mixed, slices, written
from .components import components
from .sets import MOST_BROADCAST, confirmed, digest, shingle_sets, sketch

SHINGLE, PERCENT = 5, 75
#: One of so many documents (by digest) is counted for the order of shingles; a shingle found in so many of them counts
#: as heavy; and at most so many heavy ones are known by name (8 bytes each in every task).
SAMPLE, HEAVY, MOST_HEAVY = 16, 4, 250_000
#: Rounds of leaders.
ROUNDS = 2
#: Largest size that may count as small.
MOST_SMALL = 64


def needed(n: int) -> int:
    """The least overlap of a linked partner with a set of size n."""
    return -(-PERCENT * n // 100)


def prefix(n: int, c: int) -> int:
    return min(n, n - needed(n) + c)


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, n and, for sets that aren't empty, digest, key (its first 64 bits), sketch and, for sampled ones, the shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, digests, keys, sketches, sampled = [], [], [], [], []
            for s in shingle_sets(batch.column(1), SHINGLE):
                n.append(len(s))
                d = digest(s) if len(s) else None
                digests.append(d)
                keys.append(int.from_bytes(d[:8], "big", signed=True) if d else None)
                sketches.append(sketch(s) if len(s) else None)
                sampled.append(s.view(np.int64) if d and d[15] % SAMPLE == 0 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary()), pa.array(sampled, pa.list_(pa.int64()))],
                names=["doc_id", "n", "digest", "key", "sketch", "sampled"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, key long, sketch binary, sampled array<long>")


def boundary(sizes: dict[int, int], length: float) -> int:
    """The size up to which sets count as small: least postings plus list scans, where an inverted list has `length` other sets."""

    def cost(b: int) -> float:
        subsets = sum(k * prefix(n, 2) * (prefix(n, 2) - 1) / 2 for n, k in sizes.items() if 2 <= n <= b)
        lists = sum(k * prefix(n, 1) * (1 + length) for n, k in sizes.items() if n >= needed(b + 1))
        return subsets + lists

    return min(range(1, MOST_SMALL + 1), key=cost)


def _postings(docs: DataFrame, heavy: np.ndarray, small: int) -> DataFrame:
    """list (a hash), key, n and at: where each node is found, and the place of the (first) shingle in its order; and whether all shingles of the list are heavy."""
    reach = needed(small + 1)  # the least set that a large one can link with

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a task posts equal sets once
        for batch in slices(batches, "text"):
            lists, keys, sizes, places, hot = [], [], [], [], []
            for s in shingle_sets(batch.column(0), SHINGLE):
                n = len(s)
                if n < 2:  # a set of one links with its equals only, and those are one node
                    continue
                key = int.from_bytes(digest(s)[:8], "big", signed=True)
                if key in seen:
                    continue
                seen.add(key)
                if len(heavy):
                    is_heavy = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
                    ordered, first_heavy = np.concatenate((s[~is_heavy], s[is_heavy])), n - int(np.count_nonzero(is_heavy))
                else:
                    ordered, first_heavy = s, n
                made, at = [], []
                if n <= small:
                    p = ordered[: prefix(n, 2)]
                    i, j = np.array(list(combinations(range(len(p)), 2))).T
                    made.append(mixed(np.minimum(p[i], p[j]) + mixed(np.maximum(p[i], p[j]))))
                    at.append(i)
                if n >= reach:
                    made.append(ordered[: prefix(n, 1)])
                    at.append(np.arange(prefix(n, 1)))
                made = np.concatenate(made)
                lists.append(made)
                keys.append(np.full(len(made), key, np.int64))
                sizes.append(np.full(len(made), n, np.int32))
                places.append(np.concatenate(at).astype(np.int32))
                hot.append(places[-1] >= first_heavy)  # the least place of a list's shingles: the other one is heavy too
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (keys, sizes, places, hot))], names=["list", "key", "n", "at", "hot"])

    return docs.select("text").mapInArrow(run, "list long, key long, n int, at int, hot boolean")


#: SQL: sizes n and m allow a link, and so do the places at which two sets meet. If it is their first common shingle, the
#: overlap is no more than what either set has from there on; and linked sets do meet in the list of their first one.
_MEET = f"100 * least(n, m) >= {PERCENT} * greatest(n, m) AND {100 + PERCENT} * least(n - at, m - met) >= {PERCENT} * (n + m)"


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id: one row for each row of docs."""
    docs = inner(docs)[0].select("doc_id", "text")
    rows = written(_nodes(docs), "rows")
    nodes = written(rows.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    counted = rows.where("sampled IS NOT NULL").dropDuplicates(["key"]).select(F.explode("sampled").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("k"))
    counted = written(counted.where("k > 1"), "shared")
    heavy = np.array([r["shingle"] for r in counted.where(f"k >= {HEAVY}").orderBy(F.desc("k"), "shingle").limit(MOST_HEAVY).collect()], np.int64).view(np.uint64)
    sizes = {r["n"]: r["count"] for r in nodes.select(F.least("n", F.lit(4 * MOST_SMALL)).alias("n")).groupBy("n").count().collect()}
    light = counted.where(f"k < {HEAVY}").agg(F.sum(F.col("k") * (F.col("k") - 1))).first()[0] or 0
    total = rows.where("sampled IS NOT NULL").agg(F.sum("n")).first()[0] or 1
    small = boundary(sizes, SAMPLE * light / total)

    # Postings of lists with one node go. Lists of heavy shingles have more than one for sure: theirs are spread by key and stay.
    posted = _postings(docs, np.sort(heavy), small).withColumn("spread", F.when(F.col("hot"), F.col("key")))
    lists = Window.partitionBy("list", "spread")
    shared = posted.withColumn("least", F.min("key").over(lists)).withColumn("most", F.max("key").over(lists)).where("hot OR least <> most")
    table = written(shared.select("list", "spread", "key", "n", "at").distinct().drop("spread"), "postings")
    placed = table.withColumn("component", F.col("key"))
    compared = links = found = None
    for k in range(ROUNDS + 1):
        if k < ROUNDS:
            # Keys are random numbers, so their low bits part equal ranks.
            by_lists = F.count(F.lit(1)).over(Window.partitionBy("key")) if k == 0 else F.lit(0)
            ranked = placed.withColumn("rank", by_lists * (1 << 40) + F.col("key").bitwiseAND((1 << 40) - 1))
            best = ranked.groupBy("list").agg(F.max("rank").alias("rank"))
            leaders = ranked.join(best, ["list", "rank"]).select("list", F.col("key").alias("leader"), F.col("component").alias("to"), F.col("n").alias("m"), F.col("at").alias("met"))
            pairs = placed.join(leaders, "list").where(f"component <> to AND {_MEET}").select("key", "leader")
        else:
            b = placed.select("list", F.col("key").alias("leader"), F.col("component").alias("to"), F.col("n").alias("m"), F.col("at").alias("met"))
            pairs = placed.join(b, "list").where(f"component > to AND {_MEET}").select("key", "leader")
        pairs = pairs.select(F.greatest("key", "leader").alias("u"), F.least("key", "leader").alias("v")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["u", "v"], "left_anti")
        tried, new = confirmed(docs, nodes.withColumnRenamed("key", "node"), pairs, SHINGLE, PERCENT, f"round-{k}")
        compared, links = (tried, new) if compared is None else (compared.unionByName(tried), links.unionByName(new))
        found = components(links)
        if k < ROUNDS:
            placed = placed.drop("component").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
            # Lists that still hold more than one component.
            still = placed.groupBy("list").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("list")
            old, table = table, written(placed.join(still, "list", "left_semi"), "open")
            placed = table
            discarded(old)

    ids = nodes.select("key", "digest", "doc_id")
    joined = ids.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = joined.join(least, "component").select("digest", "component_id")
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of docs with the least doc_id of each class, with its columns; rows without doc_id stay, of rows that repeat one does."""
    rows, names = inner(docs)
    kept = classes(rows).where("doc_id = component_id").groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("again"))
    kept = written(kept, "kept")
    few = kept.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    with_id = rows.join(F.broadcast(kept) if few else kept, "doc_id").select(*rows.columns, "again")
    out = with_id.where("NOT again").drop("again").unionByName(rows.where("doc_id IS NULL"))
    if kept.where("again").limit(1).count():
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        out = out.unionByName(with_id.where("again").withColumn("number", number).where("number = 1").drop("again", "number"))
    return out.toDF(*names)


def op5_jaccard_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
