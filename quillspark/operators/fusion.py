"""Rank fusion, near-duplicate removal, and retrieval as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..sources import tables


def fused(lists: list[DataFrame], best_first: bool = True) -> DataFrame:
    """query_id, doc_id, best, total and position (0 ...) from ranked lists (query_id, doc_id, rank).

    Each rank counts 1 / (60 + rank). By best rank and then sum, or by the sum
    alone; ties go to the document seen first, list by list.
    """
    rows = [x.select("query_id", "doc_id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more)
    share = 1 / (K.RRF_K + F.col("rank"))
    out = union.groupBy("query_id", "doc_id").agg(F.max(share).alias("best"), F.sum(share).alias("total"), F.min(F.col("list") * 1_000_000_000 + F.col("rank")).alias("seen"))
    order = [F.round("best", 9).desc()] * best_first + [F.round("total", 9).desc(), F.col("seen")]
    return out.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def deduped(candidates: DataFrame, threshold: float = K.DEDUPE) -> DataFrame:
    """candidates (query_id, position, text and more) without those that are nearly like a better one that is kept; without text.

    A query's candidates are few (two lists of 30 at most), so they are folded
    as one array. Tokens are compared as 64-bit hashes, and only where the sizes
    of the sets allow the threshold.
    """
    payload = [c for c in candidates.columns if c not in ("query_id", "text")]
    if threshold >= 1:
        return candidates.select("query_id", *payload)
    hashes = F.transform(F.array_distinct(T.tokens(F.col("text"))), lambda t: F.xxhash64(t))
    rows = tables.spread(candidates).select("query_id", *payload, hashes.alias("__hashes"))
    one = F.struct("position", "__hashes", *(c for c in payload if c != "position"))
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("all"))

    def alike(x: Column, y: Column) -> Column:
        a, b = F.size(x["__hashes"]), F.size(y["__hashes"])
        shared = F.size(F.array_intersect(x["__hashes"], y["__hashes"]))
        return F.when((F.least(a, b) > 0) & (F.least(a, b) >= threshold * F.greatest(a, b)), shared / (a + b - shared) >= threshold).otherwise(F.lit(False))

    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda kept, x: F.when(F.exists(kept, lambda y: alike(x, y)), kept).otherwise(F.concat(kept, F.array(x))))
    return grouped.select("query_id", F.explode(kept).alias("x")).select("query_id", *(f"x.{c}" for c in payload))
