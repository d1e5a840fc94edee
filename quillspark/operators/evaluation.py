"""Evaluation of retrieval, and the health of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import constants as K
from ..functions import text as T


def judged(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, text, answer) with `relevant`: the answer, or one of an array of answers, stands in the text, white space, case and Unicode form aside."""
    several = isinstance(hits.schema["answer"].dataType, ArrayType)
    needles = F.split(T.squashed(F.array_join("answer", "\x01")), "\x01") if several else F.array(T.squashed(F.col("answer")))
    rows = hits.select("*", T.squashed(F.col("text")).alias("__text"), needles.alias("__needles"))
    return rows.withColumn("relevant", F.exists("__needles", lambda n: F.contains(F.col("__text"), n))).drop("__text", "__needles")


def expected(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """judged hits (query_id, doc_id, relevant), relevant only where the document is expected too (query_id, doc_id)."""
    marked = hits.join(expected.select("query_id", "doc_id").distinct().withColumn("__expected", F.lit(True)), ["query_id", "doc_id"], "left")
    return marked.withColumn("relevant", F.col("relevant") & F.col("__expected").isNotNull()).drop("__expected")


def misses(scored: DataFrame) -> DataFrame:
    """Questions without a hit (`per_query` rows)."""
    return scored.where("first_hit IS NULL")


def flagged_share(hits: DataFrame) -> DataFrame:
    """One row: the shares of all retrieved hits (text) that are boilerplate or citation-like; 0 if there are none."""
    share = lambda c: F.coalesce(F.round(F.avg(c.cast("double")), 6), F.lit(0.0))
    return hits.agg(F.count(F.lit(1)).alias("retrieved"), share(contains_any(F.col("text"), K.BOILERPLATE)).alias("boilerplate"), share(contains_any(F.col("text"), K.EVALUATED_MARKS, 2)).alias("citation_like"))


def per_query(hits: DataFrame) -> DataFrame:
    """One row for each query: hit at 1, 3, 5 and 10, precision at 5, reciprocal rank to 10, first hit's rank (null: a miss)."""
    hit = lambda k: F.max(F.when((F.col("rank") <= k) & F.col("relevant"), 1).otherwise(0)).alias(f"hit_{k}")
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    top = F.count(F.when(F.col("rank") <= 5, 1))
    return hits.groupBy("query_id").agg(
        *(hit(k) for k in (1, 3, 5, 10)),
        F.coalesce(F.try_divide(F.count(F.when((F.col("rank") <= 5) & F.col("relevant"), 1)), top), F.lit(0.0)).alias("precision_5"),
        F.coalesce(F.when(first <= 10, 1.0 / first), F.lit(0.0)).alias("rr_10"),
        first.alias("first_hit"),
    )


def summary(scored: DataFrame, *slices: str) -> DataFrame:
    """Means over all queries, and over each slice if columns are named."""
    means = [F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 6).alias(c.replace("hit", "recall")) for c in ("hit_1", "hit_3", "hit_5", "hit_10", "precision_5", "rr_10"))]
    return scored.groupingSets([[], list(slices)], *slices).agg(*means) if slices else scored.agg(*means)


def percentiles(rows: DataFrame, column: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """Nearest-rank percentiles of each group: the value at place round-half-even(share * (n - 1)).

    Equal values are counted before they meet, so a task sees a group's distinct values only.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__k"))
    window = Window.partitionBy(*(by or [F.lit(0)]))
    placed = counted.withColumn("__to", F.sum("__k").over(window.orderBy(column))).withColumn("__n", F.sum("__k").over(window))
    return placed.groupBy(*by).agg(*(F.min(F.when(F.col("__to") > F.bround(F.lit(s) * (F.col("__n") - 1), 0), F.col(column))).alias(f"p{round(100 * s)}") for s in shares))


def contains_any(text: Column, marks: tuple[str, ...], least: int = 1) -> Column:
    low = F.lower(text)
    found = F.filter(F.array(*(F.lit(m) for m in marks)), lambda m: F.contains(low, m))
    return F.size(found) >= least


def health(chunks: DataFrame, size: int = K.CHUNK_SIZE) -> DataFrame:
    """One row about chunks (text, heading): number, lengths, shares of tiny, oversized, boilerplate and citation-like ones and of those under a heading."""
    n = F.length("text")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    shares = chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.max(n).cast("long").alias("longest"),
        share(n < K.LEAST_CHUNK).alias("tiny"),
        share(n > 2 * size).alias("oversized"),
        share(contains_any(F.col("text"), K.BOILERPLATE)).alias("boilerplate"),
        share(contains_any(F.col("text"), K.EVALUATED_MARKS, 2)).alias("citation_like"),
        share(F.coalesce(F.col("heading") != "", F.lit(False))).alias("with_heading"),
    )
    lengths = percentiles(chunks.select(n.cast("long").alias("n")), "n", (0.5, 0.95))
    return shares.join(F.broadcast(lengths))  # one row each
