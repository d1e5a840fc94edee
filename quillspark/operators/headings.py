"""The lines of texts under the headings above them, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import lines

LEVELS = range(1, 7)


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), text, start_char, end_char and path of each line that is neither blank nor a heading.

    A heading is in the path of a line as long as no heading of its level or a
    higher one stands in between: for each level the last heading counts, if it
    is later than those of the levels above it.
    """
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = lines(docs.select("doc_id", "text")).withColumn("bare", bare).withColumn("title", F.regexp_extract(bare, r"^#{1,6}\s+(.*\S)\s*$", 1))
    level = F.when(F.col("title") != "", F.length(F.regexp_extract("bare", "^#+", 0)))
    rows = rows.select("doc_id", "line", "start", "text", "bare", "title", level.alias("level"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("line", "title")), ignorenulls=True).over(before).alias(f"h{k}") for k in LEVELS]
    rows = rows.select("*", *last).where("level IS NULL AND bare <> ''")
    at = lambda k: F.coalesce(F.col(f"h{k}.line"), F.lit(-1))
    above = lambda k: F.greatest(F.lit(-1), *(at(j) for j in range(1, k))) if k > 1 else F.lit(-1)
    path = F.concat_ws(" > ", *(F.when(at(k) > above(k), F.col(f"h{k}.title")) for k in LEVELS))
    start = F.col("start") + F.length("text") - F.length(F.regexp_replace("text", r"(?U)^\s+", ""))
    return rows.select("doc_id", "line", F.col("bare").alias("text"), start.alias("start_char"), (start + F.length("bare")).alias("end_char"), F.nullif(path, F.lit("")).alias("path"))
