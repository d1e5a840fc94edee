"""Operators over ordered rows: budgets, gaps, running places, slices of time, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def budget_prefix(rows: DataFrame, by: str, order: str, size: Column, budget: int, joint: int = 2) -> DataFrame:
    """The first row of each group, and the following ones as long as all sizes (with a joint between) fit."""
    window = Window.partitionBy(by).orderBy(order)
    used = F.sum(size + joint).over(window.rowsBetween(Window.unboundedPreceding, 0)) - joint
    numbered = rows.withColumn("used", used).withColumn("__n", F.row_number().over(window))
    return numbered.where((F.col("used") <= budget) | (F.col("__n") == 1)).drop("__n")


def gap_groups(rows: DataFrame, by: str, start: str, end: Column, gap: float, tie: str) -> DataFrame:
    """rows with `part`: a new one (from 0) begins where more than `gap` seconds lie after the previous end."""
    window = Window.partitionBy(by).orderBy(start, tie)
    flagged = rows.withColumn("__end", end).withColumn("__gap", F.coalesce((F.col(start) - F.lag("__end").over(window) > gap).cast("int"), F.lit(0)))
    return flagged.withColumn("part", F.sum("__gap").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__end", "__gap")


#: Lines whose lengths are summed up at once: places are found by the sums of whole groups, then inside a group.
GROUP = 64


def lines(docs: DataFrame, head: bool = False, start: bool = True) -> DataFrame:
    """doc_id, line (from 0), start (character offset; it takes most of the time, so it may be left out), text and of (the document's number of lines) of every line, and head (the document's first line) if asked for. No shuffle: the places come from the array of lines."""
    if not start:
        rows = docs.select("doc_id", F.split("text", "\n").alias("lines"))
        rows = rows.select("doc_id", *[F.get("lines", F.lit(0)).alias("head")] * head, F.size("lines").alias("of"), F.posexplode_outer("lines").alias("line", "text"))
        return rows.where("line IS NOT NULL").select("doc_id", "line", "text", "of", *["head"] * head)
    rows = docs.select("doc_id", F.split("text", "\n").alias("lines")).withColumn("sizes", F.transform("lines", lambda x: F.length(x).cast("long") + 1))
    group = f"aggregate(slice(sizes, g * {GROUP} + 1, {GROUP}), 0L, (a, x) -> a + x)"
    rows = rows.withColumn("groups", F.expr(f"aggregate(sequence(0, size(sizes) div {GROUP}), array(0L), (heads, g) -> array_append(heads, element_at(heads, -1) + {group}))"))
    place = f"get(groups, i div {GROUP}) + aggregate(slice(sizes, (i div {GROUP}) * {GROUP} + 1, i % {GROUP}), 0L, (a, x) -> a + x)"
    first = [F.get("lines", F.lit(0)).alias("head")] * head
    rows = rows.select("doc_id", *first, F.size("lines").alias("of"), F.explode_outer(F.expr(f"transform(lines, (x, i) -> struct(i AS line, {place} AS start, x AS text))")).alias("x"))
    return rows.where("x IS NOT NULL").select("doc_id", "x.line", "x.start", "x.text", "of", *["head"] * head)


def page_of(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks (doc_id, start) with the page (doc_id, page, size) each starts on: the first whose cumulative size (and two) lies beyond, else the last; null without pages.

    Chunks and page ends are put in one order, where a chunk's page is the next end after it.
    """
    by_page = Window.partitionBy("doc_id").orderBy("page")
    ends = pages.select("doc_id", "page", F.sum(F.col("size") + 2).over(by_page.rowsBetween(Window.unboundedPreceding, 0)).alias("__at"))
    marked = chunks.withColumn("__at", F.col("start")).withColumn("__chunk", F.lit(1))
    rows = marked.unionByName(ends.withColumnRenamed("page", "__page").withColumn("__chunk", F.lit(0)), allowMissingColumns=True)
    after = Window.partitionBy("doc_id").orderBy(F.desc("__at"), F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, 0)
    page = F.coalesce(F.min("__page").over(after), F.max("__page").over(Window.partitionBy("doc_id")))
    return rows.withColumn("page", page).where("__chunk = 1").select(*chunks.columns, "page")


def time_slices(chunks: DataFrame, duration: Column) -> DataFrame:
    """chunks (line, and of: their number) with equal slices of a duration: ts_start and ts_end."""
    i = F.col("line")
    return chunks.withColumn("ts_start", F.round(i * duration / F.col("of"), 6)).withColumn("ts_end", F.round((i + 1) * duration / F.col("of"), 6))


def packed(segments: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Segments (by, order, text, start, end) packed in their order: a new part begins where the text would grow over size. by, part, text, start and end.

    How much fits depends on all parts before, so a group's segments are folded as one array.
    """
    rows = segments.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "text", "start", "end"))).alias("all"))
    # Fold: n is what the open part holds so far; a segment is marked where it opens a part.
    grown = "acc.n + length(x.text) > {0} AND acc.n > 0".format(size)
    fold = f"aggregate(all, struct(0 AS n, 0 AS part, cast(array() AS array<int>) AS parts), (acc, x) -> struct(if({grown}, 0, acc.n) + length(x.text) + 1 AS n, if({grown}, acc.part + 1, acc.part) AS part, array_append(acc.parts, if({grown}, acc.part + 1, acc.part)) AS parts))"
    placed = rows.select(by, F.explode(F.arrays_zip("all", F.expr(fold)["parts"].alias("parts"))).alias("x")).select(by, "x.all.*", F.col("x.parts").alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return placed.groupBy(by, "part").agg(F.array_join(ordered, " ").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))


def timeline(scenes: DataFrame, by: str, order: str, seconds: str = "seconds") -> DataFrame:
    """scenes with the second each starts at."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return scenes.withColumn("starts", F.coalesce(F.sum(seconds).over(before), F.lit(0)))


def numbered(rows: DataFrame, by: str, key: str, *then: str) -> DataFrame:
    """rows with their number (from 1) in each group, in order of the keys.

    Rows are numbered in runs, each from where the runs before end: ranges of
    the whole order, of equal size whatever the keys are, so a group of very many
    rows is not one task's. The runs are written, as ranges drawn again may differ.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = written(rows.repartitionByRange(partitions, by, key, *then).withColumn("__run", F.spark_partition_id()), "runs")
    counts = runs.groupBy(by, "__run").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__run").orderBy(key, *then))
    return runs.withColumn("__inside", inside).join(counts, [by, "__run"]).withColumn("number", F.col("__before") + F.col("__inside")).drop("__run", "__inside", "__before")


def tree_layout(leaves: DataFrame) -> DataFrame:
    """root, document and leaf nodes (doc_id, leaf) with x and y: 224 apart by depth, 60 by leaf; a parent stands midway between its first and last child."""
    placed = numbered(leaves, "root", "doc_id", "leaf").withColumn("y", 60.0 * (F.col("number") - 1))
    mid = lambda c: ((F.min(c) + F.max(c)) / 2).alias("y")
    docs = placed.groupBy("root", "doc_id").agg(mid("y"))
    roots = docs.groupBy("root").agg(mid("y"))
    null = F.lit(None)
    return (
        placed.select("root", "doc_id", "leaf", F.lit(448.0).alias("x"), "y")
        .unionByName(docs.select("root", "doc_id", null.cast("string").alias("leaf"), F.lit(224.0).alias("x"), "y"))
        .unionByName(roots.select("root", null.cast("long").alias("doc_id"), null.cast("string").alias("leaf"), F.lit(0.0).alias("x"), "y"))
    )
