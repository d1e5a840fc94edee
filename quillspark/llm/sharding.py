"""Sharding along a Hilbert curve.

Language, source and size are quantised to 16 steps each; the cell's place on a
three-dimensional Hilbert curve orders the documents, and equal runs of that
order are the shards, so a shard holds few languages, sources and sizes and a
reader can skip files by any of them. Law `rows`: shards differ by one row at
most.

The global place of a row is the rows in earlier cells, plus those in earlier
buckets of its cell, plus its number inside its bucket: cells are counted first
(there is a fixed number of them), each gets as many buckets as its rows need,
and these are counted, so neither a hot cell nor the whole table is ever sorted
by one task. Only ids
and sizes are shuffled, never texts.

Defined results: null lang, source or text have a step of their own (0) and a
null text has size 16 and crc32 0; null doc_ids come first in their bucket;
repeated rows each get a slot; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

SHARDS = 40
#: Bits of each of the three dimensions; rows that a bucket of a cell has on average at most.
BITS, BUCKET_ROWS = 4, 100_000
#: A cell's first buckets are smaller, so that a small table's largest cell is spread too: one for so many rows, up to so many.
FIRST_ROWS, FIRST_BUCKETS = 500, 255


def hilbert_index(point: list[int], bits: int) -> int:
    """Place of a point on the Hilbert curve, by Skilling's transpose algorithm."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def curve_place(steps: list[Column]) -> Column:
    """The Hilbert index of a cell, looked up in a table of all cells (2 ** (3 * BITS) of them) that the rule above makes."""
    side = 1 << BITS
    table = ",".join(str(hilbert_index([a, b, c], BITS)) for a in range(side) for b in range(side) for c in range(side))
    code = (steps[0] * side + steps[1]) * side + steps[2]
    return F.element_at(F.split(F.lit(table), ",").cast("array<int>"), (code + 1).cast("int"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, cell, shard and slot of every row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    step = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(c), F.lit((1 << BITS) - 1))).cast("int")
    length = F.least(F.floor(F.log2(size)) - 3, F.lit((1 << BITS) - 1)).cast("int")
    rows = docs.select(
        "doc_id",
        size.alias("size"),
        F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long").alias("text_crc32"),
        curve_place([step("lang"), step("source"), length]).alias("cell"),
    )
    rows = written(rows, "shard-rows")  # read again below; without texts
    # At most 2 ** (3 * BITS) cells: small enough to broadcast and for one window at every size.
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    of = rows.join(F.broadcast(cells.select("cell", (F.ceil(F.col("n") / BUCKET_ROWS) + F.least(F.lit(FIRST_BUCKETS), F.floor(F.col("n") / FIRST_ROWS))).alias("buckets"))), "cell")
    rows = of.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("buckets")).cast("int")).drop("buckets")
    counts = rows.groupBy("cell", "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    cells = cells.select("cell", (F.sum("n").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("cell_start"), F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.join(cells, "cell").select("cell", "bucket", (F.col("cell_start") + F.sum("n").over(inside) - F.col("n")).alias("start"), "total")
    number = F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("doc_id", "text_crc32", "size"))
    place = rows.withColumn("number", number).join(starts, ["cell", "bucket"]).withColumn("place", F.col("start") + F.col("number") - 1)
    shard = F.expr(f"place * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return place.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "cell", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).cast("long").alias("slot"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")
