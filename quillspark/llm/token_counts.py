"""Exact token length histogram with suffix sums.

One row for each encoded length that occurs: how many documents have it, and,
from sums over all longer and all shorter lengths, what a context limit of that
length would give: documents that fit, documents that are cut, tokens in all,
tokens kept when longer documents are cut, and the share of documents up to it
(every exact quantile reads off that column).

Sums over lengths run in two levels (blocks of lengths, then inside a block),
so no task ever holds all lengths. Defined results: null and empty texts have
length 0; repeated rows count each; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import MonoidBpe, public_ranks
from .common import documents, slices, written

#: Lengths in a block.
BLOCK = 256


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens of every row. (Not by the tokeniser library's own splitting: it overflows its stack on a million blanks in a row.)"""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = MonoidBpe.from_file(path, pattern)
        for batch in slices(batches, "text"):
            n = [bpe.count(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Lengths (n_tokens) counted, with the answers for a limit of each length."""
    counted = written(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")  # read three times below; texts are encoded once
    counts = counted.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    # Blocks of blocks keep the top window small: one row for each 65,536 lengths.
    tops = blocks.groupBy(F.floor(F.col("block") / BLOCK).alias("top")).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    top_order = Window.partitionBy(F.lit(0)).orderBy("top")
    everything = Window.partitionBy(F.lit(0))
    tops = tops.select(
        "top",
        F.coalesce(F.sum("docs").over(top_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("top_docs"),
        F.coalesce(F.sum("tokens").over(top_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("top_tokens"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("top").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("top", F.floor(F.col("block") / BLOCK))
        .join(tops, "top")
        .select(
            "block",
            (F.col("top_docs") + F.coalesce(F.sum("docs").over(inside), F.lit(0))).alias("block_docs"),
            (F.col("top_tokens") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("block_tokens"),
            "all_docs",
            "all_tokens",
        )
    )
    inside = Window.partitionBy("block").orderBy("n_tokens")
    out = counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("block_docs") + F.sum("n_docs").over(inside)).alias("docs_within"),
        (F.col("block_tokens") + F.sum(tokens).over(inside)).alias("tokens_within"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_within",
        (F.col("all_docs") - F.col("docs_within")).alias("docs_beyond"),
        "tokens_within",
        (F.col("all_tokens") - F.col("tokens_within")).alias("tokens_beyond"),
        (F.col("tokens_within") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_within"))).alias("tokens_truncated"),
        "all_docs",
        "all_tokens",
        (F.col("docs_within") / F.col("all_docs")).alias("share_within"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit, whether a document has that length or not: total and truncated tokens, documents cut."""
    kept = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return hist.agg(
        F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("tokens_truncated"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of all documents does not exceed."""
    return hist.where(F.col("docs_within") >= F.col("all_docs") * q).agg(F.min("n_tokens").alias("n_tokens"))


def op4_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(documents(spark, sf_dir), *public_ranks()))
