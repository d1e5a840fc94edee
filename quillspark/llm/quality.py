"""Quality rules and a log-likelihood ratio between trusted and raw text.

Base rules look at words, symbols and repeats inside a text. The method compares
two multinomials over hashed word n-grams: one of trusted documents (labelled
quality 1), one of the whole raw corpus. A document's mean log-likelihood ratio
per n-gram, a number that doesn't grow with length, must reach `THRESHOLD`.

Everything runs in Spark's own expressions. The two multinomials are counted
over all documents (partial counts in each task, `2 * BUCKETS` sums in all) and
come back as one array of `BUCKETS` weights, of fixed size whatever the corpus.

Defined results: a null or empty text has no words and fails the base rules; a
text without an n-gram has ratio 0; without a trusted document all weights are
0; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Hash buckets of the n-grams (single words and pairs).
BUCKETS = 8192
#: A document is kept if its mean log ratio is at least this.
THRESHOLD = -0.04
#: Added to every bucket's count, as a share of the mean count.
SMOOTHING = 0.1
#: Trusted ids up to this many are broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def hashed(words: str = "words") -> Column:
    return F.expr(f"transform({words}, w -> xxhash64(w))")


def grams(hashes: str = "hashes") -> Column:
    """Buckets of all words and pairs of neighbours; hashes: name of a column of word hashes."""
    one = f"transform({hashes}, h -> cast(pmod(h, {BUCKETS}) as int))"
    two = f"transform({hashes}, (h, i) -> cast(pmod(xxhash64(h, get({hashes}, i + 1)), {BUCKETS}) as int))"
    return F.expr(f"concat({one}, slice({two}, 1, greatest(size({hashes}) - 1, 0)))")


def base_columns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `hashes` of the words and the base rules' columns."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", "text", words().alias("words")).select("doc_id", "text", hashed().alias("hashes"))
    # Word triples as 64-bit hashes; those of a text that repeats one are sorted with their places, so that equal triples are neighbours.
    rows = rows.withColumn("triples", F.expr("transform(slice(hashes, 1, greatest(size(hashes) - 2, 0)), (h, i) -> xxhash64(h, get(hashes, i + 1), get(hashes, i + 2)))"))
    rows = rows.withColumn("sorted", F.expr("if(size(array_distinct(triples)) = size(triples), array(), sort_array(transform(triples, (h, i) -> struct(h as h, i as i))))"))
    rows = rows.withColumn("places", F.expr("sort_array(transform(filter(sorted, (x, k) -> get(sorted, k - 1).h = x.h or get(sorted, k + 1).h = x.h), x -> x.i))"))
    # A repeated triple covers three words, or as many as there are before the next one.
    covered = "aggregate(transform(places, (p, k) -> least(3, coalesce(get(places, k + 1) - p, 3))), 0L, (n, x) -> n + x)"
    return rows.select(
        "doc_id",
        "hashes",
        F.size("hashes").cast("long").alias("n_words"),
        F.coalesce(F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]")), F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """For each bucket the log of its trusted share over its raw share."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("trusted", F.lit(1))
    small = trusted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = docs.select("doc_id", words().alias("words")).select("doc_id", hashed().alias("hashes")).join(F.broadcast(trusted) if small else trusted, "doc_id", "left")
    found = rows.select("trusted", F.explode(grams()).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("trusted")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in found:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["trusted"]
    if not sum(good):
        return [0.0] * BUCKETS
    share = lambda n: [(x + SMOOTHING * sum(n) / BUCKETS) / (sum(n) * (1 + SMOOTHING)) for x in n]
    return [math.log(a / b) for a, b in zip(share(good), share(raw), strict=True)]


def judged(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: the base columns, `llr` and `kept`."""
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    based = base_columns(docs).withColumn("grams", grams())
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    out = based.withColumn("llr", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0)))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judged(docs, log_ratios(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
