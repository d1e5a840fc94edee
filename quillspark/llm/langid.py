"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every training text in Spark tasks (partial
counts for each language and bucket, summed by a shuffle); the log-probability
matrix has a fixed number of buckets and one column for each language, so it is
small whatever the corpus, and is broadcast. More than `BLOCK_LANGUAGES` languages
make several matrices, which the texts pass one after the other. Scoring is a
product of a batch's sparse n-gram counts and the matrix, in numpy.

Only text and lang of training rows are used to learn; a prediction sees the
text alone. Defined results: a null text, and one without a letter, is `und`
with score 0; without any training row every text is `und`; ties go to the
alphabetically first language; repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, documents, inner, slices, written

#: Buckets of the hashed n-grams, and n-gram lengths in characters.
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
#: Additive smoothing of the counts.
SMOOTHING = 0.5
#: Languages of a block (a matrix of 128 MB at most); those that a task counts before it sends its sums on; matrix cells
#: that a text's product takes at once.
BLOCK_LANGUAGES, TASK_LANGUAGES, CELLS = 1000, 500, 1 << 22
UNKNOWN = "und"

_MULTIPLIER = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _grams(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams of lower-cased, space-padded texts, text by text, and where each text's begin and end."""
    padded = [f" {t.lower()} " if t else "  " for t in texts]
    letters = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letters[letters < 65] = 32  # digits, marks and white space say nothing about a language
    lengths = np.array([len(p) for p in padded], np.int64)
    owner = np.repeat(np.arange(len(padded)), lengths)
    out = []
    for n in ORDERS:
        h = np.full(max(0, len(letters) - n + 1), n, np.uint32)
        for k in range(n):
            h = (h ^ letters[k : len(letters) - n + 1 + k]) * _MULTIPLIER[k]
            h ^= h >> np.uint32(15)
        same = owner[: len(h)] == owner[n - 1 :]
        out.append(((h % np.uint32(BUCKETS))[same].astype(np.int32), np.concatenate(([0], np.cumsum(np.maximum(lengths - n + 1, 0))))))
    return out


def counts(rows: DataFrame) -> DataFrame:
    """lang, bucket and n for rows of text and lang: each task adds its own up before the shuffle."""

    def summed(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["lang", "bucket", "n"])
        total.clear()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            groups: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                groups.setdefault(lang, []).append(text)
            for lang, texts in groups.items():
                total[lang] = total.get(lang, 0) + np.bincount(np.concatenate([b for b, _ in _grams(texts)]), minlength=BUCKETS)
                if len(total) > TASK_LANGUAGES:
                    yield from summed(total)
        yield from summed(total)

    parts = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    """A block of languages and their log-probability matrix (buckets x languages)."""

    names: list[str]
    matrix: np.ndarray


def fitted(rows: DataFrame) -> list[Languages]:
    """Blocks of languages in alphabetical order; every language counts as equally likely beforehand.

    The driver takes the names of all languages and, in turn, each block's
    matrix, of which a task made every column.
    """
    found = written(counts(rows), "language-counts")

    def column(pdf: pd.DataFrame) -> pd.DataFrame:  # one language: BUCKETS rows at most
        n = np.full(BUCKETS, SMOOTHING)
        n[pdf["bucket"]] += pdf["n"]
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "weights": [np.log(n / n.sum()).astype(np.float32).tobytes()]})

    columns = written(found.groupBy("lang").applyInPandas(column, "lang string, weights binary"), "languages")
    names = [r["lang"] for r in columns.select("lang").orderBy("lang").collect()]
    out = []
    for k in range(0, len(names), BLOCK_LANGUAGES):
        block = names[k : k + BLOCK_LANGUAGES]
        weights = {r["lang"]: np.frombuffer(r["weights"], np.float32) for r in columns.where(F.col("lang").between(block[0], block[-1])).toLocalIterator()}
        out.append(Languages(block, np.stack([weights[x] for x in block], axis=1)))
    discarded(found, columns)
    return out


def sums(texts: list[str | None], matrix: np.ndarray) -> np.ndarray:
    """Texts x languages: the product of each text's sparse n-gram counts and the matrix."""
    grams = _grams(texts)
    out = np.zeros((len(texts), matrix.shape[1]))
    step = max(1, CELLS // max(1, matrix.shape[1]))
    for i in range(len(texts)):
        found = np.bincount(np.concatenate([buckets[at[i] : at[i + 1]] for buckets, at in grams]), minlength=BUCKETS)
        used = np.flatnonzero(found)
        for k in range(0, len(used), step):  # a bounded part of the matrix at once
            rows = used[k : k + step]
            out[i] += found[rows] @ matrix[rows]
    return out


#: What is known of a text after some blocks: best language, its sum, and over all languages the sum of exp((sum - best sum) / root of the n-grams).
_STATE = "lang string, best double, rest double"


def _step(languages: Languages, first: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            found = sums(texts, languages.matrix)
            root = np.sqrt([3 * len(t or "") + 3 for t in texts])  # its n-grams
            at = found.argmax(axis=1)
            best = found[np.arange(len(texts)), at]
            # n-grams overlap and are far from independent: the posterior is taken at the evidence of the text's root.
            rest = np.exp((found - best[:, None]) / root[:, None]).sum(axis=1)
            names = np.array(languages.names, object)[at]
            if not first:
                old_names, old, old_rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                keep = old >= best  # ties go to the earlier block
                top = np.where(keep, old, best)
                rest = old_rest * np.exp((old - top) / root) + rest * np.exp((best - top) / root)
                names, best = np.where(keep, old_names, names), top
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(rest, pa.float64())], names=["doc_id", "text", "lang", "best", "rest"])

    return run


def predicted(docs: DataFrame, model: list[Languages]) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs; each block of languages is one step over the texts in the same task."""
    rows = inner(docs)[0].select("doc_id", "text")
    for k, languages in enumerate(model):
        rows = rows.mapInArrow(_step(languages, k == 0), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, {_STATE}")
    known = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)) if model else F.lit(False)
    lang, score = (F.col("lang"), 1 / F.col("rest")) if model else (F.lit(UNKNOWN), F.lit(0.0))
    return rows.select("doc_id", F.when(known, lang).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(known, score).otherwise(F.lit(0.0)).alias("score"))


def op10_langid_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return predicted(docs, fitted(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
