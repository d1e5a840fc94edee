"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on
the words of toxic text that ordinary text hardly has, as large as they need (on
windows of toxic text it hardly tells the kinds apart, see the README). A window (a few words) is
compressed once with the ordinary dictionary and once with the toxic one laid on
top of it; the bytes that the toxic dictionary saves are its distance. A text's
score is a logistic function, calibrated on labelled texts, of how many windows
save at least 1, 2, ... bytes.

Learning takes a bounded sample of labelled rows (`MOST_TOXIC`, `MOST_ORDINARY`
texts of at most `MOST_BYTES` bytes, chosen by a hash of doc_id), of which one of
each group that shares its least word triple is kept, so that groups of copies
don't decide what is telling; scoring takes
every text whole. Only texts and labels.toxic are used to learn; the score sees
the text alone.

Defined results: a null or empty text has score 0; if no text of either kind
is labelled, every score is 0; with fewer labelled texts of a kind than parts there
are fewer parts, with one the dictionaries' own texts; rows that repeat are scored each; a document
labelled twice counts as toxic if one label says so; other columns of docs are
kept by `without_toxic` and not read.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, inner, slices

#: Bounds of the learning sample.
MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 1500, 3000, 20_000
#: Words in a window; bytes of the ordinary dictionary, and of the toxic one at least: it grows with its words.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 5, 8192, 1024
#: A word is telling if this share of the toxic texts, and one more, has it, and so many times the share of ordinary texts.
TELLING_SHARE, TELLING_RATIO = 0.015, 20
#: Saved bytes that are counted: windows that save at least 1, 2, ... of them.
STEPS = 7
#: Parts for calibration; samples that the trainer of the toxic dictionary gets at least.
FOLDS, LEAST_SAMPLES = 3, 40_000
THRESHOLD = 0.7

_LOWER = bytes(range(256)).lower()


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def windows(text: str) -> list[bytes]:
    words = _words(text)
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * STEPS + 2))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(2 * STEPS + 1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(2 * STEPS + 1))

    def __post_init__(self) -> None:
        self._pair: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None}  # compressors stay where they are

    def _compressors(self) -> tuple:
        if self._pair is None:
            parameters = zstandard.ZstdCompressionParameters(window_log=17, chain_log=15, hash_log=15, search_log=6, min_match=3, target_length=24, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False)
            made = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                content = zstandard.ZstdCompressionDict(content.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(compression_params=parameters)
                made.append(zstandard.ZstdCompressor(dict_data=content, compression_params=parameters).compress)
            self._pair = tuple(made)
        return self._pair

    def saved(self, text: str) -> list[int]:
        """Bytes that the toxic dictionary saves, for each window."""
        plain, toxic = self._compressors()
        return [len(plain(w)) - len(toxic(w)) for w in windows(text)]

    def features(self, text: str) -> np.ndarray:
        saved = np.array(self.saved(text) or [0])
        found = np.bincount(np.clip(saved, 0, STEPS), minlength=STEPS + 1)[::-1].cumsum()[::-1][1:].astype(float)
        return np.concatenate([np.log1p(found), found / len(saved), [np.log1p(len(saved))]])

    def score(self, text: str | None) -> float:
        if not text or not self.toxic:
            return 0.0
        z = float(((self.features(text) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _trained(size: int, pieces: list[bytes]) -> bytes:
    """A dictionary's content; if there are too few pieces to choose from, the pieces themselves."""
    try:
        return zstandard.train_dictionary(size, [b"".join(pieces[i : i + 8]) for i in range(0, len(pieces), 8)], k=64, d=6, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(pieces))[:size]


def _distinct(texts: list[str]) -> list[str]:
    """One text of each group of near copies that share their least word triple, so that groups don't decide what is telling."""
    kept: dict[int, str] = {}
    for text in texts:
        words = _words(text)
        kept.setdefault(min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0), text)
    return list(kept.values())


def dictionaries(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """A model with its two dictionaries, yet without weights."""
    chance = random.Random(0)
    has = [Counter(w for t in texts for w in set(_words(t))) for texts in (toxic, ordinary)]
    n, m = len(toxic), len(ordinary)
    telling = {w for w, k in has[0].items() if k >= max(2, 1 + TELLING_SHARE * n) and k / n > TELLING_RATIO * (has[1][w] + 0.5) / m}
    telling = telling or {w for w, k in has[0].items() if not has[1][w]}
    found = sorted(b" " + w + b" " for t in toxic for w in _words(t) if w in telling)
    chance.shuffle(found)
    plain = [w for t in ordinary for w in windows(t)]
    chance.shuffle(plain)
    if not found or not plain:
        return ToxicityModel()
    # The trainer wants many samples: the words are repeated until there are enough.
    content = _trained(max(TOXIC_BYTES, sum(map(len, set(found)))), found * (1 + LEAST_SAMPLES // len(found)))
    missing = b"".join(w for w in sorted(set(found)) if w not in content)
    return ToxicityModel(_trained(ORDINARY_BYTES, plain), missing + content)


def fitted(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """The model of labelled texts: each part of them is calibrated on with dictionaries that come from the other parts, whatever their number."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    model = dictionaries(toxic, ordinary) if toxic and ordinary else ToxicityModel()
    if not model.toxic:
        return model
    folds = min(FOLDS, len(toxic), len(ordinary))
    rows, y = [], []
    for k in range(folds):
        others = [[t for i, t in enumerate(texts) if folds == 1 or i % folds != k] for texts in (toxic, ordinary)]
        other = dictionaries(*others)
        for label, texts in ((1.0, toxic[k::folds]), (0.0, ordinary[k::folds])):
            rows += [(other if other.toxic else model).features(t) for t in texts]
            y += [label] * len(texts)
    x, y = np.array(rows), np.array(y)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    weight = np.where(y == 1, 1 / 3 / y.mean(), 2 / 3 / (1 - y.mean()))  # as if one text in three were toxic
    w, ridge = np.zeros(a.shape[1]), 0.3 * np.r_[np.ones(a.shape[1] - 1), 1e-3]

    def loss(v: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ v))).sum() + (ridge * v * v).sum() / 2)

    for _ in range(100):  # Newton steps of ridge logistic regression, halved until they help
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (weight * (p - y)) + ridge * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    model.weights = w
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model from a bounded sample of the labelled rows that aren't held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(MOST_ORDINARY))
    # At most MOST_TOXIC + MOST_ORDINARY ids: small enough to broadcast at every size.
    docs = docs.select("doc_id", "text")
    sample = docs.where(F.octet_length("text").between(1, MOST_BYTES)).join(F.broadcast(ids), "doc_id")
    rows = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"]))
    return fitted([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def scored(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (doc_id) of every row of docs, and `score`, which no kept column may be called."""
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.col("text").alias("text_to_score"))
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_to_score"):
            scores = [model.score(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns."""
    rows, names = inner(docs)
    return scored(rows, learned(rows, labels), rows.columns).where(F.col("score") < THRESHOLD).drop("score").toDF(*names)


def op2_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = scored(docs, learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
