"""Spelling variants by finite-state composition.

A vocabulary of words with their counts is compared with itself: the acceptor
of the words, a transducer that makes exactly one edit (a code point inserted,
deleted or replaced), and the acceptor again are composed, and the pairs that
the composition accepts are the near words.

The vocabulary may be too large for one acceptor, so it is cut by initial
states. A pair whose shorter word has l code points and that differs by one
edit has its first l // 2 code points in common or its last l - l // 2 (the
edit cannot touch both). So each word stands, for l = its length and its length
- 1, in the parts of its head and of its tail, and a part's acceptor starts in
the state that the head leads to and ends where the tail begins: it holds what
is in between. A part of more than `MOST_WORDS` words is cut again by the same
rule, one half of the middle at a time; a middle of one code point cannot be
cut, and then its part has no more words than the alphabet allows. No part is
dropped or capped, and no part's words are compared with each other one by one:
the composition walks both acceptors together, in one state until the edit and
in two behind it, and goes on only where both still have a common ending.

A task makes one part's acceptor at a time, minimised as its sorted words are
read. Counting is by built-in functions, before any shuffle of words.

Defined results: null and empty texts have no words; a row without doc_id has no
deletion; rows that repeat count each; a word without a near word has n_near 0
and is its own root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, documents, written

#: A word's code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One of so many pairs of document and run loses a code point.
DELETIONS = 199
#: A form has so many times the occurrences of its word at least.
FORM_RATIO = 5
#: Words of a part at most, as long as it can be cut.
MOST_WORDS = 20_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words; state 0 is the initial one."""

    def __init__(self, words: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self._known: dict[tuple, int] = {}
        path, before = [0], ""  # states along the last word
        for word in words:
            shared = next((k for k, (a, b) in enumerate(zip(before, word, strict=False)) if a != b), min(len(before), len(word)))
            self._close(path, before, shared)
            for c in word[shared:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[path[-1]][c] = len(self.edges) - 1
                path.append(len(self.edges) - 1)
            self.final[path[-1]] = True
            before = word
        self._close(path, before, 0)
        self._common: dict[tuple[int, int], bool] = {}

    def _close(self, path: list[int], word: str, keep: int) -> None:
        """The states behind the first `keep` code points get no more words: each is replaced by an equal one that is known."""
        while len(path) > keep + 1:
            state = path.pop()
            same = self._known.setdefault((self.final[state], *self.edges[state].items()), state)
            self.edges[path[-1]][word[len(path) - 1]] = same

    def common(self, a: int, b: int) -> bool:
        """Whether some ending leads from both states to final ones."""
        if a == b:
            return True
        stack, known = [(a, b)], self._common
        while stack:
            x, y = pair = stack[-1]
            if pair in known:
                stack.pop()
                continue
            after = [(t, self.edges[y][c]) for c, t in self.edges[x].items() if c in self.edges[y]]
            if self.final[x] and self.final[y] or any(s == t or known.get((s, t)) for s, t in after):
                known[pair] = True
            elif new := [p for p in after if p not in known]:
                stack.append(new[0])
                continue
            else:
                known[pair] = False
            stack.pop()
        return known[a, b]

    def near(self) -> Iterator[tuple[str, str]]:
        """Pairs of accepted words that one edit parts, a pair perhaps more than once: the second word is the longer one, or the greater one of two equally long."""
        stack = [(0, 0, False, "", "")]
        while stack:
            a, b, edited, u, v = stack.pop()
            if edited:
                if self.final[a] and self.final[b]:
                    yield u, v
                stack += [(x, self.edges[b][c], True, u + c, v + c) for c, x in self.edges[a].items() if c in self.edges[b] and self.common(x, self.edges[b][c])]
                continue
            edges = list(self.edges[a].items())
            for k, (c, x) in enumerate(edges):
                stack.append((x, x, False, u + c, v + c))
                if self.common(a, x):  # c is inserted
                    stack.append((a, x, True, u, v + c))
                stack += [(x, y, True, u + c, v + d) for d, y in edges[k + 1 :] if self.common(x, y)]


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of the words of all texts."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    runs = runs.select("doc_id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    cut = (h % F.length("run")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, cut)"), F.expr("substring(run, cut + 2)"))
    words = runs.withColumn("h", h).withColumn("cut", cut).select(F.when(F.col("h") % DELETIONS == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _parts(words: DataFrame) -> DataFrame:
    """words (word, n) with the parts they stand in: shorter (length of the shorter word of a pair), head and tail."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("shorter")
    rows = words.select("word", "n", lengths).where(F.col("shorter") >= LEAST_LENGTH)
    rows = rows.select("*", F.lit(0).alias("h"), F.lit(0).alias("t"))
    return _halved(rows)


def _halved(rows: DataFrame) -> DataFrame:
    """rows (word, n, shorter, h, t: lengths of head and tail) in the two parts that halve the middle."""
    middle = F.col("shorter") - F.col("h") - F.col("t")
    half = F.floor(middle / 2)
    heads = F.struct((F.col("h") + half).cast("int").alias("h"), F.col("t").alias("t"))
    tails = F.struct(F.col("h").alias("h"), (F.col("t") + middle - half).cast("int").alias("t"))
    out = rows.select("word", "n", "shorter", F.explode(F.array(heads, tails)).alias("part"))
    return out.select("word", "n", "shorter", F.col("part.h").alias("h"), F.col("part.t").alias("t"), F.expr("substring(word, 1, part.h)").alias("head"), F.expr("right(word, part.t)").alias("tail"))


_PART = ["shorter", "h", "t", "head", "tail"]


def _composed(parts: DataFrame) -> DataFrame:
    """u, v and their counts n_u and n_v: the near pairs of each part, its words read in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, words, out = None, {}, []

        def pairs() -> None:
            if len(words) > 1:
                shorter, h, t, head, tail = part
                acceptor = Acceptor(sorted(words))
                out.extend((head + u + tail, head + v + tail, words[u], words[v]) for u, v in acceptor.near() if len(u) == shorter - h - t)

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["u", "v", "n_u", "n_v"])

        for batch in batches:
            for *key, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != part:
                    pairs()
                    part, words = key, {}
                words[word[key[1] : len(word) - key[2]]] = n
                if len(out) > 50_000:
                    yield batch_of()
        pairs()
        yield batch_of()

    # The work of a part is out of proportion to its bytes, so its partitions aren't merged by size.
    partitions = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.select(*_PART, "word", "n").repartition(partitions, *_PART).sortWithinPartitions(*_PART)
    return rows.mapInArrow(run, "u string, v string, n_u long, n_v long")


def near_pairs(words: DataFrame) -> DataFrame:
    """u, v, n_u and n_v of all pairs of words (word, n; a written table) that one edit parts, each once."""
    parts, found = _parts(words), None
    while True:
        sizes = parts.groupBy(*_PART).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sizes = written(sizes, "parts")
        # Parts of one word go; too large ones are cut again.
        whole = parts.join(sizes.where((F.col("size") <= MOST_WORDS) | (F.col("shorter") - F.col("h") - F.col("t") <= 1)).select(*_PART), _PART, "left_semi")
        pairs = written(_composed(whole), "near-words")
        found = pairs if found is None else found.unionByName(pairs)
        large = sizes.where((F.col("size") > MOST_WORDS) & (F.col("shorter") - F.col("h") - F.col("t") > 1))
        if not large.limit(1).count():
            return found.dropDuplicates(["u", "v"])
        parts = _halved(written(parts.join(large.select(*_PART), _PART, "left_semi"), "large-parts"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: where the forms (word, form) lead to. Counts grow along them, so there is no circle; each round doubles the steps."""
    table = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while table.where("moved").limit(1).count():
        further = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(table.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discarded(table)
        table = longer
    return table.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of docs."""
    words = written(vocabulary(docs), "words")
    pairs = written(near_pairs(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("n_v").alias("n_u"), F.col("n_u").alias("n_v")))
    best = both.groupBy(F.col("u").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_v")).alias("n"), F.col("v").alias("form"))).alias("best"), F.first("n_u").alias("n"))
    is_form = -F.col("best.n") >= FORM_RATIO * F.col("n")
    near = written(best.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "near")
    roots = _roots(near.where("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
