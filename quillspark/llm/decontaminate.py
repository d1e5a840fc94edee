"""Benchmark decontamination under edit distance.

Texts and benchmark items are sequences of words (letters and digits, A-Z as
a-z). A CGK random walk embeds a sequence in a longer one: at step j it writes
the word it stands on and moves on by a random bit of (j, word). Two sequences
of small edit distance have walks of small Hamming distance: behind an edit
the two walks drift by a random step or none until they stand on the same word
again, and then write the same words up to the next edit.

Hamming distance is searched by bit sampling: `WALKS` walks go over an item and
over every window of the text that could hold it, and of each walk `SAMPLES` keys
are taken, each a hash of the words that the walk writes at `BITS` steps. Steps are
sampled within random stretches of the walk, so that some keys lie before an edit,
some behind it, wherever the edits are. A window and an item that agree in a key
are a candidate. Items are embedded by classes of like length, whose walks end
where the shortest of them may end; a window begins at any word, and goes on behind
the item's length (padding: what stands there is not sampled). The figures are chosen
for a recall of 0.99 at the most edits allowed, wherever they are (measured in
tests/llm). Every candidate is verified: the item must be within `MOST_EDITS` of its
words (edit distance) of some window of the text.

Most windows hold no item: an item with e edits keeps all but 2 e of its pairs of
neighbouring words, so only windows with that many pairs of the benchmark are
walked over. The pairs are counted by sums over the whole text; none is missed.

The benchmark is small beside the corpus; it is read in blocks of `BLOCK_ITEMS`
items, each of which goes over the corpus in the closure of the tasks.

Defined results: null and empty texts, and items without a word, match nothing;
items of fewer than `SHORTEST` words must occur exactly (and are all found, as
equal windows have equal walks); equal items all match; repeated rows match each;
other columns of docs are kept by `clean` and not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hashed_words, inner, mixed, shared_dir, slices, text_bytes, written

#: Share of an item's words that may be edited (inserted, deleted or replaced).
MOST_EDITS = 0.2
#: Items shorter than this many words get no edits.
SHORTEST = 8
#: Walks, keys of each, and steps of a key.
WALKS, SAMPLES, BITS = 6, 16, 3
#: Lengths of a class differ by this factor at most; a walk moves on every second step, and is sampled while an item of the class is sure to last.
CLASS, STEPS_PER_WORD = 1.15, 1.7
#: Places of the table of word pairs for each pair in it (a power of two at most twice as large), and places at most.
PAIR_PLACES, MOST_PLACES = 64, 1 << 24
#: Windows that are walked over at a time.
STEP_WINDOWS = 1 << 16
BLOCK_ITEMS = 10_000
#: Ids of documents with a find up to this many are broadcast (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_FACTORS = mixed(np.arange(1, BITS + 1, dtype=np.uint64)) | np.uint64(1)
_IS_WORD = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def most_edits(length: int) -> int:
    return int(MOST_EDITS * length) if length >= SHORTEST else 0


def class_of(length: int) -> int:
    """The least length of the class that a length belongs to."""
    least = min(length, SHORTEST)
    while length >= SHORTEST and (longer := max(least + 1, int(CLASS * least))) <= length:
        least = longer
    return least


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each word with the next one."""
    return mixed(words[:-1] * np.uint64(3) + mixed(words[1:]))


class Embedding:
    """CGK walks over sequences of a class of lengths, and the keys sampled from them."""

    def __init__(self, shortest: int):
        self.steps = max(1, int(STEPS_PER_WORD * shortest))
        chance = np.random.default_rng(shortest)
        self.seeds = mixed(np.arange(1, WALKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # For each walk and key the sampled steps, drawn from a random stretch of the walk.
        self.sampled = np.zeros((WALKS, SAMPLES, BITS), np.int64)
        for key in self.sampled.reshape(-1, BITS):
            length = int(chance.integers(min(BITS, self.steps), self.steps, endpoint=True))
            start = int(chance.integers(0, self.steps - length, endpoint=True))
            key[:] = np.sort(chance.choice(length, BITS, replace=length < BITS)) + start

    def walks(self, words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk the words it writes (steps x starts); words must go on behind the last start for as many steps."""
        for seed in self.seeds:
            at, written_words = starts.copy(), np.empty((self.steps, len(starts)), np.uint64)
            for step in range(self.steps):
                written_words[step] = words[at]
                if step % 64 == 0:  # each word's bits for the next 64 steps
                    bits = mixed(words ^ (seed + np.uint64(step)))
                at += ((bits[at] >> np.uint64(step % 64)) & np.uint64(1)).astype(at.dtype)
            yield written_words

    def keys(self, words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk and sample the keys of all starts; keys of different samples differ."""
        number = 0
        for walk, written_words in enumerate(self.walks(words, starts)):
            for steps in self.sampled[walk]:
                number += 1  # words are hashes, so a sum with odd factors is one too
                key = written_words[steps[0]] + np.uint64(number)
                for k, step in enumerate(steps[1:], 1):
                    key += written_words[step] * _FACTORS[k]
                yield key


def _gathered(words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the windows of a length from these starts (ascending) on, overlapping windows joined, and where they start there."""
    first = np.flatnonzero(np.diff(starts, prepend=starts[0] - length - 1) > length)
    begins, ends = starts[first], np.append(starts[first[1:] - 1], starts[-1]) + length
    moved = np.concatenate(([0], np.cumsum(ends - begins)[:-1])) - begins
    return np.concatenate([words[a:b] for a, b in zip(begins, ends, strict=True)]), starts + np.repeat(moved, np.diff(np.append(first, len(starts))))


class LengthClass:
    """Items of like length: the keys of their walks, and what a window needs to be walked over."""

    def __init__(self, numbers: list[int], items: list[np.ndarray], shortest: int):
        self.numbers = np.array(numbers)
        self.embedding = Embedding(shortest)
        self.window = max(len(items[k]) + most_edits(len(items[k])) for k in numbers) - 1  # pairs of the longest window
        self.pairs = min(len(items[k]) - 1 - 2 * most_edits(len(items[k])) for k in numbers)
        self.first = np.unique([items[k][0] for k in numbers]) if len(items[numbers[0]]) < SHORTEST else None
        ends = np.cumsum([len(items[k]) for k in numbers])
        flat = np.concatenate([*(items[k] for k in numbers), np.zeros(self.embedding.steps + 1, np.uint64)])
        made = np.stack(list(self.embedding.keys(flat, np.concatenate(([0], ends[:-1])))))
        order = np.argsort(made, axis=None, kind="stable")
        self.sorted_keys, self.owner = made.ravel()[order], (order % len(numbers)).astype(np.int32)

    def windows(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Where windows begin that hold as many pairs of the benchmark as an item keeps (pairs: how many stand before each word, and on behind the text)."""
        found = pairs[self.window : self.window + len(words)] - pairs[: len(words)] >= self.pairs
        if self.first is not None:  # no edits: the first word stands as it is
            found &= np.isin(words, self.first)
        return np.flatnonzero(found)

    def candidates(self, padded: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(start, item) of the windows that agree with an item in a key."""
        out: set[tuple[int, int]] = set()
        for k in range(0, len(starts), STEP_WINDOWS):
            some = starts[k : k + STEP_WINDOWS]
            for key in self.embedding.keys(*_gathered(padded, some, self.embedding.steps + 1)):
                low = np.searchsorted(self.sorted_keys, key)
                hit = np.flatnonzero(self.sorted_keys[np.minimum(low, len(self.sorted_keys) - 1)] == key)
                if len(hit):
                    high = np.searchsorted(self.sorted_keys, key[hit], side="right")
                    for start, a, b in zip(some[hit].tolist(), low[hit].tolist(), high.tolist(), strict=True):
                        out.update((start, n) for n in self.numbers[self.owner[a:b]].tolist())
        return out


class Items:
    """A block of benchmark items with the keys of their walks."""

    def __init__(self, rows: list[tuple[int, str]]):
        column = pa.array([t for _, t in rows], pa.string())
        words, firsts = hashed_words(*text_bytes(column), _IS_WORD)
        self.ids, self.words = [], []
        for k, (item, _) in enumerate(rows):
            if firsts[k + 1] > firsts[k]:
                self.ids.append(item)
                self.words.append(words[firsts[k] : firsts[k + 1]])
        self.edits = [most_edits(len(w)) for w in self.words]
        self.kinds = [np.unique(w) for w in self.words]
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            classes.setdefault(class_of(len(w)), []).append(k)
        self.classes = [LengthClass(numbers, self.words, shortest) for shortest, numbers in classes.items()]
        pairs = np.concatenate([pair_hashes(w) for w in self.words]) if self.words else np.zeros(0, np.uint64)
        self.has_pair = np.zeros(min(MOST_PLACES, 1 << (PAIR_PLACES * len(pairs) + 1).bit_length()), bool)
        self.has_pair[pairs & np.uint64(len(self.has_pair) - 1)] = True
        self.padding = max((c.embedding.steps for c in self.classes), default=0) + 1

    def candidates(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(start, item) where a window of the words may hold an item. A walk may leave its text; verification doesn't."""
        out: set[tuple[int, int]] = set()
        if not len(words):
            return out
        longest = max(c.window for c in self.classes) if self.classes else 0
        before = np.zeros(len(words) + longest, np.int32)
        np.cumsum(self.has_pair[pair_hashes(words) & np.uint64(len(self.has_pair) - 1)], out=before[1 : len(words)])
        before[len(words) :] = before[len(words) - 1]
        padded = np.concatenate((words, np.zeros(self.padding, np.uint64)))
        for c in self.classes:
            starts = c.windows(words, before)
            if len(starts):
                out |= c.candidates(padded, starts)
        return out

    def _near(self, words: np.ndarray, a: int, b: int, item: int) -> bool:
        """Whether words[a:b] has as many of the item's kinds of word as a find needs: an edit takes one away at most."""
        text, kinds = words[a:b], self.kinds[item]
        near = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1)
        hit = np.zeros(len(kinds), bool)
        hit[near[kinds[near] == text]] = True
        return np.count_nonzero(hit) >= len(kinds) - self.edits[item]

    def verified(self, words: np.ndarray, starts: list[int], first: int, last: int, item: int) -> tuple[int, int, int] | None:
        """Edits, first and last word of the item's best window near candidates (ascending starts), if within bounds; the text is words[first:last]."""
        n, most = len(self.words[item]), self.edits[item]
        ranges: list[list[int]] = []
        for start in starts:  # windows of starts close to each other are looked at as one
            a, b = max(first, start - most), min(last, start + n + most)
            if ranges and start <= ranges[-1][2] + most + 1:
                ranges[-1][1:] = [b, start]
            else:
                ranges.append([a, b, start])
        best = min((self._best(words, a, b, item) for a, b, _ in ranges if a < b and self._near(words, a, b, item)), default=(most + 1, 0, 0))
        return best if best[0] <= most else None

    def _best(self, words: np.ndarray, a: int, b: int, item: int) -> tuple[int, int, int]:
        """Edits, first and last word of the item's best window in words[a:b]."""
        w, text = self.words[item], words[a:b]
        # Sellers' algorithm, a column for each text word: edits of the item's prefixes against a window that ends here.
        column, origin = np.arange(len(w) + 1), np.zeros(len(w) + 1, np.int64)
        best = (len(w) + 1, 0, 0)
        steps = np.arange(len(w) + 1)
        for k, x in enumerate(text):
            diagonal = np.concatenate(([0], column[:-1] + (w != x)))
            from_diagonal = np.concatenate(([k + 1], origin[:-1]))
            above = column + 1
            above[0] = 0
            new = np.minimum(diagonal, above)
            new_origin = np.where(diagonal <= above, from_diagonal, origin)
            new_origin[0] = k + 1
            # Deleted item words: new[i] = min over j <= i of new[j] + i - j.
            low = np.minimum.accumulate(new - steps)
            source = np.maximum.accumulate(np.where(new - steps == low, steps, 0))
            column, origin = low + steps, new_origin[source]
            if column[-1] < best[0]:
                best = (int(column[-1]), a + int(origin[-1]), a + k)
        return best


LEAKS = "doc_id long, item_id long, edits int, first_word long, last_word long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, first_word and last_word (from 0) of every item found in a text: its best place near a candidate.

    Of several blocks of items each one's finds are written before the next
    block is read: the driver holds one block, whatever the benchmark's size.
    """
    spark, docs = docs.sparkSession, inner(docs)[0]
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator()
    block, path = list(islice(items, BLOCK_ITEMS)), ""
    while True:
        found = _leaks(docs, Items([(r["item_id"], r["text"]) for r in block]))
        block = list(islice(items, BLOCK_ITEMS))
        if not block and not path:
            return found
        path = path or f"{shared_dir(spark)}/leaks-{uuid.uuid4().hex}"
        found.write.mode("append").parquet(path)
        if not block:
            return spark.read.schema(LEAKS).parquet(path)


def _leaks(docs: DataFrame, items: Items) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words, firsts = hashed_words(*text_bytes(batch.column(1)), _IS_WORD)
            if not len(words) or not items.ids:
                continue
            starts: dict[tuple[int, int], set[int]] = {}
            for start, item in items.candidates(words):
                row = int(np.searchsorted(firsts, start, side="right")) - 1
                starts.setdefault((row, item), set()).add(start)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for (row, item), x in starts.items():
                if found := items.verified(words, sorted(x), int(firsts[row]), int(firsts[row + 1]), item):
                    best[row, item] = found
            if best:
                keys = sorted(best)
                rows = np.array([r for r, _ in keys])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array([items.ids[k] for _, k in keys], pa.int64()),
                        pa.array([best[x][0] for x in keys], pa.int32()),
                        pa.array([best[x][1] - int(firsts[x[0]]) for x in keys], pa.int64()),
                        pa.array([best[x][2] - int(firsts[x[0]]) for x in keys], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "edits", "first_word", "last_word"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, LEAKS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without an item of the benchmark, with their columns; a row without doc_id stays.

    Only ids of documents with a find are joined: they are written and counted,
    and broadcast if they are few enough, so that no text is shuffled.
    """
    rows, names = inner(docs)
    found = written(leaks(rows, benchmark).select("doc_id").distinct(), "leaking")
    few = found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(found) if few else found, "doc_id", "left_anti").select(*rows.columns).toDF(*names)


def op7_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
