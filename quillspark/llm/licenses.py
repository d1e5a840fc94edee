"""License scans: fuzzy search for short notices.

A notice with at most `errors` wrong characters, split into errors + 1 parts,
keeps one part unchanged (pigeonhole). So exact finds of the parts give every
candidate place; around a place the regex library's bounded-error matching
decides, and reports the span and the number of errors. It is asked only where
the window's edit distance (bit-parallel; windows that repeat are looked up)
allows a match, and not inside notices of the same label that stand exactly: those are
found as they are, and win. Exact phrases are reported as they stand, by word number.

Texts are scanned whole, lower-cased (A-Z) and with words joined by one space.
Defined results: a null or empty text has no words, no places and score 0;
overlapping places each count, overlapping notices of one label once; repeated rows are scanned each; other columns
are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, inner, slices

#: Phrases that count as they stand (words joined by one space), with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Short notices that are searched with errors: words joined by one space, label, characters that may be wrong.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the mit license", "mit", 3),
    ("distributed under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2", "apache-2", 4),
    ("you may not use this file except in compliance with the license", "apache-2", 6),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 4),
    ("creative commons attribution noderivatives", "cc-by-nd", 4),
    ("creative commons attribution 4 0 international", "cc-by", 4),
    ("cc0 1 0 universal public domain dedication", "cc0", 4),
    ("under the terms of the gnu general public license", "gpl", 5),
    ("under the terms of the gnu lesser general public license", "lgpl", 5),
    ("under the terms of the gnu affero general public license", "agpl", 5),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("subject to the terms of the mozilla public license", "mpl", 5),
    ("under the terms of the eclipse public license", "epl", 4),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("distributed under the boost software license", "bsl", 4),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("altered source versions must be plainly marked as such", "zlib", 5),
)

#: Every ASCII byte that isn't a letter or a digit becomes a space, A-Z becomes a-z; bytes of other characters stay.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def parts(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 parts of about equal length that cover the notice, with their offsets."""
    n = errors + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def words_of(text: str | None) -> list[str]:
    return text.encode().translate(_TO_WORDS).decode().split(" ") if text else []


#: Windows whose answers a scanner keeps.
CACHE_WINDOWS = 100_000


class Near:
    """Whether a text holds a notice with at most so many errors, by Myers' bit-parallel edit distance."""

    def __init__(self, notice: str, errors: int):
        self.length, self.errors = len(notice), errors
        self.at: dict[str, int] = {}
        for i, c in enumerate(notice):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def __call__(self, text: str) -> bool:
        every, last = (1 << self.length) - 1, 1 << self.length - 1
        up, down, distance = every, 0, self.length
        for c in text:
            same = self.at.get(c, 0)
            across = ((same & up) + up ^ up) | same
            right, left = down | ~(across | up) & every, up & across
            if right & last:
                distance += 1
            elif left & last:
                distance -= 1
                if distance <= self.errors:
                    return True
            right <<= 1
            up, down = (left << 1 | ~(same | down | right)) & every, right & (same | down) & every
        return False


class Scanner:
    """Finds phrases and notices in words joined by one space, with one more before and after; windows, spans and errors are in characters."""

    def __init__(self, phrases: dict[str, str] | None = None, notices: tuple = NOTICES):
        self.phrases = [(f" {p} ", label) for p, label in (phrases or PHRASES).items()]
        # (?e) finds the next match and improves it; (?b) then takes the best one inside its bounds, but would skip to a later one outside them.
        self.notices = [(n, label, e, *(regex.compile(rf"(?{f})(?:{regex.escape(n)}){{e<={e}}}") for f in "eb")) for n, label, e in notices]

        self.near = [Near(n, e) for n, _, e in notices]
        self.seen: list[dict[str, bool]] = [{} for _ in notices]
        # For each seed, from its last character: where the window of each notice that it is a part of begins and ends.
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for k, (n, _, e) in enumerate(notices):
            for offset, seed in parts(n, e):
                start = 1 - len(seed) - offset
                seeds.setdefault(seed, []).append((k, start - e - 1, start + len(n) + e + 1))
        self.seeds = ahocorasick.Automaton()
        for seed, windows in seeds.items():
            self.seeds.add_word(seed, windows)
        self.seeds.make_automaton()

    def places(self, words: str) -> list[tuple[int, int, str]]:
        """First word, last word and label of each phrase."""
        found = [(at, phrase.count(" ") - 2, label) for phrase, label in self.phrases for at in _finds(words, phrase, 1)]
        spaces = _spaces(words) if found else []
        return sorted(((first := bisect_left(spaces, at)), first + more, label) for at, more, label in found)

    def matches(self, words: str, notice: int, windows: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
        """Start, end and errors of a notice's matches inside windows (the whole text), one after the other."""
        following, best = self.notices[notice][3:]
        out = []
        for a, b in windows or [(0, len(words))]:
            while m := following.search(words, a, b):
                m = best.search(words, m.start(), m.end()) or m
                out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                a = max(m.end(), a + 1)
        return out

    def windows(self, words: str) -> dict[int, list[tuple[int, int]]]:
        """Where each notice stands: around each part of it that stands unchanged, where the distance allows it. One pass finds the parts of all notices."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, found in self.seeds.iter(words):
            for k, start, stop in found:
                a, b = max(0, last + start), last + stop
                window, seen = words[a:b], self.seen[k]
                if (hit := seen.get(window)) is None:
                    if len(seen) >= CACHE_WINDOWS // len(self.near):
                        seen.clear()
                    hit = seen[window] = self.near[k](window)
                if hit:
                    spans.setdefault(k, []).append((a, b))
        return {k: _joined(x) for k, x in spans.items()}

    def fuzzy(self, words: str) -> list[tuple[int, int, str, int, float]]:
        """First word, last word, label, errors and similarity of each notice found with errors or without.

        Of overlapping finds of one label the most similar one counts, then the longest, then the first.
        """
        windows = self.windows(words)
        found, exact = [], {}
        for k in windows:
            notice, label = self.notices[k][:2]
            spans = [(at, at + len(notice)) for at in _finds(words, notice, len(notice))]
            exact.setdefault(label, []).extend(spans)
            found += [(-1.0, a - b, a, b, label, 0) for a, b in spans]
        exact = {label: _joined(spans) for label, spans in exact.items()}
        for k, spans in windows.items():
            notice, label, errors = self.notices[k][:3]
            free = [(a, b) for a, b in _without(spans, exact[label]) if b - a >= len(notice) - errors]
            found += [(-(1 - wrong / len(notice)), a - b, a, b, label, wrong) for a, b, wrong in self.matches(words, k, free)] if free else []
        spaces = _spaces(words) if found else []
        taken: dict[str, list[tuple[int, int]]] = {}
        out = []
        for score, _, a, b, label, wrong in sorted(found):
            spans = taken.setdefault(label, [])
            at = bisect_left(spans, (a, b))
            if (at == 0 or spans[at - 1][1] <= a) and (at == len(spans) or spans[at][0] >= b):
                spans.insert(at, (a, b))
                first = max(0, bisect_left(spaces, a + 1) - 1 + (words[a] == " ") * (a > 0))
                out.append((first, first + words[a:b].strip().count(" "), label, wrong, -score))
        return sorted(out)


def _finds(text: str, what: str, step: int) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + step)


def _spaces(words: str) -> list[int]:
    return [m.start() for m in regex.finditer(" ", words)]


def _without(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of spans without those taken (both joined, in order)."""
    for a, b in spans:
        k = max(0, bisect_right(taken, (a, a)) - 1)
        while k < len(taken) and taken[k][0] < b:
            if taken[k][1] > a:
                if taken[k][0] > a:
                    yield a, taken[k][0]
                a = taken[k][1]
            k += 1
        if a < b:
            yield a, b


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPAN = "struct<first_word: long, last_word: long, label: string, errors: int, score: double>"


def scanned(docs: DataFrame, phrases: dict[str, str] | None = None, notices: tuple = NOTICES) -> DataFrame:
    """doc_id, n_words, the exact places and the fuzzy spans of every row of docs."""
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("errors", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in slices(batches, "text"):
            n, exact, fuzzy = [], [], []
            for text in batch.column(1).to_pylist():
                words = [w for w in words_of(text) if w]
                joined = f" {' '.join(words)} " if words else ""
                n.append(len(words))
                exact.append([{"first_word": a, "last_word": b, "label": label, "errors": 0, "score": 1.0} for a, b, label in scanner.places(joined)])
                fuzzy.append([dict(zip(("first_word", "last_word", "label", "errors", "score"), x, strict=True)) for x in scanner.fuzzy(joined)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(exact, kind), pa.array(fuzzy, kind)], names=["doc_id", "n_words", "places", "spans"])

    return inner(docs)[0].select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, places array<{SPAN}>, spans array<{SPAN}>")


def op9_license_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = "array_join(array_sort(array_distinct({})), ',')"
    return scanned(documents(spark, sf_dir)).selectExpr(
        "doc_id",
        "n_words",
        "CAST(size(places) AS long) AS n_base",
        "array_min(places.first_word) AS first_word",
        "array_max(places.first_word) AS last_word",
        labels.format("places.label") + " AS base_labels",
        labels.format("concat(places.label, spans.label)") + " AS labels",
        "coalesce(array_max(concat(places.score, spans.score)), 0D) AS score",
        "CAST(size(spans) AS long) AS n_spans",
        "spans",
    )
