"""Byte-level BPE by a monoid tree reduction.

A piece (one match of the pattern) is encoded by halves (the first a power of two
long, so that a repeating piece has few different parts, each encoded once), and two encodings are
joined at their border. The join rests on this fact about rank-ordered BPE: a
token sequence is the encoding of its bytes exactly if every two neighbours
are the encoding of their joined bytes. So a join re-encodes a window of tokens
around the border and widens it on the side where the window's outer token
isn't stable beside its neighbour; once both sides are stable, nothing further
out can change. Pieces never interact, so a text's ids are the concatenation of
its pieces', and decoding concatenates token bytes up a tree of halves.

Defined results: a null or empty text has no tokens; repeated rows are encoded
each; other columns, whatever their names, pass through `tokenized` untouched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, inner, slices

#: Bytes up to which a piece's part is merged directly.
LEAF_BYTES = 16
#: Bytes up to which a window's pairs are searched one after the other; longer ones are kept in a heap.
WINDOW_BYTES = 256
#: Encoded pieces in each of the two generations that a task keeps: a full young one becomes the old one.
CACHE_PIECES = 100_000


class MonoidBpe:
    """Encoder and decoder for ranks (token bytes to id) and a pattern that splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.stable = lru_cache(30_000)(self._stable)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> MonoidBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """The definition: again and again the neighbours whose joined bytes rank lowest are merged, leftmost first."""
        if len(data) > WINDOW_BYTES:
            return self._merged_by_heap(data)
        get, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            if (least := min(ranks)) == none:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def _merged_by_heap(self, data: bytes) -> list[int]:
        """The same for long windows: pairs wait in a heap by rank and place, parts in a linked list."""
        get, n = self.ranks.get, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by a part's first byte: its end (0: merged away) and the part before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:  # a pair that is no more
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _stable(self, left: int, right: int) -> bool:
        return self.merged(self.token[left] + self.token[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encodings' joined bytes."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            middle = self.merged(self.decode(left[len(left) - i :] + right[:j]))
            left_ok = i == len(left) or self.stable(left[-i - 1], middle[0])
            right_ok = j == len(right) or self.stable(middle[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + middle + right[j:]
            if not left_ok:
                i = min(len(left), 2 * i)
            if not right_ok:
                j = min(len(right), 2 * j)

    def piece(self, data: bytes, known: dict[bytes, list[int]] | None = None) -> list[int]:
        """Encoding by two parts, the first a power of two long: equal parts of a repeating piece are encoded once (known)."""
        if (one := self.ranks.get(data)) is not None:
            return [one]
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        known = {} if known is None else known
        if (ids := known.get(data)) is None:
            half = 1 << (len(data) - 1).bit_length() - 1
            ids = known[data] = self.join(self.piece(data[:half], known), self.piece(data[half:], known))
        return ids

    def _encoded(self, text: str | None) -> Iterator[list[int]]:
        """The encodings of a text's pieces."""
        pieces = self.pieces
        for x in self.pattern.findall(text) if text else ():
            ids = pieces.get(x)
            if ids is None:
                ids = self.older.get(x) or self.piece(x.encode())
                if len(x) <= 64:
                    if len(pieces) >= CACHE_PIECES:
                        self.older, self.pieces = pieces, (pieces := {})
                    pieces[x] = ids
            yield ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for ids in self._encoded(text):
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return sum(map(len, self._encoded(text)))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join([self.token[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def public_ranks() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _task(path: str, pattern: str, with_ids: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = MonoidBpe.from_file(path, pattern)
        most = max(bpe.token)
        name, kind = [str(i) for i in range(most + 1)], "<u2" if most < 1 << 16 else "<u4"
        for batch in slices(batches, "text"):
            n, ids_sha, decoded_sha, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([name[i] for i in ids]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, kind).tobytes())
            made = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                made.append(pa.array(all_ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    return run


def tokenized(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: one row for each row of docs.

    ids are packed little-endian numbers, of two bytes each if the vocabulary
    allows it, else of four (`unpacked` gives them back).
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return inner(docs)[0].select("doc_id", "text").mapInArrow(_task(path, pattern, with_ids), schema)


def unpacked(ids: bytes, n_tokens: int) -> list[int]:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n_tokens else "<u4").tolist()


def op6_bpe_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(documents(spark, sf_dir), *public_ranks(), with_ids=False)
