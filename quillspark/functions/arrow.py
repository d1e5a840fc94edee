"""Arrow batches inside tasks: rows in pieces of bounded size, and the best rows of all that a task has seen."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts, or elements of lists, of the pieces that a task takes at a time.
PIECE = 1 << 19


def pieces(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that have in a column (texts or lists) at most so many bytes or elements, or one row."""
    for batch in batches:
        x = batch.column(column)
        sizes = pc.fill_null(pc.list_value_length(x) if pa.types.is_list(x.type) else pc.binary_length(x), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def places(groups: np.ndarray) -> np.ndarray:
    """The place (from 0) of each element in its group, of groups in ascending order."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups)


class Best:
    """For each of some questions the k best keys of a task, by score at six decimals, then key; scores below a floor are none."""

    def __init__(self, questions: int, k: int, floor: float):
        self.k, self.least = k, np.full(questions, floor)
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """Takes in the scores (keys x questions) of more keys."""
        floor, n = self.least, len(keys)
        if n > self.k:  # a score below the k-th of these is none of the k best
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=0)[n - self.k] - 1e-6)
        at, query = np.nonzero(scores >= floor)
        self.merge(query, keys[at], scores[at, query])

    def merge(self, query: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        """Takes in single scores."""
        if not len(query):
            return
        found = [np.concatenate(x) for x in zip(self.found, (query, keys, scores), strict=True)]
        rounded = np.round(found[2], 6)
        order = np.lexsort((found[1], -rounded, found[0]))
        place = places(found[0][order])
        self.found = [x[order[place < self.k]] for x in found]
        last = order[place == self.k - 1]
        self.least[found[0][last]] = np.maximum(self.least[found[0][last]], rounded[last] - 1e-6)
