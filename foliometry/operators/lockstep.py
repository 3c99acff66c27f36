"""Folds of many short keys at once: row t of every key in one numpy step.

A block holds all rows of its keys, sorted.  Keys are walked side by side, longest first, so that
the keys that still have a row are always a prefix; a step sees one row of each and decides by
masks, in the same floating-point order as a row-by-row fold.  Where fewer than FEW keys are left,
the rest of their rows are handed back, because one row at a time is cheaper in plain Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliometry.schema import EPSILON

FEW = 16


def snap(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < EPSILON, 0.0, x)


def codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """A number for each value of a column, nulls -1, and the values."""
    encoded = column.dictionary_encode()
    return pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def key_starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's key differs from the row before."""
    fresh = np.zeros(len(columns[0]), bool)
    if len(fresh):
        fresh[0] = True
    for column in columns:
        number, _ = codes(column)
        fresh[1:] |= number[1:] != number[:-1]
    return np.flatnonzero(fresh)


class Block:
    """Columns by name, the keys' first rows and lengths, and the walk."""

    def __init__(self, batch: pa.RecordBatch, keys: list[str]):
        self.batch, self.rows = batch, batch.num_rows
        self.starts = key_starts([batch.column(k) for k in keys])
        self.lengths = np.diff(self.starts, append=self.rows)
        self.order = np.argsort(-self.lengths, kind="stable")
        self.step = np.arange(self.rows) - np.repeat(self.starts, self.lengths) + 1
        self.key = np.repeat(np.arange(len(self.starts)), self.lengths)
        self.left: list[tuple[int, int]] = []  # (key, rows walked) of the keys that were handed back

    def numbers(self, name: str) -> np.ndarray:
        """A column of doubles, nulls as NaN."""
        return self.batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)

    def codes(self, name: str) -> tuple[np.ndarray, list]:
        return codes(self.batch.column(name))

    def slots(self, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row a number of its (key, columns), and the first row of each number."""
        slot = self.key
        for column in columns:
            _, slot = np.unique(slot * (int(column.max(initial=0)) + 2) + column + 1, return_inverse=True)
        _, first = np.unique(slot, return_index=True)
        return slot, first

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, keys): one row of each key that has a t-th row, for t = 0, 1, ..."""
        lengths = self.lengths[self.order]
        active, t = len(lengths), 0
        while True:
            active = int(np.searchsorted(-lengths[:active], -t, "left"))
            if active < FEW:
                self.left = [(int(k), t) for k in self.order[:active]]
                return
            keys = self.order[:active]
            yield self.starts[keys] + t, keys
            t += 1


def doubles(values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, pa.float64(), mask=None if valid is None else ~valid)


def named(numbers: np.ndarray, names: tuple[str, ...]) -> pa.Array:
    """Issue codes by number; 0 is none."""
    return pa.array(["", *names]).take(pa.array(numbers, pa.int32(), mask=numbers == 0))
