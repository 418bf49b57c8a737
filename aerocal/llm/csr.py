"""Sparse 0/1 matrices in compressed rows, as far as token alignment needs them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Csr:
    """Row ``i`` has a one in each of ``cols[start[i]:start[i + 1]]``; columns ascend in a row."""

    start: np.ndarray
    cols: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.start) - 1

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(self.height), np.diff(self.start))
        order = np.argsort(self.cols, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))])
        return Csr(start, rows[order], self.height)


def one_per_column(sizes: np.ndarray) -> Csr:
    """Incidence of consecutive runs: run ``i`` owns the next ``sizes[i]`` columns."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    return Csr(start, np.arange(start[-1]), int(start[-1]))


def one_per_row(cols: np.ndarray, width: int) -> Csr:
    return Csr(np.arange(len(cols) + 1), cols, width)


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of ``first[i], first[i] + 1, ...`` with ``count[i]`` members each, in order."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def row_products(a: Csr, b: Csr, step: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nonzeros (row, column, value) of the product a·b by Gustavson's rule, rows ascending.

    Row ``i`` of the product is the sum of the rows of ``b`` named by the columns of row ``i`` of
    ``a``. Rows are taken in blocks of about ``step`` terms, which bounds the memory.
    """
    terms = np.diff(b.start)[a.cols]
    before = np.concatenate([[0], np.cumsum(terms)])[a.start]
    found, row = [], 0
    while row < a.height:
        stop = max(row + 1, int(np.searchsorted(before, before[row] + step, "right")) - 1)
        part = slice(a.start[row], a.start[stop])
        cols = b.cols[expand(b.start[a.cols[part]], terms[part])]
        rows = np.repeat(np.arange(row, stop), np.diff(before[row : stop + 1]))
        key = rows * b.width + cols
        if len(key) and (key[1:] < key[:-1]).any():
            key = np.sort(key)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        found.append((key[new], np.diff(np.append(new, len(key)))))
        row = stop
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    key, value = (np.concatenate(x) for x in zip(*found))
    return key // b.width if b.width else key, key % b.width if b.width else key, value
