"""Turning what users put in brackets into sorted, distinct, in-range positions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import numpy as np


def _is_name(x: Any) -> bool:
    return isinstance(x, (str, np.str_))


def _one(x: Any, n: int, what: str) -> int:
    """A single position: negative counts from the end, outside is an IndexError."""
    if isinstance(x, (bool, np.bool_)):
        raise TypeError(f"{what} index must be an integer, not a boolean")
    if isinstance(x, (float, np.floating)):
        if not float(x).is_integer():
            raise TypeError(f"{what} index must be an integer, not {x!r}")
    elif not isinstance(x, (int, np.integer)):
        raise TypeError(f"{what} index must be an integer, not {type(x).__name__}")
    k = int(x)
    if not -n <= k < n:
        raise IndexError(f"{what} index {k} is out of bounds for {n} {what}s")
    return k + n if k < 0 else k


def _range(s: slice, n: int) -> range:
    """A slice as a range: nothing is laid out, whatever its length."""
    if s.step not in (None, 1):
        raise ValueError("Step slicing is not supported; use a list of positions")
    start, stop, _ = slice(s.start, s.stop).indices(n)
    return range(start, stop)


def _many(values: Iterable, n: int, what: str) -> list[int]:
    array = values if isinstance(values, np.ndarray) else np.asarray(list(values))
    if array.ndim != 1:
        raise TypeError(f"{what} indexes must be one-dimensional")
    if array.dtype == bool or (array.dtype == object and len(array) and all(isinstance(v, (bool, np.bool_)) for v in array)):
        if len(array) != n:
            raise ValueError(f"Boolean index length {len(array)} does not match the {n} {what}s")
        return np.flatnonzero(array.astype(bool)).tolist()
    if array.dtype.kind in "iu":
        k = array.astype(np.int64)
        bad = (k < -n) | (k >= n)
        if bad.any():
            raise IndexError(f"{what} index {int(k[bad][0])} is out of bounds for {n} {what}s")
        return np.unique(np.where(k < 0, k + n, k)).tolist()
    return sorted({_one(v, n, what) for v in array.tolist()})


def normalize_row_indices(index: Any, nrows: int) -> Sequence[int]:
    """Sorted distinct positions of an integer, a slice (a range), a boolean mask or a sequence of integers.

    Negative positions count from the end. A mask must have one value per row. Fractions
    and other types are a TypeError, positions outside an IndexError, steps a ValueError.
    """
    if isinstance(index, slice):
        return _range(index, nrows)
    if np.ndim(index) == 0 and not isinstance(index, (str, bytes)):
        return [_one(index, nrows, "row")]
    if isinstance(index, (str, bytes)):
        raise TypeError("rows are indexed by position, not by name")
    return _many(index, nrows, "row")


def name_positions(names: Sequence[str]) -> dict[str, int]:
    """Name -> position; of equal names the first."""
    at: dict[str, int] = {}
    for i, name in enumerate(names):
        at.setdefault(name, i)
    return at


def _bound(x: Any, at: dict[str, int] | None, n: int, stop: bool) -> Any:
    if not _is_name(x):
        return x
    if at is None:
        raise ValueError("indexing by name requires gene_names")
    if x not in at:
        raise IndexError(f"column name {x!r} not found")
    return at[x] + (1 if stop else 0)


def normalize_column_indices(index: Any, ncols: int, gene_names: Sequence[str] | None = None) -> Sequence[int]:
    """Like rows, and names: one, a sequence, or as bounds of a slice, whose stop is then included."""
    at = None if gene_names is None else name_positions(list(gene_names))
    if isinstance(index, slice):
        return _range(slice(_bound(index.start, at, ncols, False), _bound(index.stop, at, ncols, True), index.step), ncols)
    if _is_name(index):
        return [_bound(str(index), at, ncols, False)]
    if np.ndim(index) == 0:
        return [_one(index, ncols, "column")]
    values = list(index)
    if values and all(_is_name(v) for v in values):
        if at is None:
            raise ValueError("indexing by name requires gene_names")
        missing = [v for v in values if v not in at]
        if missing:
            raise IndexError(f"column names not found: {', '.join(map(str, missing))}")
        return sorted({at[v] for v in values})
    if any(_is_name(v) for v in values):
        raise TypeError("names and positions cannot be mixed in one list")
    return _many(index if isinstance(index, np.ndarray) else values, ncols, "column")


def _validate(indices: Iterable[int], n: int, what: str) -> None:
    if isinstance(indices, range) and len(indices):
        indices = (indices[0], indices[-1])
    for k in indices:
        if not 0 <= k < n:
            raise IndexError(f"{what} index {k} is out of bounds for {n} {what}s")


def validate_row_indices(indices: Iterable[int], nrows: int) -> None:
    """IndexError if a position is outside 0 .. nrows-1; nothing to check is fine."""
    _validate(indices, nrows, "row")


def validate_column_indices(indices: Iterable[int], ncols: int) -> None:
    """IndexError if a position is outside 0 .. ncols-1; nothing to check is fine."""
    _validate(indices, ncols, "column")
