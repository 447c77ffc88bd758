"""Vectors as rows of integers, floor(scale * x), and exact products of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_EXACT_IN_DOUBLE = 1 << 53


def grid_rows(lists: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) of the rows that are neither null nor hold
    a null or non-finite component, one pair for each length that occurs. A
    component too large for exact 64-bit sums is an error."""
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        scaled = np.floor(values.astype(np.float64).reshape(len(rows), length) * scale)
        whole = np.isfinite(values.astype(np.float64)).reshape(len(rows), length).all(axis=1)
        scaled = scaled[whole]
        # Largest squared distance of two such vectors; inner products are smaller.
        if scaled.size and 4 * float(np.abs(scaled).max()) ** 2 * length >= 1 << 62:
            raise ValueError(f"a component times {scale} is too large for exact 64-bit sums")
        yield rows[whole], scaled.astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times the transpose of b, exact: by the fast double routine where no
    sum can leave the integers a double holds, in 64-bit integers otherwise."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < _EXACT_IN_DOUBLE:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest of 2, 4 and 8 bytes."""
    top = int(np.abs(values).max(initial=0))
    return values.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def widen(data: bytes, n: int) -> np.ndarray:
    """n numbers that narrow() made, as 64-bit integers."""
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // n] if n else np.int64
    return np.frombuffer(data, kind).astype(np.int64)
