"""What scans over sorted Arrow batches share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def key_starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's key is not that of the row before it; the first row is a start. Nulls are one key."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for column in columns:
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def group_medians(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The median of each group of rows; a group goes from a start to the next one."""
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, len(values)))
    ordered = values[np.lexsort((values, np.cumsum(starts)))]
    a, b = ordered[first + (size - 1) // 2], ordered[first + size // 2]
    return np.where(a == b, a, 0.5 * a + 0.5 * b)
