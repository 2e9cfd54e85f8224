"""Vector columns as numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null and no non-finite component."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def matrix(column, dtype=np.float64) -> np.ndarray:
    """A list column (Arrow array or pandas series) as rows of equal width, short ones padded by 0."""
    rows = [np.asarray(v, dtype=dtype) for v in (column.to_pylist() if hasattr(column, "to_pylist") else column)]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype)
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out
