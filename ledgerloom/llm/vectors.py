"""What the vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(wide) > 0) & ~bad & F.exists(wide, lambda x: x != 0), F.lit(False))


def rows_of(column) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)
