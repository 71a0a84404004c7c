"""Vector tables: which rows take part, and packed vectors inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def lengths(rows: DataFrame, vec: str) -> list[int]:
    """The numbers of components that occur, ascending; each is a space of its own."""
    return sorted(r["d"] for r in rows.select(F.size(vec).alias("d")).distinct().collect())  # one number per length


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column of usable vectors as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
