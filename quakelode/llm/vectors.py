"""What the embedding operators share: which vectors take part, and matrices of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """Not null, some component not zero, and none null or not finite."""
    v = F.col(col)
    # a finite x has x - x = 0; for null, NaN and infinite x it isn't
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(x.cast("double") - x.cast("double") == 0, F.lit(False))) & F.exists(v, lambda x: x.cast("double") != 0)


def lengths(vectors: DataFrame, col: str) -> list[int]:
    """The lengths of usable vectors."""
    got = vectors.where(usable(col)).groupBy(F.size(col).alias("d")).count().collect()
    return sorted(r.d for r in got)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A row of doubles for each vector of an Arrow list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def stacked(series, length: int) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64) if len(series) else np.zeros((0, length))
