"""Rows of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(c: str) -> Column:
    """Neither null nor empty, and no component null, infinite or not a number."""
    def fine(x):
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce((F.size(c) > 0) & F.forall(c, fine), F.lit(False))


def one_per_id(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` as doubles; of rows that repeat an id the least usable vector counts.

    Rows without an id are left out.  An id without a usable vector keeps a null embedding.
    """
    vectors = rows.where("vec_id is not null").select(
        F.col("vec_id").cast("long"),
        F.when(usable("embedding"), F.col("embedding").cast("array<double>")).alias("embedding"),
    )
    return vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists of doubles as rows; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width or 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    width = max(int(sizes.max()), width or 0)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widened(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with as many columns."""
    width = max(x.shape[1], y.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (x, y))
