"""Vectors in Arrow batches, and pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, every component present and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, lambda x: F.coalesce(bad(x.cast("double")), F.lit(True))), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Lists as rows of doubles, filled up with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pc.list_value_length(column), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def pivots(df: DataFrame, vec: str, number: int) -> np.ndarray:
    """``number`` distinct vectors at most, those whose hash is smallest: a bounded list, alike in every run."""
    picked = df.select(vec).distinct().withColumn("h_", F.xxhash64(vec)).orderBy("h_").limit(number).select(vec).toArrow()
    return matrix(picked.column(0))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean, rows of x by rows of p."""
    sq = (x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)[None, :]
    return np.sqrt(np.maximum(sq, 0))
