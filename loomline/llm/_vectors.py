"""Vectors in Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(c: str) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(c).isNotNull() & F.coalesce(F.forall(c, finite), F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a double matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
