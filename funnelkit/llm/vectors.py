"""Vector columns of Arrow batches as dense double matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """Not NULL, and every component present and finite."""
    limit = F.lit(float("inf"))
    return column.isNotNull() & F.forall(
        F.coalesce(column, F.array()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """[rows, width] of a list<double> column without NULLs; shorter rows end in zeros."""
    sizes = np.array([0] * len(column)) if not len(column) else np.diff(
        np.asarray(column.offsets)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out
