"""What operators on vector columns share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and holds neither null nor non-finite components; an empty one does."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def matrix(vectors: pa.Array, dims: int, kind) -> np.ndarray:
    """Rows of a list column as a matrix; entries that a shorter vector lacks count as 0."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(vectors) * dims and (sizes == dims).all():
        return flat.reshape(len(vectors), dims).astype(kind)
    out = np.zeros((len(vectors), dims), dtype=kind)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out
