"""What the vector operators share: sound rows, and list columns of Arrow batches as whole-number matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components are limited to this size, far beyond any embedding, so that they are whole numbers of 64 bits.
LARGEST = float(2 ** 59)


def sound_vector(name: str = "embedding") -> Column:
    """Not null, and no component null, NaN or infinite."""
    v = F.col(name).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(lists: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of every list as a row of `width` 64-bit whole numbers; short rows end in zeros, longer ones are cut."""
    values = np.clip(np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = place < width
    out[row[fits], place[fits]] = values[fits]
    return out


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def list_column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("array<double>")
