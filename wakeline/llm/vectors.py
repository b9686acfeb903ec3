"""Integer vectors from a table of embeddings, with built-in functions only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 256.0
# Components beyond this bound count as the bound, so that inner products and squared
# distances of up to 512 components stay inside 64 bits.
LIMIT = 1 << 26


def is_whole(vector: Column) -> Column:
    """True where the vector is given and no component is null, NaN or infinite."""
    def finite(x: Column) -> Column:
        y = x.cast("double")
        return x.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))

    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(vector: Column) -> Column:
    """floor(256 * x) of every component as bigint."""
    def scaled(x: Column) -> Column:
        y = F.lit(SCALE) * x.cast("double")
        return F.floor(F.greatest(F.least(y, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("bigint")

    return F.transform(vector, scaled)


def matrix(vectors: pa.Array, size: int | None = None) -> np.ndarray:
    """The vectors of an Arrow list column as rows of int64, shorter ones padded with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = size if size is not None else int(lengths.max(initial=0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def vector_rows(table: DataFrame, vector: str, keep: Column, *others: Column) -> DataFrame:
    """The other columns and ``v``, the integer vector, of the rows whose vector is whole."""
    return table.filter(is_whole(F.col(vector)) & keep).select(*others, integers(F.col(vector)).alias("v"))
