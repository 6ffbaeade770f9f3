"""Helpers of the operators on embedding vectors: which rows count, their whole-number entries,
and exact sums over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(vectors: DataFrame, scale: int, largest: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x``: rows whose vector has no null, NaN or infinite entry, ``x`` being
    ``floor(scale * entry)`` of each. An ``x`` of ``largest`` or more in size is an error: what
    the operators compute from it would not fit their result's type."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # Asked of each entry by itself, since filters and projections may change places.
    too_large = lambda e: (F.abs(e) * scale >= largest) & (F.abs(e) < float("inf"))
    error = F.raise_error(F.lit(f"a vector's entry times {scale} is not under {largest}")).cast("bigint")
    scaled = F.transform("v", lambda e: F.when(too_large(e), error).otherwise(F.floor(e * scale)))
    return rows.where(F.col("v").isNotNull() & finite).select("vec_id", scaled.alias("x"))


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def list_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), type=kind))


def summed_entries(parts: DataFrame, keys: list[str], column: str, kind: str) -> DataFrame:
    """``keys, place, total``: the sum of each entry of ``column`` (lists of equal length)."""
    return (parts.select(*keys, F.posexplode(column).alias("place", "entry"))
            .groupBy(*keys, "place").agg(F.sum(F.col("entry").cast(kind)).alias("total")))
