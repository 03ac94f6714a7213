"""Cleaning of vector columns, shared by the two vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_vector(col: str) -> Column:
    """True for vectors that are not null and hold only finite numbers."""
    return F.col(col).isNotNull() & F.forall(
        F.col(col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
        & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def usable(df: DataFrame, id_col: str, vec_col: str, out: Column) -> DataFrame:
    """``id`` (long) and ``v`` (= ``out``) of the rows that take part: with an id
    and a finite vector."""
    return df.where(F.col(id_col).isNotNull() & finite_vector(vec_col)).select(
        F.col(id_col).cast("long").alias("id"), out.alias("v"))


def matrix(col: pa.Array, dim: int, dtype) -> np.ndarray:
    """A list column as a matrix; shorter vectors are padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    if n and (size == dim).all():
        return flat[off[0]:off[-1]].reshape(n, dim).astype(dtype, copy=False)
    out = np.zeros((n, dim), dtype)
    for i in range(n):
        k = min(dim, int(size[i]))
        out[i, :k] = flat[off[i]:off[i] + k]
    return out


def list_column(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(m).ravel()))


def first_of_each(ids: np.ndarray) -> np.ndarray:
    """Places of the first occurrence of each id, in order of appearance."""
    return np.sort(np.unique(ids, return_index=True)[1])
