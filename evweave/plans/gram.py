"""Sums of products of many columns in one pass.

The matrix of products is cut into blocks of at most ``BLOCK`` x ``BLOCK`` column pairs.
Every task adds up the blocks of its Arrow batches with matrix products and sends
them once; blocks are merged in two rounds (salted first, then by block), each a
streaming sum over sorted rows that holds one block at a time. So the cost grows
with the columns' square in arithmetic only, not in the size of a query plan.

A pair's sums use the rows where both values are there (null and NaN are missing).
Values are taken relative to the first row's, so that large offsets do not swallow
small spreads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
SALTS = 64
#: per pair: rows, Σx, Σy, Σx², Σy², Σxy
SUMS = 6


def _matrix(b: pa.RecordBatch, k: int, vector: bool) -> np.ndarray:
    if not vector:
        return np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for i in range(k)], 1)
    x = np.full((b.num_rows, k), np.nan)
    for i, v in enumerate(b.column(0).to_pylist()):
        if v is not None:
            x[i, :min(k, len(v))] = [np.nan if e is None else e for e in v[:k]]
    return x


def _dense(col: pa.Array, k: int) -> np.ndarray | None:
    """The matrix of a list column whose lists are all whole."""
    if col.null_count or col.values.null_count:
        return None
    off = col.offsets.to_numpy()
    if len(off) > 1 and (np.diff(off) == k).all():
        return col.values.to_numpy()[off[0]:off[-1]].reshape(-1, k).astype(np.float64, copy=False)
    return None


def pair_blocks(df: DataFrame, cols: Sequence[str] | str, k: int | None = None) -> DataFrame:
    """Merged blocks ``bi, bj, v`` of the columns ``cols`` (or of the ``k`` components of one array column); ``v``
    holds the ``SUMS`` matrices of the block one after the other, of values less ``shift``; and ``shift``."""
    vector = isinstance(cols, str)
    k = k if vector else len(cols)
    src = df.select(F.col(cols).cast("array<double>").alias("x")) if vector else df.select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    first = src.first()
    values = [] if first is None else (first[0] or [] if vector else list(first))
    shift = np.zeros(k)
    for i, v in enumerate(values[:k]):
        shift[i] = v if v is not None and np.isfinite(v) else 0.0
    starts = list(range(0, k, BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _dense(b.column(0), k) if vector else None
            x = (_matrix(b, k, vector) if x is None else x) - shift
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(np.float64)
            x2 = x * x
            for i, a in enumerate(starts):
                s = slice(a, a + BLOCK)
                for j in range(i, len(starts)):
                    t = slice(starts[j], starts[j] + BLOCK)
                    v = np.stack([m[:, s].T @ m[:, t], x[:, s].T @ m[:, t], m[:, s].T @ x[:, t], x2[:, s].T @ m[:, t],
                                  m[:, s].T @ x2[:, t], x[:, s].T @ x[:, t]])
                    sums[i, j] = sums[i, j] + v if (i, j) in sums else v
        salt = TaskContext.get().partitionId() % SALTS
        for (i, j), v in sums.items():
            yield _block_row(i, j, salt, v.ravel())

    parts = src.mapInArrow(run, "bi int, bj int, salt int, v array<double>")
    for keys in (["bi", "bj", "salt"], ["bi", "bj"]):
        parts = parts.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys).mapInArrow(_merge(len(keys)), parts.schema)
    return parts.select("bi", "bj", "v", F.lit(shift.tolist()).cast("array<double>").alias("shift"))


def _block_row(i: int, j: int, salt: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([salt], pa.int32()),
                                       pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))],
                                      names=["bi", "bj", "salt", "v"])


def _merge(n_keys: int):
    """Sums the rows of equal keys, which follow each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            off = b.column(3).offsets.to_numpy()
            flat = b.column(3).values.to_numpy()
            for r, key in enumerate(keys):
                v = flat[off[r]:off[r + 1]]
                if now is not None and key[:n_keys] == now[:n_keys]:
                    total = total + v
                    continue
                if now is not None:
                    yield _block_row(*now, total)
                now, total = key, v.copy()
        if now is not None:
            yield _block_row(*now, total)

    return run


def _pairs(k: int, names: list[str] | None):
    """Rows of a block: both orders of every pair, with its sums turned into a covariance and a correlation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shift = np.array(b.column(3)[0].as_py()) if b.num_rows else None
            for r in range(b.num_rows):
                i, j = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                p, q = min(BLOCK, k - i * BLOCK), min(BLOCK, k - j * BLOCK)
                n, sx, sy, sxx, syy, sxy = np.asarray(b.column(2)[r].values.to_numpy()).reshape(SUMS, p, q)
                with np.errstate(invalid="ignore", divide="ignore"):
                    cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
                    corr = cov / np.sqrt(vx * vy)
                    mean_x, mean_y = sx / n, sy / n
                rows, cols = np.meshgrid(np.arange(p) + i * BLOCK, np.arange(q) + j * BLOCK, indexing="ij")
                if i == j:  # the block holds both orders itself
                    yield _pair_rows(rows, cols, n, mean_x + shift[rows], cov / n, corr, names)
                else:
                    yield _pair_rows(rows, cols, n, mean_x + shift[rows], cov / n, corr, names)
                    yield _pair_rows(cols, rows, n, mean_y + shift[cols], cov / n, corr, names)

    return run


def _pair_rows(a, b, n, mean, cov, corr, names) -> pa.RecordBatch:
    def place(x):
        return pa.array([names[i] for i in x.ravel().tolist()]) if names else pa.array(x.ravel().astype(np.int32))

    ok = np.isfinite(corr.ravel())
    return pa.RecordBatch.from_arrays(
        [place(a), place(b), pa.array(n.ravel().astype(np.int64)), pa.array(mean.ravel(), mask=n.ravel() == 0),
         pa.array(cov.ravel(), mask=n.ravel() == 0), pa.array(np.clip(corr.ravel(), -1.0, 1.0), mask=~ok)],
        names=["feature_a", "feature_b", "n", "mean_a", "cov", "corr"])


def pair_statistics(df: DataFrame, cols: Sequence[str] | str, k: int | None = None) -> DataFrame:
    """Rows ``feature_a, feature_b, n, mean_a, cov, corr`` of every ordered pair of columns (of components, by
    number, for an array column), over the rows where both are there; population covariance; an undefined
    correlation (no rows, no spread) is null."""
    names = None if isinstance(cols, str) else list(cols)
    k = k if names is None else len(names)
    kind = "int" if names is None else "string"
    return pair_blocks(df, cols, k).mapInArrow(
        _pairs(k, names), f"feature_a {kind}, feature_b {kind}, n long, mean_a double, cov double, corr double")
