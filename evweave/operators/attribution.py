"""Exact attributions of tree ensembles (R7): Shapley values in closed form.

A leaf contributes to a row through the features on its path alone. For a feature f
of the path let z be the share of training rows that the path's conditions on f
keep (the product of the branch shares) and o whether the row itself fulfils them.
With a set S of known features the leaf's value counts with the product of o over
S and z over the rest; so the Shapley value of f is the leaf's value times (o - z)
times a weighted sum of the coefficients of the polynomial that multiplies (z + o t)
over the path's other features. A path has at most ``depth`` features, so the
work per row is (leaves) x (depth squared), whatever the number of features, and no
coalition is enumerated or sampled.

The job is map-only: the trees are model-sized and travel with the function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .trees import Tree, TreeEnsemble


@dataclass
class Path:
    """A leaf: its value, its features, and per feature the share and the bins (above ``lo``, up to ``hi``) of its conditions."""
    value: float
    features: list[int]
    share: list[float]
    lo: list[int]
    hi: list[int]


def leaf_paths(tree: Tree) -> list[Path]:
    """The leaves that training rows reach; branch shares are by row counts."""
    out, todo = [], [(1, Path(0.0, [], [], [], []))]
    while todo:
        v, p = todo.pop()
        if tree.feature[v] < 0:
            out.append(Path(float(tree.value[v]), p.features, p.share, p.lo, p.hi))
            continue
        f, cut = int(tree.feature[v]), int(tree.cut[v])
        for child, left in ((2 * v, True), (2 * v + 1, False)):
            part = float(tree.rows[child]) / float(tree.rows[v])
            q = Path(0.0, p.features[:], p.share[:], p.lo[:], p.hi[:])
            if f not in q.features:
                q.features.append(f)
                q.share.append(1.0)
                q.lo.append(-1)
                q.hi.append(1 << 30)
            i = q.features.index(f)
            q.share[i] *= part
            if left:
                q.hi[i] = min(q.hi[i], cut)
            else:
                q.lo[i] = max(q.lo[i], cut)
            todo.append((child, q))
    return out


def _add_leaf(phi: np.ndarray, bins: np.ndarray, p: Path, rate: float) -> float:
    """Add a leaf's Shapley values to ``phi``; its mean contribution."""
    m = len(p.features)
    base = rate * p.value * float(np.prod(p.share)) if m else rate * p.value
    if not m or p.value == 0.0:
        return base
    own = np.stack([(bins[:, f] > lo) & (bins[:, f] <= hi) for f, lo, hi in zip(p.features, p.lo, p.hi)], 1).astype(np.float64)
    weight = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    for i, f in enumerate(p.features):
        poly = np.zeros((len(bins), m))  # coefficients by the number of known features
        poly[:, 0] = 1.0
        deg = 0
        for j in range(m):
            if j != i:
                poly[:, 1:deg + 2] = poly[:, 1:deg + 2] * p.share[j] + poly[:, :deg + 1] * own[:, j:j + 1]
                poly[:, 0] *= p.share[j]
                deg += 1
        phi[:, f] += rate * p.value * (own[:, i] - p.share[i]) * (poly @ np.array(weight))
    return base


def tree_attributions(model: TreeEnsemble, rows: DataFrame, id_col: str, member: int = 0) -> DataFrame:
    """``id_col, feature, value, attribution, base_value`` of one member of ``model`` for every row: exact Shapley
    values of the margin (squared loss: of the prediction). ``base_value`` plus a row's attributions is its
    margin. Null features count as above the last edge, as in the model; repeated ids give repeated rows."""
    spec, trees, features = model.specs[member], model.trees[member], model.features
    cut = [np.array(model.edges[c], np.float64) for c in features]
    start, k = model.start[member], len(model.features)
    paths = [p for t in trees for p in leaf_paths(t)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            bins = np.empty((n, k), np.int64)
            for i in range(k):
                x = b.column(1 + i).to_numpy(zero_copy_only=False)
                bins[:, i] = np.where(np.isnan(x), len(cut[i]), np.searchsorted(cut[i], x, "left"))
            phi, base = np.zeros((n, k)), start
            for p in paths:
                base += _add_leaf(phi, bins, p, spec.rate)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(phi.ravel())),
                 pa.array(np.full(n, base))], names=[*b.schema.names, "_phi", "base_value"])

    src = rows.select(F.col(id_col), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    got = src.mapInArrow(run, T.StructType(src.schema.fields + [T.StructField("_phi", T.ArrayType(T.DoubleType())),
                                                                T.StructField("base_value", T.DoubleType())]))
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_x{i}").alias("value"), F.get("_phi", F.lit(i)).alias("attribution"))
                     for i, c in enumerate(features)])
    return got.select(id_col, F.explode(each).alias("_a"), "base_value").select(id_col, "_a.*", "base_value")
