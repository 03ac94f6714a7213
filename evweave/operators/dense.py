"""Batch scoring with stored dense layers (M7).

A stored network is a list of layers ``(W, b, activation)`` with ``W`` of
shape (inputs × units). Small networks are unrolled into Catalyst column
expressions (no Python at all); larger ones run as an Arrow-batched
``pandas_udf`` doing one matrix product per batch. Both give the same scores: a
null or NaN input gives a null score, and the activations do not overflow.
Dropout is inert at scoring time and therefore absent.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL_LIMIT = 4096  # multiply-adds per row below which layers are unrolled

ACTIVATIONS = ("linear", "relu", "sigmoid", "softplus", "tanh")


def _act_col(z: Column, act: str) -> Column:
    if act == "linear":
        return z
    if act == "relu":
        return F.greatest(z, F.lit(0.0))
    if act == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    if act == "softplus":
        return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    if act == "tanh":
        return F.tanh(z)
    raise ValueError(f"unknown activation {act}")


def _act_np(z: np.ndarray, act: str) -> np.ndarray:
    if act == "linear":
        return z
    if act == "relu":
        return np.maximum(z, 0.0)
    if act == "sigmoid":
        return 1.0 / (1.0 + np.exp(-np.maximum(z, -700.0)))
    if act == "softplus":
        return np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z)))
    if act == "tanh":
        return np.tanh(z)
    raise ValueError(f"unknown activation {act}")


def layer_columns(inputs: Sequence[Column], layers) -> list[Column]:
    """Unrolled forward pass: output columns of the last layer."""
    cur = list(inputs)
    for W, b, act in layers:
        W = np.asarray(W, dtype=float)
        nxt = []
        for j in range(W.shape[1]):
            z = F.lit(float(b[j]))
            for i, x in enumerate(cur):
                z = z + F.lit(float(W[i, j])) * x
            nxt.append(_act_col(z, act))
        cur = nxt
    return cur


def dense_score(df: DataFrame, features: Sequence[str], layers, out: str = "score",
                round_digits: int | None = 6) -> DataFrame:
    """Add ``out`` = the network's single output (rounded to ``round_digits``
    so ties and thresholds agree across engines)."""
    work = sum(np.asarray(W).size for W, _, _ in layers)
    inputs = [F.col(c).cast("double") for c in features]
    col = layer_columns(inputs, layers)[0] if work <= UNROLL_LIMIT else _pandas_scorer(layers)(*inputs)
    known = F.lit(True)
    for x in inputs:
        known = known & x.isNotNull() & ~F.isnan(x)
    col = F.when(known, col)  # greatest() skips nulls: the activations alone would invent a score
    if round_digits is not None:
        col = F.round(col, round_digits)
    return df.withColumn(out, col)


def _pandas_scorer(layers):
    mats = [(np.asarray(W, dtype=float), np.asarray(b, dtype=float), a) for W, b, a in layers]

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(dtype=float) for c in cols]))
        for W, b, a in mats:
            x = _act_np(x @ W + b, a)
        return pd.Series(x[:, 0])
    return score


def layers_from_table(weights: DataFrame):
    """Rebuild layers from a weights table (layer, i, j, w) + (layer, j, b,
    activation) rows; the table is as large as the model, not the data."""
    rows = weights.collect()
    by_layer: dict[int, dict] = {}
    for r in rows:
        d = by_layer.setdefault(r["layer"], {"W": {}, "b": {}, "act": r["activation"]})
        if r["i"] is None:
            d["b"][r["j"]] = r["w"]
        else:
            d["W"][(r["i"], r["j"])] = r["w"]
    layers = []
    for k in sorted(by_layer):
        d = by_layer[k]
        n_in = 1 + max(i for i, _ in d["W"])
        n_out = 1 + max(j for _, j in d["W"])
        W = np.zeros((n_in, n_out))
        for (i, j), w in d["W"].items():
            W[i, j] = w
        b = np.array([d["b"].get(j, 0.0) for j in range(n_out)])
        layers.append((W, b, d["act"]))
    return layers


def layers_to_table(spark, layers) -> DataFrame:
    rows = []
    for k, (W, b, act) in enumerate(layers):
        W = np.asarray(W, dtype=float)
        for i in range(W.shape[0]):
            for j in range(W.shape[1]):
                rows.append((k, i, j, float(W[i, j]), act))
        for j, bj in enumerate(b):
            rows.append((k, None, j, float(bj), act))
    return spark.createDataFrame(rows, "layer int, i int, j int, w double, activation string")


def rule_network(n_in: int, hidden: int, comb: int, hidden_act: str = "relu"):
    """A deterministic stored network for combination ``comb``: weights from a
    fixed arithmetic rule, so every engine can rebuild the same model."""
    W1 = np.array([[(((i + 1) * (j + 2) * (comb + 1)) % 7 - 3) / 4.0 for j in range(hidden)]
                   for i in range(n_in)])
    b1 = np.array([(j - 1) / 4.0 for j in range(hidden)])
    W2 = np.array([[((j + comb) % 3 - 1) * 1.5 + 0.5] for j in range(hidden)])
    b2 = np.array([-0.25 * comb])
    return [(W1, b1, hidden_act), (W2, b2, "sigmoid")]


def network_sql(features: Sequence[str], layers) -> str:
    """The unrolled network as SQL text (for oracles)."""
    def act(z, a):
        return {"linear": z, "relu": f"greatest({z}, 0.0)", "sigmoid": f"(1.0 / (1.0 + exp(-({z}))))",
                "softplus": f"(greatest({z}, 0.0) + ln(1 + exp(-abs({z}))))", "tanh": f"tanh({z})"}[a]
    cur = [f"cast({c} as double)" for c in features]
    for W, b, a in layers:
        W = np.asarray(W, dtype=float)
        nxt = []
        for j in range(W.shape[1]):
            z = f"cast({float(b[j])!r} as double)"
            for i, x in enumerate(cur):
                z = f"({z} + cast({float(W[i, j])!r} as double) * {x})"
            nxt.append(act(z, a))
        cur = nxt
    return cur[0]
