"""Many logistic models in one scan.

A sweep over tags, class weights, penalties, feature sets or split shares is a list
of :class:`Spec`. All of them are fitted together by damped Newton steps: in a pass
every task adds up loss, gradient and curvature of all models that are still
moving, over its own Arrow batches, and Spark adds the tasks' few numbers by (model,
place). So forty models scan the rows as often as the slowest single one, and the
driver holds only their (k+1)^2 numbers. Weights keep their sign. The same pass
gives the loss on each model's validation rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, release
from .models import SignedLogistic

ALL = "true"
CONDITIONS = 62  # different row conditions that one pass tells apart


@dataclass
class Spec:
    """One model of a batch."""
    name: str
    features: Sequence[str]
    rows: str = ALL                 # SQL condition: its training rows
    validation: str | None = None   # SQL condition: rows that only give the validation loss
    class_weights: tuple[float, float] = (1.0, 1.0)  # (background, signal), times the weight
    weighted: bool = True           # False: every row weighs 1 (times its class weight)
    reg: float = 1e-6
    max_iter: int = 25
    tol: float = 1e-6
    start: int | None = None        # seed of small random start coefficients; None: zeros


@dataclass
class _State:
    """Where a model's Newton iteration stands."""
    beta: np.ndarray
    trial: np.ndarray
    loss: float = np.inf
    step: np.ndarray | None = None
    size: float = 1.0
    gradient: float = np.inf
    history: list = field(default_factory=list)
    done: bool = False


class ModelBatch:
    """Fitted models by name (``models``, each with ``transform``) and their histories."""

    def __init__(self, specs: list[Spec], models: dict[str, SignedLogistic], val_history: dict[str, list], passes: int):
        self.specs, self.models, self.val_history, self.passes = specs, models, val_history, passes

    def history_table(self, spark: SparkSession) -> DataFrame:
        """(model, iteration, loss, val_loss), per unit of absolute weight; the loss includes the penalty."""
        return spark.createDataFrame([(s.name, i, loss, val) for s in self.specs for (i, loss), val in
                                      zip(self.models[s.name].history, self.val_history[s.name])],
                                     "model string, iteration int, loss double, val_loss double")

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(model, feature, coefficient); the feature of the constant is null."""
        return spark.createDataFrame([(s.name, f, c) for s in self.specs for f, c in
                                      zip([None, *self.models[s.name].features], self.models[s.name].coefs)],
                                     "model string, feature string, coefficient double")

    def facts(self, spark: SparkSession) -> DataFrame:
        """(model, n_rows, abs_weight, gradient): the rows and the absolute weight a fit used, its last gradient."""
        return spark.createDataFrame([(s.name, m.n_rows, m.abs_weight, m.gradient) for s in self.specs for m in [self.models[s.name]]],
                                     "model string, n_rows long, abs_weight double, gradient double")

    def score(self, df: DataFrame, where: dict[str, str] | None = None, model: str = "model", out: str = "score") -> DataFrame:
        """Every row once per model, with that model's probability of class 1; ``where`` gives the rows a
        model is asked about (SQL conditions by name). One scan, no shuffle: all models score a batch of
        rows by one matrix product. A null feature gives a null score under the models that use it."""
        features = list(dict.fromkeys(f for s in self.specs for f in s.features))
        beta, used = np.zeros((len(features), len(self.specs))), np.zeros((len(features), len(self.specs)))
        const = np.array([self.models[s.name].coefs[0] for s in self.specs])
        for j, s in enumerate(self.specs):
            for f, c in zip(s.features, self.models[s.name].coefs[1:]):
                beta[features.index(f), j], used[features.index(f), j] = c, 1.0

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scores(*cols):
            import pandas as pd
            x = np.stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in cols], 1)
            gone = np.isnan(x)
            p = 1.0 / (1.0 + np.exp(-(const + np.where(gone, 0.0, x) @ beta)))
            if gone.any():
                p[(gone @ used) > 0] = np.nan
            return pd.Series(list(p))

        conds = list(dict.fromkeys((where or {}).get(s.name, ALL) for s in self.specs))
        asked = F.array(*[F.coalesce(F.expr(c), F.lit(False)) for c in conds])
        names = F.lit([s.name for s in self.specs])
        which = F.lit([conds.index((where or {}).get(s.name, ALL)) for s in self.specs])
        keep = [c for c in df.columns if c not in (model, out)]
        d = df.select(*keep, asked.alias("_asked"), scores(*[F.col(f).cast("double") for f in features]).alias("_scores"))
        d = d.select(*keep, "_asked", F.posexplode("_scores").alias("_j", "_p")).where(F.get("_asked", F.get(which, F.col("_j"))))
        return d.select(*keep, F.get(names, F.col("_j")).alias(model), F.nanvl("_p", F.lit(None).cast("double")).alias(out))


def fit_many(df: DataFrame, specs: Sequence[Spec], label: str = "label", weight: str | None = "weight") -> ModelBatch:
    """Fit all ``specs`` on ``df``. Rows with a null feature (any of the batch), label or weight are not used; a
    model without weight in its rows raises. Each model equals what ``models.fit_signed_logistic`` gives for
    its rows and weights."""
    specs = list(specs)
    if len({s.name for s in specs}) != len(specs):
        raise ValueError("names of models must differ")
    features = list(dict.fromkeys(f for s in specs for f in s.features))
    conds = list(dict.fromkeys([s.rows for s in specs] + [s.validation for s in specs if s.validation]))
    if len(conds) > CONDITIONS:  # more than one long can flag: batches one after the other
        half = len(specs) // 2
        parts = [fit_many(df, part, label, weight) for part in (specs[:half], specs[half:])]
        return ModelBatch(specs, {k: v for p in parts for k, v in p.models.items()},
                          {k: v for p in parts for k, v in p.val_history.items()}, sum(p.passes for p in parts))
    at = {c: 1 << i for i, c in enumerate(conds)}
    known = F.col(label).isNotNull() & (F.col(weight).isNotNull() if weight else F.lit(True))
    for f in features:
        known = known & F.col(f).isNotNull()
    bits = F.lit(0).cast("long")
    for c, bit in at.items():
        bits = bits + F.when(F.expr(c), F.lit(bit)).otherwise(F.lit(0)).cast("long")
    rows = materialize(df.where(known).select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
                                              F.col(label).cast("double").alias("y"),
                                              (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                                              bits.alias("b")).where("b <> 0"))
    k = len(features)
    stats = _stats(rows, at, k)
    state, scale = {}, {}
    for s in specs:
        st = stats[s.rows]
        a = _mass(s, st)
        if not st["n"] or not a:
            release(rows)
            raise ValueError(f"no rows with weight to fit {s.name} on")
        own = [features.index(f) for f in s.features]
        mu, sd = st["mean"][own], np.where(st["sd"][own] > 0, st["sd"][own], 1.0)
        val = _mass(s, stats[s.validation]) if s.validation else 0.0
        scale[s.name] = own, mu, sd, a, val
        first = np.zeros(len(own) + 1) if s.start is None else np.random.default_rng(s.start).normal(0, 0.5, len(own) + 1)
        state[s.name] = _State(first, first.copy())
    passes = 0
    while any(not st.done for st in state.values()):
        moving = [s for s in specs if not state[s.name].done]
        got = _pass(rows, moving, at, k, {s.name: state[s.name].trial for s in moving}, scale)
        passes += 1
        for s in moving:
            _advance(s, state[s.name], *got[s.name])
    release(rows)
    models, vals = {}, {}
    for s in specs:
        st, (own, mu, sd, a, _) = state[s.name], scale[s.name]
        coefs = [st.beta[0] - float((st.beta[1:] * mu / sd).sum()), *(st.beta[1:] / sd)]
        models[s.name] = SignedLogistic(s.features, coefs, [(i, loss) for i, loss, _ in st.history], st.gradient,
                                        stats[s.rows]["n"], a)
        vals[s.name] = [v for _, _, v in st.history]
    return ModelBatch(specs, models, vals, passes)


def _stats(rows: DataFrame, at: dict[str, int], k: int) -> dict[str, dict]:
    """Per condition: rows, means, population deviations, rows and absolute weight per class; one pass."""
    aggs = []
    for c, bit in at.items():
        on = F.col("b").bitwiseAND(F.lit(bit).cast("long")) != 0
        pre = f"c{bit}_"
        aggs.append(F.count_if(on).alias(pre + "n"))
        for cls in (0, 1):
            mine = on & (F.col("y") == cls)
            aggs += [F.count_if(mine).alias(f"{pre}n{cls}"), F.sum(F.when(mine, F.abs("w"))).alias(f"{pre}w{cls}")]
        for i in range(k):
            aggs += [F.avg(F.when(on, F.col(f"x{i}"))).alias(f"{pre}m{i}"), F.stddev_pop(F.when(on, F.col(f"x{i}"))).alias(f"{pre}s{i}")]
    r = rows.agg(*aggs).first()
    out = {}
    for c, bit in at.items():
        pre = f"c{bit}_"
        out[c] = {"n": r[pre + "n"], "count": (r[pre + "n0"], r[pre + "n1"]), "weight": (r[pre + "w0"] or 0.0, r[pre + "w1"] or 0.0),
                  "mean": np.array([r[f"{pre}m{i}"] or 0.0 for i in range(k)]), "sd": np.array([r[f"{pre}s{i}"] or 0.0 for i in range(k)])}
    return out


def _mass(s: Spec, st: dict) -> float:
    per = st["weight"] if s.weighted else st["count"]
    return float(abs(s.class_weights[0]) * per[0] + abs(s.class_weights[1]) * per[1])


def _pass(rows: DataFrame, specs: list[Spec], at: dict[str, int], k: int, trial: dict, scale: dict) -> dict:
    """``(loss, gradient, curvature, validation loss)`` of every model at its trial coefficients."""
    sizes = [2 + (len(s.features) + 1) + (len(s.features) + 1) ** 2 for s in specs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(n) for n in sizes]
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(i).to_numpy() for i in range(k)], 1) if k else np.zeros((b.num_rows, 0))
            y, w, bits = (b.column(k + i).to_numpy() for i in range(3))
            for s, out in zip(specs, sums):
                own, mu, sd, a, val = scale[s.name]
                p1 = len(own) + 1
                cw = np.where(y == 1, s.class_weights[1], s.class_weights[0]) * (w if s.weighted else 1.0)
                for held_out, (cond, mass) in enumerate(((s.rows, a), (s.validation, val))):
                    if not cond or not mass:
                        continue
                    on = (bits & at[cond]) != 0
                    if not on.any():
                        continue
                    xs = np.ones((int(on.sum()), p1))
                    xs[:, 1:] = (x[on][:, own] - mu) / sd
                    z, yy, ww = xs @ trial[s.name], y[on], cw[on] / mass
                    loss = float((ww * (np.maximum(z, 0) - z * yy + np.log1p(np.exp(-np.abs(z))))).sum())
                    if held_out:
                        out[1] += loss
                        continue
                    out[0] += loss
                    p = 1.0 / (1.0 + np.exp(-z))
                    out[2:2 + p1] += xs.T @ (ww * (p - yy))
                    out[2 + p1:] += ((xs * (ww * p * (1 - p))[:, None]).T @ xs).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
             pa.array(np.concatenate(sums))], names=["model", "place", "value"])

    cells = rows.mapInArrow(run, "model int, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value"))
    found = cells.toArrow()  # (k+1)^2 numbers a model
    model, place, value = (found.column(c).to_numpy() for c in ("model", "place", "value"))
    out = {}
    for j, s in enumerate(specs):
        v, mine = np.zeros(sizes[j]), model == j
        v[place[mine]] = value[mine]
        p1 = len(s.features) + 1
        ridge = np.full(p1, s.reg)
        ridge[0] = 0.0
        beta = trial[s.name]
        out[s.name] = (v[0] + 0.5 * float((ridge * beta * beta).sum()), v[2:2 + p1] + ridge * beta,
                       v[2 + p1:].reshape(p1, p1) + np.diag(ridge), float(v[1]) if scale[s.name][4] else None)
    return out


def _advance(s: Spec, st: _State, loss: float, g: np.ndarray, h: np.ndarray, val: float | None) -> None:
    """Take or halve the trial step, and set the next trial; ``done`` when there is none."""
    if loss <= st.loss:
        st.beta, st.loss, st.gradient = st.trial, loss, float(np.abs(g).max())
        st.history.append((len(st.history), float(loss), val))
        if st.gradient <= s.tol or len(st.history) > s.max_iter:
            st.done = True
            return
        low = float(np.linalg.eigvalsh(h).min())
        st.step, st.size = np.linalg.solve(h + max(0.0, 1e-6 - low) * np.eye(len(g)), g), 1.0
    elif st.size < 1e-4:
        st.done = True
        return
    else:
        st.size /= 2
    st.trial = st.beta - st.size * st.step
