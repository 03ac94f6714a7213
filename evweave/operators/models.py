"""Weighted classifiers, scoring and reconstruction models (M1–M6, M8–M11,
Z1–Z4).

Every weighted fit must name its ``negative_weights`` policy: ``signed`` keeps
the weights as they are, with the trainers of this library (the Newton logistic
below, the histogram trees of :mod:`.trees`); ``drop``, ``abs`` and ``zero``
change them for Spark ML's estimators, which refuse negative weights (``abs``
makes a negative event count *for* its class). There is no default, so no row is
lost silently. Scoring is a map-only ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import class_weighted
from ..plans.gram import pair_statistics
from ..session import materialize, release

MAX_COMPONENTS = 4096  # their square reaches the driver
FIT_ROWS = 250_000     # rows of a task that fits Spark ML's trees, which keep a copy many times as large as the row
ESTIMATORS = {"logistic": LogisticRegression, "gbt": GBTClassifier, "forest": RandomForestClassifier}


def training_weights(df: DataFrame, weight: str | None, policy: str | None = None, out: str = "_w") -> DataFrame:
    """Apply the negative-weight policy and put the training weight in ``out``."""
    if weight is None:
        return df.withColumn(out, F.lit(1.0))
    w = F.col(weight).cast("double")
    if policy == "drop":
        return df.where(w >= 0).withColumn(out, w)
    if policy == "abs":
        return df.withColumn(out, F.abs(w))
    if policy == "zero":
        return df.withColumn(out, F.greatest(w, F.lit(0.0)))
    raise ValueError(f"unknown negative-weight policy {policy}")


def in_fit_tasks(df: DataFrame) -> DataFrame:
    """``df`` dealt over partitions of at most ``FIT_ROWS`` rows; as it is where they hold no more."""
    r = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    return df if (r["most"] or 0) <= FIT_ROWS else df.repartition(-(-r["n"] // FIT_ROWS))


def fit_classifier(df: DataFrame, features: Sequence[str], kind: str = "logistic", label: str = "label",
                   weight: str | None = "weight", *, negative_weights: str | None = None,
                   class_weights: tuple[float, float] | None = None, **params):
    """Assemble → weighted classifier. ``weight=None`` trains
    unweighted (M2); ``class_weights=(background, signal)`` multiplies the
    sample weight by the class weight first (L15/M10). A weighted fit needs
    ``negative_weights``."""
    d = df
    if class_weights is not None:
        base = F.col(weight) if weight else F.lit(1.0)
        d = d.withColumn("_cw", class_weighted(base, label, class_weights[0], class_weights[1]))
        weight = "_cw"
    if negative_weights == "signed" and kind != "logistic":
        from .trees import fit_signed_trees
        return fit_signed_trees(d, features, kind, label, weight, **params)
    if negative_weights == "signed" and weight is not None:
        return fit_signed_logistic(d, features, label, weight, **params)
    d = training_weights(d, weight, negative_weights)
    est = ESTIMATORS[kind](featuresCol="_features", labelCol=label, weightCol="_w", **params)
    asm = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    d = d.withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[asm, est]).fit(d if kind == "logistic" else in_fit_tasks(d))


class SignedLogistic:
    """A fitted logistic model with the ``transform`` of a pipeline model."""

    def __init__(self, features: Sequence[str], coefs: Sequence[float], history: list[tuple[int, float]],
                 gradient: float, n_rows: int, abs_weight: float):
        self.features, self.coefs, self.history = list(features), [float(c) for c in coefs], history
        self.gradient, self.n_rows, self.abs_weight = gradient, n_rows, abs_weight

    def transform(self, df: DataFrame) -> DataFrame:
        p = _probability(self.features, self.coefs)
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))


def _probability(features: Sequence[str], coefs: Sequence[float]) -> Column:
    z = F.lit(float(coefs[0]))
    for c, w in zip(features, coefs[1:]):
        z = z + F.lit(float(w)) * F.col(c).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_signed_logistic(df: DataFrame, features: Sequence[str], label: str = "label", weight: str = "weight",
                        regParam: float = 1e-6, maxIter: int = 25, tol: float = 1e-6) -> SignedLogistic:
    """Logistic model on signed weights: damped Newton steps on the weighted log
    loss per unit of |weight| (plus ``regParam``/2 of the squared coefficients).
    Every step is one aggregation of the gradient and the curvature over the
    executors; only their (k+1)^2 numbers reach the driver. Features are
    standardised inside; where negative weights make the curvature indefinite
    it is shifted until positive, and a step is halved while it does not lower
    the loss. Rows with a null feature, label or weight are not used."""
    k = len(features)
    known = F.col(label).isNotNull() & F.col(weight).isNotNull()
    for c in features:
        known = known & F.col(c).isNotNull()
    base = df.where(known)
    st = base.agg(F.count("*").alias("n"), F.sum(F.abs(F.col(weight).cast("double"))).alias("w"),
                  *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    if not st["n"] or not st["w"]:
        raise ValueError("no rows with weight to fit on")
    mu = [st[f"m{i}"] for i in range(k)]
    sd = [st[f"s{i}"] or 1.0 for i in range(k)]
    xs = [F.lit(1.0)] + [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(features, mu, sd)]
    d = base.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], F.col(label).cast("double").alias("y"),
                    (F.col(weight).cast("double") / F.lit(float(st["w"]))).alias("w"))
    names = [f"x{i}" for i in range(k + 1)]

    def at(beta: np.ndarray, curvature: bool = True):
        z = F.lit(0.0)
        for n, b in zip(names, beta):
            z = z + F.lit(float(b)) * F.col(n)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z)))
        aggs = [F.sum(F.col("w") * loss).alias("loss")]
        aggs += [F.sum(F.col("w") * (p - F.col("y")) * F.col(n)).alias(f"g{i}") for i, n in enumerate(names)]
        if curvature:
            aggs += [F.sum(F.col("w") * p * (1 - p) * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}")
                     for i in range(k + 1) for j in range(i + 1)]
        r = d.agg(*aggs).first()
        ridge = np.full(k + 1, regParam)
        ridge[0] = 0.0
        g = np.array([r[f"g{i}"] for i in range(k + 1)]) + ridge * beta
        h = np.diag(ridge)
        if curvature:
            for i in range(k + 1):
                for j in range(i + 1):
                    h[i, j] += r[f"h{i}_{j}"]
                    if i != j:
                        h[j, i] += r[f"h{i}_{j}"]
        return r["loss"] + 0.5 * float((ridge * beta * beta).sum()), g, h

    beta = np.zeros(k + 1)
    loss, g, h = at(beta)
    history = [(0, float(loss))]
    for it in range(1, maxIter + 1):
        if np.abs(g).max() <= tol:
            break
        low = float(np.linalg.eigvalsh(h).min())
        step = np.linalg.solve(h + max(0.0, 1e-6 - low) * np.eye(k + 1), g)
        size = 1.0
        while True:
            new = at(beta - size * step)
            if new[0] <= loss or size < 1e-4:
                break
            size /= 2
        if new[0] > loss:
            break
        beta, (loss, g, h) = beta - size * step, new
        history.append((it, float(loss)))
    coefs = [beta[0] - sum(b * m / s for b, m, s in zip(beta[1:], mu, sd))] + [b / s for b, s in zip(beta[1:], sd)]
    return SignedLogistic(features, coefs, history, float(np.abs(g).max()), int(st["n"]), float(st["w"]))


def score(model, df: DataFrame, out: str = "score", round_digits: int | None = None) -> DataFrame:
    """M6/Z3: batch scoring → probability of class 1 in ``out`` (map-only)."""
    t = model.transform(df)
    s = vector_to_array(F.col("probability"))[1]
    if round_digits is not None:
        s = F.round(s, round_digits)
    keep = [c for c in df.columns if c != out]
    return t.select(*keep, s.alias(out))


def fit_gbt_early_stopping(df: DataFrame, features: Sequence[str], validation: Column, label: str = "label",
                           weight: str | None = "weight", rounds: int = 100, patience: int = 10, **params):
    """M4: boosted trees on signed weights that stop when the loss on the ``validation`` rows has not fallen for
    ``patience`` rounds; the trees up to the lowest loss are kept. ``params``: of :class:`.trees.Member`."""
    from .trees import Member, fit_trees
    return fit_trees(df, features, [Member(rounds=rounds, patience=patience, **params)], label, weight, validation)


def fit_forest_regressor(df: DataFrame, features: Sequence[str], label: str = "label", max_depth: int = 3,
                         num_trees: int = 100, seed: int = 42) -> PipelineModel:
    """M5: forest regression of the 0/1 label."""
    asm = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    est = RandomForestRegressor(featuresCol="_features", labelCol=label, maxDepth=max_depth,
                                numTrees=num_trees, seed=seed)
    return Pipeline(stages=[asm, est]).fit(in_fit_tasks(df.withColumn(label, F.col(label).cast("double"))))


def training_history(model) -> DataFrame | None:
    """Per-iteration objective of a fitted pipeline's last stage
    (logistic: ``objectiveHistory``). Small (one row per iteration)."""
    if isinstance(model, SignedLogistic):
        return SparkSession.getActiveSession().createDataFrame(model.history, "iteration int, loss double")
    last = model.stages[-1] if hasattr(model, "stages") else model
    spark = SparkSession.getActiveSession()
    if hasattr(last, "summary") and getattr(last, "hasSummary", False):
        hist = last.summary.objectiveHistory
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "iteration int, loss double")
    return None


# --- M8: one-class reconstruction ----------------------------------------------------

def fit_reconstruction(df: DataFrame, x: str = "x", k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """M8 (re-aimed): the mean and the ``k`` principal axes (as columns) of one class's rows, from one pass of
    blocked products; only the components' square reaches the driver. Rows whose vector is null, or
    misses components, count for the components they have."""
    first = df.where(F.col(x).isNotNull()).select(F.size(x).alias("n")).first()
    n = first["n"] if first else 0
    if n > MAX_COMPONENTS:
        raise ValueError(f"at most {MAX_COMPONENTS} components")
    mean, cov = np.zeros(n), np.zeros((n, n))
    got = pair_statistics(df, x, n).toArrow() if n else None
    if got is not None:
        i, j = got.column("feature_a").to_numpy(), got.column("feature_b").to_numpy()
        cov[i, j] = got.column("cov").fill_null(0.0).to_numpy()
        mean[i[i == j]] = got.column("mean_a").fill_null(0.0).to_numpy()[i == j]
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(-values, kind="stable")[:k]]
    # the sign of an axis: its largest component is positive
    return mean, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]) if n else axes


def reconstruction_error(df: DataFrame, mean: np.ndarray, axes: np.ndarray, x: str = "x", out: str = "error") -> DataFrame:
    """M8 + L10: x̂ = mean + V Vᵀ(x − mean); error = mean squared difference.
    The mean and the k principal axes (model-sized constants) are literal
    arrays, so the projection is JVM-side array arithmetic, O(n·k) per row."""
    n, k = axes.shape
    d = df.withColumn("_xc", F.zip_with(x, F.lit(mean.tolist()).cast("array<double>"), lambda a, b: a - b))
    vs = [F.lit(axes[:, j].tolist()).cast("array<double>") for j in range(k)]
    zs = [F.aggregate(F.zip_with("_xc", v, lambda a, b: a * b), F.lit(0.0), lambda acc, t: acc + t) for v in vs]
    xhat = F.transform(vs[0], lambda e: e * zs[0])
    for v, z in zip(vs[1:], zs[1:]):
        xhat = F.zip_with(xhat, v, _add_scaled(z))
    sq = F.zip_with("_xc", xhat, lambda a, b: (a - b) * (a - b))
    err = F.aggregate(sq, F.lit(0.0), lambda acc, t: acc + t) / F.lit(float(n))
    return d.withColumn(out, err).drop("_xc")


def _add_scaled(z: Column):
    return lambda a, b: a + b * z


# --- M9: focal-loss training ---------------------------------------------------------

def fit_focal_logistic(df: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None,
                       alpha: float = 0.25, gamma: float = 2.0, lr: float = 0.5, iterations: int = 30,
                       eps: float = 1e-7, validation: Column | None = None) -> tuple[list[float], DataFrame]:
    """M9 (re-aimed): a linear model trained by full-batch gradient descent on
    the focal loss. Each iteration is ONE DataFrame aggregation (Σ gᵢ·xᵢ over
    the executors); the driver only holds the k+1 coefficients. ``validation``
    rows give no gradient, only their loss, in the same pass. Returns the
    coefficients (bias first) and the history (iteration, loss, val_loss)."""
    k = len(features)
    wts = [0.0] * (k + 1)
    w_col = F.col(weight).cast("double") if weight else F.lit(1.0)
    held = F.coalesce(validation, F.lit(False)) if validation is not None else F.lit(False)
    d = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"),
                              w_col.alias("_sw"), held.alias("_val")))
    hist = []
    for it in range(iterations):
        z = F.lit(wts[0])
        for i, c in enumerate(features):
            z = z + F.lit(wts[i + 1]) * F.col(c)
        p = F.least(F.greatest(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), F.lit(eps)), F.lit(1.0 - eps))
        y = F.col("_y")
        a, g = F.lit(alpha), F.lit(gamma)
        # dL/dz of  −α[y(1−p)^γ log p + (1−y) p^γ log(1−p)]
        d1 = -a * y * (F.pow(1 - p, g) * (1 - p) - g * F.pow(1 - p, g) * p * F.log(p))
        d0 = -a * (1 - y) * (g * F.pow(p, g) * (1 - p) * F.log(1 - p) - F.pow(p, g) * p)
        gz = F.when(~F.col("_val"), (d1 + d0) * F.col("_sw"))
        loss = -a * (y * F.pow(1 - p, g) * F.log(p) + (1 - y) * F.pow(p, g) * F.log(1 - p)) * F.col("_sw")
        row = d.agg(F.sum(F.when(~F.col("_val"), F.col("_sw"))).alias("n"), F.sum(F.when(~F.col("_val"), loss)).alias("loss"),
                    F.sum(F.when(F.col("_val"), F.col("_sw"))).alias("vn"), F.sum(F.when(F.col("_val"), loss)).alias("vloss"),
                    F.sum(gz).alias("g0"), *[F.sum(gz * F.col(c)).alias(f"g{i + 1}") for i, c in enumerate(features)]).first()
        n = row["n"] or 1.0
        hist.append((it, float(row["loss"] or 0.0) / n, float(row["vloss"]) / row["vn"] if row["vn"] else None))
        wts = [wts[i] - lr * float(row[f"g{i}"] or 0.0) / n for i in range(k + 1)]
    release(d)
    return wts, df.sparkSession.createDataFrame(hist, "iteration int, loss double, val_loss double")


def linear_score(df: DataFrame, features: Sequence[str], coefs: Sequence[float], out: str = "score") -> DataFrame:
    z = F.lit(float(coefs[0]))
    for c, w in zip(features, coefs[1:]):
        z = z + F.lit(float(w)) * F.col(c)
    return df.withColumn(out, F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6))


# --- Z1, Z4: user functions --------------------------------------------------------------

def merge_per_group(df: DataFrame, keys: Sequence[str], partial: Callable, merge: Callable, partial_schema: str,
                    schema: str) -> DataFrame:
    """Z1 for groups of any size: ``partial`` (pandas frame of one group's rows in
    one batch -> small frame with the keys) runs inside the tasks, ``merge`` (all
    partial rows of a group -> result) on the few partial rows. A group holding a
    third of all rows costs a few rows per batch."""
    keys = list(keys)

    def run(batches):
        import pandas as pd
        for b in batches:
            got = [partial(g) for _, g in b.groupby(keys, dropna=False, sort=False)]
            if got:
                yield pd.concat(got, ignore_index=True)

    return df.mapInPandas(run, partial_schema).groupBy(*keys).applyInPandas(merge, schema)


def mean_loss(df: DataFrame, loss: Callable[[Column, Column], Column], label: str = "label", pred: str = "score",
              keys: Sequence[str] = ()) -> DataFrame:
    """Any ``(label, prediction) -> Column`` loss averaged per slice."""
    return df.groupBy(*keys).agg(F.avg(loss(F.col(label), F.col(pred))).alias("loss"))
