"""Feature ranking and attribution.

R1 is one aggregation over the unpivoted features. R3/R4 read importances
off fitted forests (model-sized). R7 is a distributed sampled-Shapley job:
every explained row is expanded to (permutations × (features+1)) coalition
rows, all scored by ONE batch ``transform``, and attributions are the
differences of consecutive coalitions averaged per (row, feature) — the
per-row expansion is fixed (``permutations × (k+1)``), so the job is linear
in the rows explained.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.hist import to_long
from ..plans.small import with_scalars
from ..session import materialize
from . import metrics as M
from . import models as MD
from .batch import Spec, fit_many


def chi2_scores(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """χ² of non-negative features against the class: observed Σx per
    class, expected = class share × Σx, Σ(o−e)²/e (the scoring used by
    univariate feature selection). One pass over the unpivoted features."""
    long = to_long(df, features, [label])
    g = long.groupBy("feature", label).agg(F.sum("value").alias("obs"), F.count(F.lit(1)).alias("n"))
    wf = Window.partitionBy("feature")  # small: #features × #classes rows
    g = g.select("feature", label, "obs",
                 (F.col("n") / F.sum("n").over(wf)).alias("share"),
                 F.sum("obs").over(wf).alias("total"))
    e = F.col("share") * F.col("total")
    return g.groupBy("feature").agg(F.sum(F.try_divide((F.col("obs") - e) * (F.col("obs") - e), e)).alias("chi2"))


@F.pandas_udf(T.DoubleType())
def _chi2_sf_1dof(x: pd.Series) -> pd.Series:
    v = x.to_numpy(dtype=np.float64, na_value=np.nan)
    ok = v >= 0
    return pd.Series(np.where(ok, np.frompyfunc(math.erfc, 1, 1)(np.sqrt(np.where(ok, v, 0.0) / 2.0)).astype(np.float64), np.nan))


def chi2_pvalues(scores: DataFrame) -> DataFrame:
    """R2: p-value of the χ² scores with one degree of freedom, erfc(√(χ²/2)),
    on the k-row score table."""
    return scores.withColumn("p_value", _chi2_sf_1dof(F.col("chi2")))


def rank_by(df: DataFrame, col: str, ascending: bool = False, out: str = "rank") -> DataFrame:
    """Rank rows of a small per-feature table by a column."""
    o = F.col(col).asc() if ascending else F.col(col).desc()
    # the table has one row per feature, so an unpartitioned window is bounded
    return df.withColumn(out, F.row_number().over(Window.orderBy(o, F.col("feature"))).cast("long"))


def forest_importances(df: DataFrame, features: Sequence[str], label: str = "label", num_trees: int = 50,
                       max_depth: int = 5, weight: str | None = None, seed: int = 42, extra: bool = False, n_bins: int = 256,
                       key_cols: Sequence[str] = ("event_key",)) -> DataFrame:
    """Mean share of each feature in a tree's gains, and its deviation over the trees, of a random forest
    or (``extra``) of extremely randomised trees. All trees grow in the same passes; ``weight`` may be signed
    and is used as it is."""
    from .trees import fit_trees, forest_members
    model = fit_trees(df, features, forest_members(len(features), num_trees, max_depth, seed, extra), label, weight,
                      n_bins=n_bins, key_cols=key_cols, vote=True)
    per_tree = model.importances()
    rows = [(f, float(per_tree[:, i].mean()), float(per_tree[:, i].std())) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, std double")


def compare_feature_sets(train: DataFrame, test: DataFrame, sets: Mapping[str, Sequence[str]], label: str = "label",
                         weight: str | None = "weight", th: float = 0.5) -> DataFrame:
    """One model per named feature set, all fitted in one batch and scored on the same test rows in one
    pass; rows (feature_set, auc, f1_1)."""
    batch = fit_many(train, [Spec(name, list(f)) for name, f in sets.items()], label, weight)
    s = materialize(batch.score(test.select(label, *dict.fromkeys(f for fs in sets.values() for f in fs)), model="feature_set")
                    .select("feature_set", label, "score"))
    auc = M.roc_auc(s, ["feature_set"], label=label, weight=None)
    f1 = M.f1_per_threshold(s, [th], ["feature_set"], label=label, weight=None).select("feature_set", "f1_1")
    return auc.join(f1, "feature_set").select("feature_set", "auc", "f1_1")


def feature_set_sweep(train: DataFrame, test: DataFrame, sets: Mapping[str, Sequence[str]], background_weights: Sequence[float],
                      thresholds: Sequence[float], signal_weight: float = 10.0, label: str = "label",
                      weight: str | None = "weight") -> DataFrame:
    """R6 as the reference sweeps it: F1 per (feature set, background class weight, threshold). All models are
    fitted in one batch; the test rows are scored by all of them in one pass."""
    specs = {f"{n}|{b}": (n, float(b), list(f)) for n, f in sets.items() for b in background_weights}
    batch = fit_many(train, [Spec(k, f, class_weights=(b, signal_weight)) for k, (_, b, f) in specs.items()], label, weight)
    cols = [label, *([weight] if weight else []), *dict.fromkeys(f for fs in sets.values() for f in fs)]
    f1 = M.f1_per_threshold(batch.score(test.select(*cols)), thresholds, ["model"], label=label, weight=weight)
    names = train.sparkSession.createDataFrame([(k, n, b) for k, (n, b, _) in specs.items()],
                                               "model string, feature_set string, bg_weight double")
    return f1.join(F.broadcast(names), "model").select("feature_set", "bg_weight", "th", "f1_0", "f1_1", "f1_wavg")  # one row a model


MAX_BACKGROUND = 10_000  # rows of the broadcast background sample

# --- R7–R9: sampled Shapley attributions -------------------------------------------------

def sampled_shapley(model, rows: DataFrame, background: DataFrame, features: Sequence[str], id_col: str,
                    permutations: int = 8, seed: int = 42) -> DataFrame:
    """Permutation-sampled Shapley values of ``model`` (a fitted pipeline
    taking the feature columns) for every row of ``rows``.

    For row r and permutation p (a hash order of the features) with a
    background row b(r, p) drawn from ``background`` (a sample of bounded
    size, broadcast), coalition j takes the first j features of the
    permutation from r and the rest from b. φ_f is the score difference when
    f joins, averaged over permutations. Σ_f φ_f = f(r) − mean_p f(b(r,p))
    exactly (the sum telescopes). Output: (id, feature, value, attribution).
    """
    k = len(features)
    bg = background.select(*[F.col(c).cast("double").alias(f"_b_{c}") for c in features])
    bg = bg.withColumn("_bi", F.row_number().over(Window.orderBy(*[f"_b_{c}" for c in features])) - 1)
    bg = materialize(bg)
    n_bg = bg.count()
    if not 0 < n_bg <= MAX_BACKGROUND:
        raise ValueError(f"the background sample must have 1 to {MAX_BACKGROUND} rows")
    r = rows.select(F.col(id_col), *[F.col(c).cast("double").alias(c) for c in features])
    r = r.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    r = r.withColumn("_bi", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("_p")), F.lit(n_bg)).cast("int"))
    r = r.join(F.broadcast(bg), "_bi")
    order = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.col(id_col), F.col("_p"), F.lit(i))
                                            .alias("h"), F.lit(i).alias("f")) for i in range(k)]))
    r = r.withColumn("_perm", F.transform(order, lambda s: s["f"]))
    r = r.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(k))))
    coal = r.select(id_col, "_p", "_j", "_perm", *[
        F.when(F.array_position("_perm", i) <= F.col("_j"), F.col(c)).otherwise(F.col(f"_b_{c}")).alias(c)
        for i, c in enumerate(features)])
    scored = MD.score(model, coal, "_s")
    # a coalition's score counts for the feature that joined it and against the
    # one that joins next: sums per (row, feature), no window and no join back
    vals = F.array(*[F.col(c) for c in features])
    joined, nxt = F.get("_perm", F.col("_j") - 1), F.get("_perm", F.col("_j"))
    terms = F.filter(F.array(
        F.struct(joined.alias("f"), F.col("_s").alias("d"), F.get(vals, joined).alias("v")),
        F.struct(nxt.alias("f"), (-F.col("_s")).alias("d"), F.lit(None).cast("double").alias("v"))),
        lambda z: z["f"].isNotNull())
    t = scored.select(id_col, F.explode(terms).alias("z"))
    names = F.array(*[F.lit(c) for c in features])
    att = t.groupBy(id_col, "z.f").agg((F.sum("z.d") / F.lit(float(permutations))).alias("attribution"),
                                       F.max("z.v").alias("value"))
    return att.select(id_col, F.get(names, F.col("f")).alias("feature"), "attribution", "value")


def global_importance(attr: DataFrame) -> DataFrame:
    """Mean |attribution| per feature, ranked."""
    g = attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    return rank_by(g, "mean_abs")


def dependence(attr: DataFrame, feature: str) -> DataFrame:
    """(value, attribution) pairs of one feature."""
    return attr.where(F.col("feature") == feature).select("value", "attribution")


def linear_contributions(df: DataFrame, features: Sequence[str], coefs: Sequence[float], bias: float,
                         out: str = "contributions") -> DataFrame:
    """Exact attributions of a linear margin b + Σwᵢxᵢ: cᵢ = wᵢ(xᵢ − x̄ᵢ) with
    base value b + Σwᵢx̄ᵢ (means from one aggregate row), so base + Σcᵢ is the
    margin of every row (the input of L17's additive decision)."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in features])
    base = F.lit(float(bias))
    for c, w in zip(features, coefs):
        base = base + F.lit(float(w)) * F.col(f"_m_{c}")
    contrib = F.array(*[F.lit(float(w)) * (F.col(c) - F.col(f"_m_{c}")) for c, w in zip(features, coefs)])
    j = with_scalars(df, means)
    return j.withColumn("base_value", base).withColumn(out, contrib).drop(*[f"_m_{c}" for c in features])
