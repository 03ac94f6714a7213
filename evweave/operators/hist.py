"""Weighted histograms (H1–H9).

Shape of every job: (1) limits per histogram key from one aggregation,
stored once, (2) joined back — literals of the one fetched row when global,
otherwise a broadcast after counting the stored limits table (shuffle join above the
bound) — (3) a JVM-side bin expression, (4) ONE ``groupBy`` with map-side
partial sums. A sweep over many features joins the limits in wide form and
only then unpivots the (feature, bin) pairs, so the exploded rows never cross
a shuffle — only the tiny partial aggregates do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import bin_center, bin_index
from ..plans.small import join_checked, stored, with_scalars
from ..schema import DEFAULT_ROLES, Roles

ROOT3 = 3.0 ** 0.5


def to_long(df: DataFrame, features: Sequence[str], keep: Sequence[str],
            name_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Unpivot feature columns to (keep..., feature, value) rows."""
    d = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
    return d.unpivot(list(keep), list(features), name_col, value_col)


def with_limits(df: DataFrame, x: str, keys: Sequence[str] = (), lo: float | None = None,
                hi: float | None = None) -> DataFrame:
    """Attach ``_lo``/``_hi``: fixed when given, else min/max of ``x`` per key."""
    keys = list(keys)
    if lo is not None and hi is not None:
        return df.withColumn("_lo", F.lit(float(lo))).withColumn("_hi", F.lit(float(hi)))
    lim = df.groupBy(*keys).agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    if keys:
        return join_checked(df, stored(lim), keys)
    return with_scalars(df, lim)  # one row


def histogram(df: DataFrame, x: str, n_bins: int = 30, by: Sequence[str] = ("sample",),
              limit_keys: Sequence[str] = (), lo: float | None = None, hi: float | None = None,
              weight: str | None = "weight", scale: float | Column = 1.0, keep_flow: bool = False) -> DataFrame:
    """H1/H5: entries, Σw and Σw² per (limit keys, by, bin).

    ``scale`` multiplies the weights: a number, or a column such as
    :func:`signal_scale` that amplifies the signal rows only; ``keep_flow``
    keeps under/overflow as bins 0 and n+1 (only meaningful with fixed limits).
    Output carries ``lo``, ``hi`` and the bin ``center``.
    """
    limit_keys, by = list(limit_keys), [c for c in by if c not in limit_keys]
    d = with_limits(df, x, limit_keys, lo, hi)
    b = bin_index(F.col(x), F.col("_lo"), F.col("_hi"), n_bins, keep_flow)
    d = d.withColumn("bin", b).where(F.col("bin").isNotNull())
    w = (F.col(weight) * (scale if isinstance(scale, Column) else F.lit(float(scale)))) if weight else F.lit(1.0)
    g = d.groupBy(*limit_keys, *by, "_lo", "_hi", "bin").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(w).alias("sum_w"), F.sum(w * w).alias("sum_w2"))
    return g.select(*limit_keys, *by, "bin", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
                    bin_center(F.col("bin"), F.col("_lo"), F.col("_hi"), n_bins).alias("center"),
                    "entries", "sum_w", "sum_w2")


def signal_scale(signals: Sequence[str], factor: float, sample: str = "sample") -> Column:
    """H5: ``factor`` for the signal samples, 1 for background and data."""
    return F.when(F.col(sample).isin(list(signals)), F.lit(float(factor))).otherwise(F.lit(1.0))


def background_stack(hist: DataFrame, keys: Sequence[str] = (), sample: str = "sample") -> DataFrame:
    """H2: per-bin background total and the running stack over samples
    (window over the small histogram table, partitioned by key and bin)."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "bin").orderBy(sample).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*keys, "bin")
    return hist.select(*keys, "bin", sample, "sum_w",
                       F.sum("sum_w").over(w).alias("stacked_w"),
                       F.sum("sum_w").over(tot).alias("total_w"))


def data_over_background(hist: DataFrame, category: str = "category", keys: Sequence[str] = (),
                         weight_data: bool = False) -> DataFrame:
    """H3/H4: per bin the data count (or Σw with ``weight_data``), the
    background Σw, and the residual (data − bkg)/bkg where data ≠ 0.

    One aggregation over the (small) histogram table with conditional sums —
    no join between the data and background histograms is needed."""
    keys = list(keys)
    cat = F.col(category)
    dval = F.col("sum_w") if weight_data else F.col("entries").cast("double")
    g = hist.groupBy(*keys, "bin", "center").agg(
        F.sum(F.when(cat == "data", dval).otherwise(0.0)).alias("data"),
        F.sum(F.when(cat == "background", F.col("sum_w")).otherwise(0.0)).alias("background"),
        F.sum(F.when(cat == "signal", F.col("sum_w")).otherwise(0.0)).alias("signal"))
    return g.withColumn("residual", F.when(F.col("data") != 0,
                                           F.try_divide(F.col("data") - F.col("background"), F.col("background"))))


def sweep_histograms(df: DataFrame, features: Sequence[str], keys: Sequence[str], by: Sequence[str],
                     n_bins: int = 30, weight: str | None = "weight") -> DataFrame:
    """H6/H7: histograms of every feature for every key combination (e.g.
    region × tag) and ``by`` group (e.g. category), limits per (key, feature).

    Limits are one aggregation in wide form (min/max of every feature per
    key), stored, and joined onto the rows BEFORE the features are unpivoted
    (broadcast when the counted number of key combinations is small), so no
    exploded row is ever shuffled; bins are computed per feature, then the
    (feature, bin) pairs are unpivoted and aggregated in one pass."""
    keys, by = list(keys), [c for c in by if c not in keys]
    feats = list(features)
    lim = df.groupBy(*keys).agg(*[F.min(c).cast("double").alias(f"_lo_{i}") for i, c in enumerate(feats)],
                                *[F.max(c).cast("double").alias(f"_hi_{i}") for i, c in enumerate(feats)])
    lim = stored(lim)
    j = join_checked(df.select(*keys, *by, *feats, *([weight] if weight else [])), lim, keys or None)
    per = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_lo_{i}").alias("lo"),
                             F.col(f"_hi_{i}").alias("hi"),
                             bin_index(F.col(c).cast("double"), F.col(f"_lo_{i}"), F.col(f"_hi_{i}"), n_bins)
                             .alias("bin")) for i, c in enumerate(feats)])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = j.select(*keys, *by, w.alias("_w"), F.explode(per).alias("_f")).select(
        *keys, *by, "_w", "_f.*").where(F.col("bin").isNotNull())
    g = long.groupBy(*keys, "feature", *by, "lo", "hi", "bin").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("_w").alias("sum_w"), F.sum(F.col("_w") * F.col("_w")).alias("sum_w2"))
    return g.select(*keys, "feature", *by, "bin", "lo", "hi",
                    bin_center(F.col("bin"), F.col("lo"), F.col("hi"), n_bins).alias("center"),
                    "entries", "sum_w", "sum_w2")


def histogram_2d(df: DataFrame, x: str, y: str, n_bins: int = 20, by: Sequence[str] = ("label",)) -> DataFrame:
    """H9: rectangular 2-D density (counts per x-bin × y-bin × class), global limits."""
    lim = df.agg(F.min(x).cast("double").alias("_xlo"), F.max(x).cast("double").alias("_xhi"),
                 F.min(y).cast("double").alias("_ylo"), F.max(y).cast("double").alias("_yhi"))
    d = with_scalars(df, lim)
    d = d.select(*by, bin_index(F.col(x), F.col("_xlo"), F.col("_xhi"), n_bins).alias("bx"),
                 bin_index(F.col(y), F.col("_ylo"), F.col("_yhi"), n_bins).alias("by"))
    return d.groupBy(*by, "bx", "by").agg(F.count(F.lit(1)).alias("entries"))


def hexagon(x: Column, y: Column) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon (flat sides left and right, neighbours in a row one apart) that holds the
    point: cube coordinates are rounded and the one that moved most is set from the other two."""
    q, r = x - y / F.lit(ROOT3), y * 2.0 / F.lit(ROOT3)
    s = -q - r
    rq, rr, rs = (F.floor(c + 0.5) for c in (q, r, s))
    dq, dr, ds = (F.abs(a - b) for a, b in ((rq, q), (rr, r), (rs, s)))
    q_most = (dq > dr) & (dq > ds)
    return (F.when(q_most, -rr - rs).otherwise(rq).cast("long"),
            F.when(~q_most & (dr > ds), -rq - rs).otherwise(rr).cast("long"))


def hexagon_density(df: DataFrame, x: str, y: str, n: int = 20, by: Sequence[str] = ("label",)) -> DataFrame:
    """H9: density on hexagons, ``n`` across each axis's range: (by, q, r, center_x, center_y, entries), one
    aggregation. Rows where x or y is null are in no hexagon; a feature without spread is one column."""
    lim = df.agg(F.min(x).cast("double").alias("_xlo"), F.max(x).cast("double").alias("_xhi"),
                 F.min(y).cast("double").alias("_ylo"), F.max(y).cast("double").alias("_yhi"))
    d = with_scalars(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), lim)

    def unit(c, lo, hi):
        return F.coalesce(F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0)) * F.lit(float(n))

    q, r = hexagon(unit(x, "_xlo", "_xhi"), unit(y, "_ylo", "_yhi"))
    g = d.select(*by, q.alias("q"), r.alias("r")).groupBy(*by, "q", "r").agg(F.count(F.lit(1)).alias("entries"))
    g = with_scalars(g, lim)
    return g.select(*by, "q", "r", (F.col("_xlo") + (F.col("q") + F.col("r") / 2.0) / float(n) * (F.col("_xhi") - F.col("_xlo"))).alias("center_x"),
                    (F.col("_ylo") + F.col("r") * F.lit(ROOT3) / 2.0 / float(n) * (F.col("_yhi") - F.col("_ylo"))).alias("center_y"), "entries")


def score_histogram(df: DataFrame, score: str = "score", prediction: str = "prediction",
                    split: str = "split", n_bins: int = 20, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """H8: score histogram on [0, 1] by split and predicted class."""
    b = bin_index(F.col(score), F.lit(0.0), F.lit(1.0), n_bins)
    return (df.select(split, prediction, b.alias("bin")).where(F.col("bin").isNotNull())
            .groupBy(split, prediction, "bin").agg(F.count(F.lit(1)).alias("entries")))
