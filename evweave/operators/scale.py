"""Train-fitted scaling and feature assembly.

The fitted statistics are one aggregate row per group (all features in one
pass), put back as literals of the one fetched row when global (that row reaches
the driver while the plan is built), by a join on the small stored table otherwise.

F1 uses the **population** standard deviation (Spark ML's StandardScaler uses
the sample one, so it is not used here) and maps a zero std to 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.small import join_checked, stored, with_scalars
from ..session import materialize


def _join_stats(df: DataFrame, stats: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    if group_cols:  # one row per group: stored, counted, broadcast when small
        return join_checked(df, stored(stats), group_cols, "left")
    return with_scalars(df, stats)  # one row


def standard_scale(df: DataFrame, features: Sequence[str], fit_filter: Column | None = None,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """(x − mean)/std_pop with statistics from the rows matching
    ``fit_filter`` (e.g. ``split = 'train'``), applied to every row; per group
    when ``group_cols`` is given (X13: one scaler per tag)."""
    if fit_filter is not None:
        df = materialize(df)  # the split is evaluated once, then read for the fit and for the rows
    fit = df.where(fit_filter) if fit_filter is not None else df
    stats = fit.groupBy(*group_cols).agg(
        *[F.avg(c).alias(f"_mu_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"_sd_{c}") for c in features])
    j = _join_stats(df, stats, group_cols)
    out = []
    for c in j.columns:
        if c in features:
            sd = F.col(f"_sd_{c}")
            sd = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
            out.append(((F.col(c) - F.col(f"_mu_{c}")) / sd).alias(c))
        elif not (c.startswith("_mu_") or c.startswith("_sd_")):
            out.append(F.col(c))
    return j.select(*out)


def minmax_scale(df: DataFrame, features: Sequence[str], fit_filter: Column | None = None,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """(x − min)/(max − min) to [0, 1] (zero range → scale 1). Columns
    not listed — e.g. the weight — are carried unscaled."""
    fit = df.where(fit_filter) if fit_filter is not None else df
    stats = fit.groupBy(*group_cols).agg(
        *[F.min(c).cast("double").alias(f"_lo_{c}") for c in features],
        *[F.max(c).cast("double").alias(f"_hi_{c}") for c in features])
    j = _join_stats(df, stats, group_cols)
    out = []
    for c in j.columns:
        if c in features:
            rng = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
            rng = F.when(rng == 0, F.lit(1.0)).otherwise(rng)
            out.append(((F.col(c) - F.col(f"_lo_{c}")) / rng).alias(c))
        elif not (c.startswith("_lo_") or c.startswith("_hi_")):
            out.append(F.col(c))
    return j.select(*out)


def parameterised_features(features: Sequence[str], with_mass: bool = True, with_tag: bool = False,
                           mass: str = "mass", tag: str = "tag") -> list[str]:
    """append the mass and/or tag columns to the model inputs (so they are
    scaled and assembled like any feature)."""
    out = list(features)
    if with_mass:
        out.append(mass)
    if with_tag:
        out.append(tag)
    return out


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """the model matrix as one vector column (Spark ML)."""
    d = df.select("*", *[F.col(c).cast("double").alias(f"_a_{c}") for c in features])
    va = VectorAssembler(inputCols=[f"_a_{c}" for c in features], outputCol=out, handleInvalid="keep")
    return va.transform(d).drop(*[f"_a_{c}" for c in features])
