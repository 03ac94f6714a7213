"""Weighted yields and class-distribution profiles.

All aggregates are single ``groupBy().agg()`` passes: Spark computes partial
aggregates on the map side, so only one small row per (task, group) crosses
the shuffle however skewed the grouping key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.gram import pair_statistics
from ..plans.small import join_checked, stored, with_scalars
from ..schema import DEFAULT_ROLES, Roles


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- A1–A5: aggregate expressions --------------------------------------------

def wavg(x, w) -> Column:
    """A1: Σxw/Σw, falling back to the plain mean when Σw = 0."""
    sw = F.sum(_c(w))
    return F.when(sw != 0, F.sum(_c(x) * _c(w)) / sw).otherwise(F.avg(_c(x)))


def signal_density(label) -> Column:
    """A2: Σlabel / count(label)."""
    return F.sum(_c(label)) / F.count(_c(label))


def signal_count(label) -> Column:
    """A3."""
    return F.sum(_c(label)).cast("long")


def total_count() -> Column:
    """A4."""
    return F.count(F.lit(1))


def distribution_aggs(roles: Roles = DEFAULT_ROLES) -> list[Column]:
    """A5: the four distribution numbers as named aggregates."""
    return [wavg(roles.label, roles.weight).alias("signal_w_density"),
            signal_density(roles.label).alias("signal_density"),
            signal_count(roles.label).alias("signal_count"),
            total_count().alias("total_count")]


def signal_distribution_per(df: DataFrame, cols: Sequence[str] = (),
                            roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """A5 per grouping columns, or one global row when ``cols`` is empty."""
    return df.groupBy(*cols).agg(*distribution_aggs(roles))


def signal_distribution_levels(df: DataFrame, levels: Sequence[Sequence[str]],
                               roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """A6 at several grouping levels in ONE pass (GROUPING SETS).

    Columns absent from a level are null; ``level`` lists the grouped columns."""
    all_cols = sorted({c for lv in levels for c in lv})
    level = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in all_cols]) \
        if all_cols else F.lit("")
    return df.groupingSets([[F.col(c) for c in lv] for lv in levels], *all_cols).agg(
        level.alias("level"), *distribution_aggs(roles))


# --- A7–A14: counts and yields --------------------------------------------------

def entries(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries per key combination."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"))


def weighted_yield(df: DataFrame, keys: Sequence[str] = ("sample",), roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Count and Σweight per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"),
                                 F.sum(roles.weight).alias("yield"))


def signal_vs_background(df: DataFrame, signal_samples: Sequence[str], background: Sequence[str],
                         roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """For each signal sample against the pooled background samples:
    counts, weights, density and weighted density. One aggregation by sample; the
    background totals are summed over its few rows (one per listed sample)."""
    sig, bg = list(signal_samples), list(background)
    g = df.where(F.col(roles.sample).isin(sig + bg)).groupBy(roles.sample).agg(
        F.count(F.lit(1)).alias("n_signal"), F.sum(roles.weight).alias("w_signal"))
    in_bg = F.col(roles.sample).isin(bg)
    every = Window.partitionBy(F.lit(0))
    j = g.withColumns({"n_background": F.coalesce(F.sum(F.when(in_bg, F.col("n_signal"))).over(every), F.lit(0)).cast("long"),
                       "w_background": F.sum(F.when(in_bg, F.col("w_signal"))).over(every)})
    j = j.where(F.col(roles.sample).isin(sig))
    return j.select(
        roles.sample, "n_signal", "w_signal", "n_background", "w_background",
        (F.col("n_signal") / (F.col("n_signal") + F.col("n_background"))).alias("density"),
        F.try_divide(F.col("w_signal"), F.col("w_signal") + F.col("w_background")).alias("w_density"))


def table_info(df: DataFrame, key: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """A10: per file/key: rows, sorted distinct samples and regions. The rows are
    counted per (key, sample, region) first, so the lists are gathered from distinct
    names only and a key that holds most rows costs no more than another."""
    names = df.groupBy(key, roles.sample, roles.region).agg(F.count(F.lit(1)).alias("_n"))
    return names.groupBy(key).agg(
        F.sum("_n").alias("n_rows"),
        F.array_sort(F.collect_set(roles.sample)).alias("samples"),
        F.array_sort(F.collect_set(roles.region)).alias("regions"))



def class_counts_per_split(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Rows per (split, label) and the share inside the split."""
    c = df.groupBy(roles.split, roles.label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(roles.split)  # over the small (split, label) table
    return c.withColumn("fraction", F.col("n") / F.sum("n").over(w))


def weight_shares(df: DataFrame, keys: Sequence[str] = (), roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """A12 + A21: weight of each class, its share of the total, and the
    statistical error √Σw² per class."""
    lab, w = F.col(roles.label), F.col(roles.weight)
    g = df.groupBy(*keys).agg(
        F.sum(F.when(lab == 1, w).otherwise(0.0)).alias("w_signal"),
        F.sum(F.when(lab == 0, w).otherwise(0.0)).alias("w_background"),
        F.sum(w).alias("w_total"),
        F.sum(F.when(lab == 1, w * w).otherwise(0.0)).alias("w2_signal"),
        F.sum(F.when(lab == 0, w * w).otherwise(0.0)).alias("w2_background"))
    return g.select(*keys, "w_signal", "w_background", "w_total",
                    F.try_divide(F.col("w_signal"), F.col("w_total")).alias("signal_share"),
                    F.try_divide(F.col("w_background"), F.col("w_total")).alias("background_share"),
                    F.sqrt("w2_signal").alias("err_signal"),
                    F.sqrt("w2_background").alias("err_background"))


def class_counts_by(df: DataFrame, key: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Signal, background and total rows per key, as conditional
    sums in one aggregation (no join of two count tables)."""
    lab = F.col(roles.label)
    return df.groupBy(key).agg(
        F.sum(F.when(lab == 1, 1).otherwise(0)).cast("long").alias("n_signal"),
        F.sum(F.when(lab == 0, 1).otherwise(0)).cast("long").alias("n_background"),
        F.count(F.lit(1)).alias("n_total"))


def class_ratio(df: DataFrame, keys: Sequence[str] = (), roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """n(label=1) / n(label=0)."""
    lab = F.col(roles.label)
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(lab == 1, 1).otherwise(0)).cast("double"),
                     F.sum(F.when(lab == 0, 1).otherwise(0)).cast("double")).alias("class_ratio"))


# --- A15–A19: feature statistics ----------------------------------------------

def _unpivot_row(df: DataFrame, names: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Turn a one-row wide aggregate with columns ``{stat}__{name}`` into rows
    (feature, stat...)."""
    n = len(names)
    args = ", ".join(
        f"'{nm}', " + ", ".join(f"`{st}__{nm}`" for st in stats) for nm in names)
    return df.selectExpr(f"stack({n}, {args}) as (feature, {', '.join(stats)})")


def correlation_matrix(df: DataFrame, cols: Sequence[str] | str, k: int | None = None) -> DataFrame:
    """Pearson correlation of every column pair (both orders and the
    diagonal) in one pass, by blocked matrix products for any number of
    columns; or of the ``k`` components of one array column, by number. A pair uses the
    rows where both values are there; an undefined correlation is null."""
    return pair_statistics(df, cols, k).select("feature_a", "feature_b", "corr")


def feature_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A16 + A17: min, max and axis limits bround(min)−1, bround(max)+1 of every
    feature from one aggregation pass."""
    cols = list(cols)
    one = df.agg(*[F.min(c).cast("double").alias(f"min__{c}") for c in cols],
                 *[F.max(c).cast("double").alias(f"max__{c}") for c in cols])
    long = _unpivot_row(one, cols, ["min", "max"])
    return long.select("feature", "min", "max",
                       (F.bround("min", 0) - 1).alias("lim_lo"),
                       (F.bround("max", 0) + 1).alias("lim_hi"))


def weighted_mean_std(df: DataFrame, x: str, keys: Sequence[str] = (),
                      roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Weighted mean and population std of ``x`` per key, two passes
    (mean first, then Σw(x−m)²/Σw) for numerical stability."""
    keys = list(keys)
    m = df.groupBy(*keys).agg((F.sum(F.col(x) * F.col(roles.weight)) / F.sum(roles.weight)).alias("wmean"))
    j = join_checked(df, stored(m), keys) if keys else with_scalars(df, m)
    d = F.col(x) - F.col("wmean")
    return j.groupBy(*keys, "wmean").agg(
        F.sqrt(F.sum(F.col(roles.weight) * d * d) / F.sum(roles.weight)).alias("wstd"))


def feature_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each column, one pass, as (feature, mean) rows."""
    one = df.agg(*[F.avg(c).alias(f"mean__{c}") for c in cols])
    return _unpivot_row(one, cols, ["mean"])


# --- A20, A22, A23, J5 ------------------------------------------------------------

def entries_and_integral(df: DataFrame, x: str, lo: float, hi: float, names: Sequence[str] | None = None,
                         roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """A20 (+J5): entries and weighted integral inside [lo, hi] per sample; with
    ``names`` every listed sample appears, with 0 when absent."""
    inside = (F.col(x) >= lo) & (F.col(x) <= hi)
    g = df.groupBy(roles.sample).agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.when(inside, F.col(roles.weight)).otherwise(0.0)).alias("integral"))
    if names is None:
        return g
    return report_names(df.sparkSession, names, g, roles.sample, {"entries": 0, "integral": 0.0})


def report_names(spark, names: Sequence[str], counts: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join of a fixed name list with a count table, zero when absent."""
    nd = spark.createDataFrame([(n,) for n in names], f"{key} string")
    j = nd.join(counts, key, "left")
    return j.select(key, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value, most frequent first (value as tie-break)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(col))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """A23."""
    return df.select(col).distinct().orderBy(col)


def log_prior_odds(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """log(Σlabel / Σ(1−label))."""
    lab = F.col(roles.label)
    return df.agg(F.log(F.sum(lab).cast("double") / F.sum(F.lit(1) - lab).cast("double")).alias("log_odds"))
