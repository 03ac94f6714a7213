"""Parameter sweeps, model comparison, top-k and set operations
(J3, J4, J6, W1–W3, T1–T7, U3).

Score tables are small (combinations × slices × thresholds), but every
operation is still a DataFrame job, so a sweep over thousands of
combinations never loops on the driver over rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.io import finished_parts, write_scores


# --- J6 / W1: grids -----------------------------------------------------------------

def param_grid(spark: SparkSession, params: Mapping[str, Sequence]) -> DataFrame:
    """Full product of parameter lists with a stable ``comb_id`` (the
    position in the product, last parameter fastest). The grid is as large as
    the product of the lists — a driver-sized object by construction."""
    names = list(params)
    rows = [(i, *vals) for i, vals in enumerate(itertools.product(*[params[n] for n in names]))]
    types = {int: "int", float: "double", str: "string", bool: "boolean"}
    schema = "comb_id int, " + ", ".join(
        f"{n} {types.get(type(params[n][0]), 'string')}" for n in names)
    return spark.createDataFrame(rows, schema)


def grid_list(params: Mapping[str, Sequence]) -> list[dict]:
    names = list(params)
    return [dict(zip(names, vals)) for vals in itertools.product(*[params[n] for n in names])]


# --- J3 / J4: model comparison ---------------------------------------------------------

def compare_reports(long_reports: DataFrame, models: Sequence, model_col: str = "comb",
                    keys: Sequence[str] = ("weighted", "class", "metric")) -> DataFrame:
    """Evaluation rows of many models side by side: one column per
    model, ``support`` rows dropped. The model list is given, so the pivot
    needs no extra pass to discover it."""
    d = long_reports.where(F.col("metric") != "support")
    return (d.groupBy(*keys).pivot(model_col, list(models)).agg(F.first("value"))
            .select(*keys, *[F.col(str(m)).alias(f"{model_col}_{m}") for m in models]))


# --- T1–T7, U3: top-k and slices -------------------------------------------------------

def top_n(df: DataFrame, n: int, by: Sequence[str], tiebreak: Sequence[str] = (),
          ascending: bool = False) -> DataFrame:
    """N largest (or smallest) by one to three keys, tie-broken — a
    TakeOrdered plan: each task keeps n rows, the driver merges them."""
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in by] + [F.col(c).asc() for c in tiebreak]
    return df.orderBy(*order).limit(n)


def top_n_per(df: DataFrame, n: int, group: Sequence[str], by: Sequence[str], tiebreak: Sequence[str] = (),
              ascending: bool = False) -> DataFrame:
    """N largest per group (window partitioned by the group key)."""
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in by] + [F.col(c).asc() for c in tiebreak]
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def best_per_metric(df: DataFrame, metrics: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """T4: for every metric column, the id row with the highest value (ties to
    the smallest ids). Metrics are unpivoted so it is one windowed pass."""
    long = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), "metric", "value")
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), *[F.col(c).asc() for c in ids])
    return long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def sorted_desc(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """T5."""
    return df.orderBy(*[F.col(c).desc() for c in by])


def preview(df: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in the order of ``by`` (all columns by default)."""
    return df.orderBy(*(by or df.columns)).limit(n)


def score_slice(df: DataFrame, comb, th: float, comb_col: str = "comb") -> DataFrame:
    """One (comb, *, th) slice of a score table."""
    return df.where((F.col(comb_col) == comb) & (F.col("th") == th))


def common_top(df: DataFrame, n: int, group: str, items: Sequence[str], by: Sequence[str],
               tiebreak: Sequence[str] = ()) -> DataFrame:
    """Items that are in the top ``n`` of EVERY group (e.g. (comb, th)
    pairs among the best n for every mass)."""
    df = materialize(df)  # read twice: once for the groups, once for the ranks
    t = top_n_per(df, n, [group], by, tiebreak)
    n_groups = df.select(group).distinct().count()  # one number to the driver
    return (t.groupBy(*items).agg(F.countDistinct(group).alias("n_groups"))
            .where(F.col("n_groups") == n_groups).drop("n_groups"))


# --- W3 / S12: resumable sweeps ---------------------------------------------------------

def stored_scores(spark: SparkSession, path: str, key: str = "comb_id") -> DataFrame | None:
    """The finished combinations of a score store: only folders with ``_SUCCESS``
    count, so a combination whose writer died is not there. None: nothing yet."""
    folders = finished_parts(spark, path, key)
    if not folders:
        return None
    return spark.read.parquet(*folders)


def pending_combinations(grid: DataFrame, stored: DataFrame | None, key: str = "comb_id") -> DataFrame:
    """Combinations not yet in the stored score table (left anti join)."""
    if stored is None:
        return grid
    return grid.join(stored.select(key).distinct(), key, "left_anti")


def run_sweep(spark: SparkSession, grid_rows: Sequence[dict], score_fn: Callable[[dict], DataFrame],
              store_path: str | None = None, key: str = "comb_id") -> DataFrame:
    """Evaluate ``score_fn(params)`` for each combination and union the
    score rows. With ``store_path`` each combination has its own folder, written
    with overwrite and counted as stored only with its ``_SUCCESS`` marker, so a
    sweep resumes after a lost driver or executor without half-written scores."""
    todo = list(grid_rows)
    if store_path and todo:
        grid = spark.createDataFrame([(p[key],) for p in todo], [key])
        left = {r[key] for r in pending_combinations(grid, stored_scores(spark, store_path, key), key).collect()}
        todo = [p for p in todo if p[key] in left]
    outs = []
    for params in todo:
        res = score_fn(params).withColumn(key, F.lit(params[key]))
        if store_path:
            write_scores(res, store_path, key, params[key])
        else:
            outs.append(res)
    if store_path:
        return stored_scores(spark, store_path, key)
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out
