"""Exact running sums and ranks without a single-task window.

A window with no partition key (or with a partition key that may hold a third
of all rows) moves every row of that key into one task. Here the order is cut
into buckets that are monotone in the sort order:

1. count/sum per (group, bucket) — a small table, map-side combined;
2. exclusive running total of those bucket totals (window over the small
   table only, ``#groups × #buckets`` rows);
3. join the bucket offsets back (AQE broadcasts the offsets when they are
   small, shuffles otherwise);
4. running sum inside (group, bucket) plus the offset.

The result equals the plain window result row for row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_DIGITS = 4  # 16^4 = 65,536 buckets per group


def hash_order(seed, key_cols: Sequence[str]) -> Column:
    """Deterministic pseudo-random order key: md5 of ``seed:key...``.

    md5 is the same in every engine, so membership by hash order is stable
    across partitionings, reruns and engines."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in key_cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(h: Column, digits: int = HASH_BUCKET_DIGITS) -> Column:
    """Bucket from the leading hex digits of a hash (monotone in the hash order)."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def running_sums(df: DataFrame, group_cols: Sequence[str], bucket_col: str,
                 order: Sequence[Column], sums: dict, descending: bool = False,
                 group_totals: bool = False) -> DataFrame:
    """Add inclusive running sums ``{out_name: value_column}`` ordered by
    ``order`` within ``group_cols`` (and, with ``group_totals``, the group's
    grand total as ``{out_name}_total``, taken from the bucket table for free).

    ``bucket_col`` must be monotone with ``order`` (non-decreasing when
    ``descending`` is False, non-increasing otherwise). Ties in ``order`` are
    broken by position inside the window, as a ROWS frame does.
    """
    group_cols = list(group_cols)
    vals = {k: (v if isinstance(v, Column) else F.col(v)) for k, v in sums.items()}
    # One struct key for the group: never null (null members compare equal),
    # so the offsets join is a plain equi-join whose hash partitioning on
    # (group, bucket) is reused by the window below — one shuffle of the rows.
    gk = F.struct(*group_cols) if group_cols else F.lit(0)
    with_vals = df.select("*", gk.alias("_gk"), *[v.alias(f"_v_{k}") for k, v in vals.items()])
    totals = with_vals.groupBy("_gk", bucket_col).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in vals])
    b_order = F.col(bucket_col).desc() if descending else F.col(bucket_col).asc()
    # small table: #groups × #buckets rows
    w_off = Window.partitionBy("_gk").orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy("_gk")
    offsets = totals.select("_gk", bucket_col,
                            *[F.coalesce(F.sum(f"_t_{k}").over(w_off), F.lit(0)).alias(f"_o_{k}")
                              for k in vals],
                            *([F.sum(f"_t_{k}").over(w_all).alias(f"{k}_total") for k in vals]
                              if group_totals else []))
    j = with_vals.join(offsets, ["_gk", bucket_col], "inner")
    w_in = Window.partitionBy("_gk", bucket_col).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = j.select("*", *[(F.col(f"_o_{k}") + F.sum(f"_v_{k}").over(w_in)).alias(k) for k in vals])
    return out.drop("_gk", *[f"_v_{k}" for k in vals], *[f"_o_{k}" for k in vals])


def hash_rank(df: DataFrame, group_cols: Sequence[str], seed, key_cols: Sequence[str],
              tiebreak: Sequence[str] = (), out: str = "_rank",
              digits: int = HASH_BUCKET_DIGITS, group_totals: bool = False) -> DataFrame:
    """Exact 1-based rank of each row inside its group in ``md5(seed:key)``
    order (then ``tiebreak`` columns), computed bucket-wise. The hash stays in
    column ``_h``; with ``group_totals`` the group size is ``{out}_total``."""
    h = "_h"
    d = df.withColumn(h, hash_order(seed, key_cols)).withColumn("_hb", hash_bucket(F.col(h), digits))
    order = [F.col(h)] + [F.col(c) for c in tiebreak]
    r = running_sums(d, group_cols, "_hb", order, {out: F.lit(1).cast("long")},
                     group_totals=group_totals)
    return r.drop("_hb")
