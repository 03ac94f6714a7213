"""Deterministic exact splits and samples.

Sizes follow the documented rule of the reference's splitter:
``n_test = ceil(test·n)``, then on the remainder
``n_val = ceil(v·(n − n_test))`` with ``v = val/(test+train)`` in
compatibility mode (the reference's formula, quirk Q1) or
``v = val/(train+val)`` otherwise. Membership is by md5(seed:key) order, so it
is the same on every run, partitioning and engine. Ranks come from the
bucketed running sum (:mod:`evweave.plans.prefix`), so no stratum — even one
holding a third of all rows — is ranked inside a single task. Samples (X8, X12)
select by a threshold on the hash (:mod:`evweave.plans.threshold`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import hash_order, hash_rank
from ..plans.threshold import first_by_hash
from ..schema import DEFAULT_ROLES, Roles, check_sizes
from ..session import materialize


def val_fraction(train: float, val: float, test: float, compat: bool = True) -> float:
    if compat:
        return val / (test + train) if (test + train) > 0 else 0.0
    return val / (train + val) if (train + val) > 0 else 0.0


def split_sizes(n: int, train: float, val: float, test: float, compat: bool = True) -> tuple[int, int, int]:
    """(n_train, n_val, n_test) for ``n`` rows — the driver-side form of the rule."""
    n_test = math.ceil(test * n)
    n_val = math.ceil(val_fraction(train, val, test, compat) * (n - n_test))
    return n - n_test - n_val, n_val, n_test


def assign_split(df: DataFrame, train: float = 0.6, val: float = 0.2, test: float = 0.2, seed: int = 42,
                 key_cols: Sequence[str] = ("event_key",), strata: Sequence[str] = (),
                 tiebreak: Sequence[str] = (), compat: bool = True,
                 roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Add ``split`` ∈ {train, val, test}, exact sizes per stratum.

    ``strata`` = () pools all rows (X1), ("tag",) is X3, ("mass",) X4,
    ("mass", "tag") X5. All other columns (event ids included) are carried.
    """
    check_sizes(train, val, test)
    vf = val_fraction(train, val, test, compat)
    r = hash_rank(df, strata, seed, key_cols, tiebreak, out="_rank", group_totals=True)
    n = F.col("_rank_total")
    n_test = F.ceil(F.lit(float(test)) * n)
    n_val = F.ceil(F.lit(float(vf)) * (n - n_test))
    split = (F.when(F.col("_rank") <= n_test, "test")
             .when(F.col("_rank") <= n_test + n_val, "val").otherwise("train"))
    return r.withColumn(roles.split, split).drop("_rank", "_rank_total", "_h")


def with_rank(df: DataFrame, seed: int = 42, key_cols: Sequence[str] = ("event_key",), strata: Sequence[str] = (),
              tiebreak: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The split order as columns ``rank`` and ``rank_total`` (of its stratum), stored once. Every split share is
    then a predicate on them (:func:`part_condition`), so a grid over shares shuffles the rows once."""
    return materialize(hash_rank(df, strata, seed, key_cols, tiebreak, out=rank, group_totals=True).drop("_h"))


def part_condition(train: float, val: float, test: float, part: str, compat: bool = True, rank: str = "rank") -> str:
    """The SQL condition on ``rank`` and ``rank_total`` for one part of a split with these shares."""
    check_sizes(train, val, test)
    n = f"{rank}_total"
    n_test = f"ceil(cast({float(test)!r} as double) * {n})"
    n_val = f"ceil(cast({val_fraction(train, val, test, compat)!r} as double) * ({n} - {n_test}))"
    return {"test": f"{rank} <= {n_test}", "val": f"{rank} > {n_test} and {rank} <= {n_test} + {n_val}",
            "train": f"{rank} > {n_test} + {n_val}"}[part]


def two_way_split(df: DataFrame, test: float = 0.2, seed: int = 42, key_cols: Sequence[str] = ("event_key",),
                  strata: Sequence[str] = (), tiebreak: Sequence[str] = (),
                  roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """train/test only (val share 0)."""
    return assign_split(df, 1.0 - test, 0.0, test, seed, key_cols, strata, tiebreak, roles=roles)


def shuffle_key(df: DataFrame, seed: int, key_cols: Sequence[str], out: str = "shuffle_key") -> DataFrame:
    """Deterministic shuffle as an order column (sort only at the output)."""
    return df.withColumn(out, hash_order(seed, key_cols))


def per_class_sample(df: DataFrame, n_per_class: int, seed: int = 42, key_cols: Sequence[str] = ("event_key",),
                     tiebreak: Sequence[str] = (), roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """The first ``n_per_class`` rows of each class in hash order (a
    sampling operator: the row cap is the feature), by threshold selection."""
    return first_by_hash(df, n_per_class, seed, key_cols, tiebreak, [roles.label])


def hash_sample(df: DataFrame, n: int, seed: int = 42, key_cols: Sequence[str] = ("event_key",),
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """The first n rows in hash order, by threshold selection: a filter on the
    hash, and a ranking only of the rows at the bound."""
    return first_by_hash(df, n, seed, key_cols, tiebreak)
