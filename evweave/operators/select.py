"""Selection, labelling and products over the event table (P*, L2, J1, J9, U*).

Every function is a lazy DataFrame transformation; filters sit directly on
the scan so Catalyst pushes them into Parquet (and prunes partitions when the
store is partitioned by role/dataset/region).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_exact, label_regex, mass_from_sample
from ..schema import DATA_SAMPLE, DEFAULT_ROLES, FAKES_SAMPLE, TWO_DIM_REGION, Roles


# --- P1–P6: filters -----------------------------------------------------------

def filter_region(df: DataFrame, region: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return df.where(F.col(roles.region) == region)


def filter_tag(df: DataFrame, tag: int, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return df.where(F.col(roles.tag) == tag)


def filter_sample(df: DataFrame, sample: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return df.where(F.col(roles.sample) == sample)


def drop_fakes(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return df.where(F.col(roles.sample) != FAKES_SAMPLE)


def drop_twodim(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return df.where(F.col(roles.region) != TWO_DIM_REGION)


def preprocess(df: DataFrame, region: str | None = None, tag: int | None = None,
               roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Optional region and optional tag filter (None = no filter)."""
    if region is not None:
        df = filter_region(df, region, roles)
    if tag is not None:
        df = filter_tag(df, tag, roles)
    return df


def preprocess_v1(df: DataFrame, signal: str, region: str | None = None, tag: int | None = None,
                  roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Drop the 2-D region, optional region/tag filter, then label by L1."""
    return (preprocess(drop_twodim(df, roles), region, tag, roles)
            .withColumn(roles.label, label_regex(roles.sample, signal)))


# --- P8–P10: projections ------------------------------------------------------

def project_training(df: DataFrame, features: Sequence[str] | None = None, include_event: bool = False,
                     keep_tag: bool = True, keep_region: bool = False,
                     roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Weight, label, [event id], [tag], [region], features."""
    cols = [roles.weight, roles.label]
    if include_event:
        cols.append(roles.event_id)
    if keep_tag:
        cols.append(roles.tag)
    if keep_region:
        cols.append(roles.region)
    cols += list(features if features is not None else roles.features)
    return df.select(*cols)


def drop_columns(df: DataFrame, blacklist: Sequence[str]) -> DataFrame:
    """P10: drop a column list (names absent from the table are ignored)."""
    return df.drop(*blacklist)


# --- P11–P16 ------------------------------------------------------------------

def filter_samples(df: DataFrame, samples: Sequence[str], roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Membership on a fixed sample list (an IN predicate, pushed to the scan)."""
    return df.where(F.col(roles.sample).isin(list(samples)))


def category(df: DataFrame, signal_samples: Sequence[str], data_sample: str = DATA_SAMPLE,
             roles: Roles = DEFAULT_ROLES, out: str = "category") -> DataFrame:
    """Data / signal / background-by-exclusion in one column."""
    s = F.col(roles.sample)
    return df.withColumn(out, F.when(s == data_sample, "data")
                         .when(s.isin(list(signal_samples)), "signal").otherwise("background"))


def non_negative_weights(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """P13."""
    return df.where(F.col(roles.weight) >= 0)


def keep_class(df: DataFrame, label: int, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """One class only (used for one-class reconstruction models)."""
    return df.where(F.col(roles.label) == label)


def test_slice(df: DataFrame, tag: int | None = None, mass: int | None = None,
               roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Test rows of one tag and/or mass of a split table."""
    df = df.where(F.col(roles.split) == "test")
    if tag is not None:
        df = df.where(F.col(roles.tag) == tag)
    if mass is not None:
        df = df.where(F.col(roles.mass) == mass)
    return df


def misclassified(df: DataFrame, prediction: str = "prediction", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """P16."""
    return df.where(F.col(prediction) != F.col(roles.label))


# --- labels over several sources (L2, L3) ---------------------------------------

def label_sources(signals: Sequence[DataFrame] | DataFrame, background: DataFrame,
                  roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """L2: signal tables get label 1, background 0, then a by-name union."""
    if isinstance(signals, DataFrame):
        signals = [signals]
    parts = [s.withColumn(roles.label, F.lit(1)) for s in signals]
    parts.append(background.withColumn(roles.label, F.lit(0)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def label_by_sample(df: DataFrame, signal: str, exclude_data: bool = True,
                    roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """L3: exact-name label, with the data sample removed first."""
    if exclude_data:
        df = df.where(F.col(roles.sample) != DATA_SAMPLE)
    return df.withColumn(roles.label, label_exact(roles.sample, signal))


# --- J1: mass-parameterised dataset ---------------------------------------------

def mass_parameterised(df: DataFrame, masses: Sequence[int], signal_prefix: str = "sig",
                       roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Every signal row keeps its own mass (label 1); every background row
    is repeated once per mass (label 0) — an ``explode`` of the fixed mass
    list, so no join is involved."""
    s = F.col(roles.sample)
    is_sig = s.startswith(signal_prefix)
    mass_arr = F.array(*[F.lit(int(m)) for m in masses])
    own = F.filter(mass_arr, lambda m: m == mass_from_sample(s))  # empty: another mass
    d = df.withColumn(roles.label, F.when(is_sig, 1).otherwise(0))  # one pass over the input
    return d.where(s.isNotNull()).withColumn(roles.mass, F.explode(F.when(is_sig, own).otherwise(mass_arr)))


# --- U1, U2, U4 / J9 ------------------------------------------------------------

def concat(dfs: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def concat_keyed(dfs: Mapping[str, DataFrame], key_col: str = "dataset") -> DataFrame:
    """Union of a mapping of tables with the key as a column."""
    return concat([d.withColumn(key_col, F.lit(k)) for k, d in dfs.items()])


def difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right`` (left anti join)."""
    return left.join(right.select(*on), list(on), "left_anti")


def with_label_expr(df: DataFrame, expr: Column, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return df.withColumn(roles.label, expr)
