"""Column roles of the event table and argument guards.

Every operator takes column names from a :class:`Roles` instance, so the same
code runs on the physics naming (``m_region``, ``m_FJNbtagJets``,
``EventWeight``) and on the event view built from the test tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values of the analysis: tag counts, the signal masses of the
# mass-parameterised studies, and the region that is always dropped.
TAGS = [0, 1, 2]
MASSES_PHYSICS = [1000, 1200, 1400, 1600, 1800, 2000, 2500, 3000]
TWO_DIM_REGION = "TwoDimMassWindow"
DATA_SAMPLE = "data"
FAKES_SAMPLE = "fakes"
# The fourteen features of the physics tables, in their documented order.
PHYSICS_FEATURES = [
    "m_FJpt", "m_FJeta", "m_FJphi", "m_FJm", "m_DTpt", "m_DTeta", "m_DTphi", "m_DTm",
    "m_dPhiFTwDT", "m_dRFJwDT", "m_dPhiDTwMET", "m_MET", "m_hhm", "m_bbttpt",
]


@dataclass(frozen=True)
class Roles:
    region: str = "region"
    tag: str = "tag"
    weight: str = "weight"
    sample: str = "sample"
    event_id: str = "event_number"
    key: str = "event_key"
    label: str = "label"
    score: str = "score"
    mass: str = "mass"
    split: str = "split"
    features: tuple = ("f_qty", "f_price", "f_tax", "f_retail", "f_size")


PHYSICS_ROLES = Roles(region="m_region", tag="m_FJNbtagJets", weight="EventWeight",
                      sample="sample", event_id="EventNumber", key="EventNumber",
                      features=tuple(PHYSICS_FEATURES))

DEFAULT_ROLES = Roles()

# Declared schema of the physics event files (no inference at read time).
PHYSICS_SCHEMA = T.StructType(
    [T.StructField("sample", T.StringType()),
     T.StructField("EventWeight", T.DoubleType()),
     T.StructField("EventWeightNoXSec", T.DoubleType()),
     T.StructField("EventNumber", T.LongType()),
     T.StructField("m_region", T.StringType()),
     T.StructField("m_FJNbtagJets", T.IntegerType())]
    + [T.StructField(f, T.DoubleType()) for f in PHYSICS_FEATURES]
)

EVENT_VIEW_SCHEMA = T.StructType([
    T.StructField("event_key", T.StringType()),
    T.StructField("event_number", T.LongType()),
    T.StructField("region", T.StringType()),
    T.StructField("tag", T.IntegerType()),
    T.StructField("sample", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("f_qty", T.DoubleType()),
    T.StructField("f_price", T.DoubleType()),
    T.StructField("f_tax", T.DoubleType()),
    T.StructField("f_retail", T.DoubleType()),
    T.StructField("f_size", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
])


def check_sizes(train: float, val: float, test: float) -> None:
    """Split shares must be non-negative and add to one."""
    for v in (train, val, test):
        if v < 0 or v > 1:
            raise ValueError(f"split share out of range: {v}")
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError(f"split shares must add to 1, got {train + val + test}")


def check_in(name: str, value, allowed) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name}={value!r} not in {list(allowed)}")


def check_columns(df, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
