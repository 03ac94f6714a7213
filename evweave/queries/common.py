"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_regex
from ..operators.select import drop_twodim
from ..sources.tables import event_view

SIGNAL = "sig"
FEATURES = ["f_qty", "f_price", "f_tax", "f_retail", "f_size"]
MASSES = [1000, 1500, 2000]
THRESHOLDS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]

# SQL fragments matching the Spark-side definitions below.
LABEL_SQL = "cast(regexp_matches(sample, '.*sig[^0-9]*') as int)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event view without the 2-D region, labelled by the L1 rule."""
    return drop_twodim(event_view(spark, sf_dir)).withColumn("label", label_regex("sample", SIGNAL))


def labelled_sr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal region without the data sample: the evaluation population."""
    ev = labelled(spark, sf_dir)
    return ev.where((F.col("region") == "SR") & (F.col("sample") != "data"))


LABELLED_CTE = f"lab as (select *, {LABEL_SQL} as label from ev where region <> 'TwoDimMassWindow')"
SR_CTE = "sr as (select * from lab where region = 'SR' and sample <> 'data')"
