"""Readers for the driver tables and the event view built on them.

The event view maps the star-schema test tables onto the event model: one row
per line item, a region from the return flag, a tag from the line number, a
physics-like sample name from the part type, a signed weight and five features.
Only the columns the view needs are read, so the Parquet scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
_PART_COLS = ["p_partkey", "p_type", "p_size", "p_retailprice"]


def table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _sample_expr(p_type: Column, p_size: Column) -> Column:
    return (F.when(p_type == "PROMO",
                   F.concat(F.lit("sig"), (F.lit(1000) + F.lit(500) * (p_size % 3)).cast("string")))
            .when(p_type == "SMALL", "data")
            .when(p_type == "MEDIUM", "fakes")
            .when(p_type == "LARGE", "ttbar")
            .when(p_type == "STANDARD", "Zbb")
            .otherwise("WW"))


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table over ``lineitem`` joined with ``part``.

    The join is a plain equi-join: at scale ``part`` grows with the data, so
    the strategy is left to Catalyst/AQE (runtime broadcast only when the
    measured side is small, sort-merge otherwise).
    """
    li = table(spark, sf_dir, "lineitem", _LINEITEM_COLS)
    p = table(spark, sf_dir, "part", _PART_COLS)
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    promo = F.when(F.col("p_type") == "PROMO", F.lit(0.8)).otherwise(F.lit(0.0))
    z = (F.col("l_quantity") - F.lit(25.0)) / F.lit(10.0) + promo
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("event_key"),
        F.col("l_orderkey").alias("event_number"),
        F.when(F.col("l_returnflag") == "A", "SR").when(F.col("l_returnflag") == "R", "QCDCR")
         .otherwise("TwoDimMassWindow").alias("region"),
        (F.col("l_linenumber") % 3).cast("int").alias("tag"),
        _sample_expr(F.col("p_type"), F.col("p_size")).alias("sample"),
        F.round(F.col("l_discount") - F.lit(0.02), 2).alias("weight"),
        F.col("l_quantity").alias("f_qty"),
        F.col("l_extendedprice").alias("f_price"),
        F.col("l_tax").alias("f_tax"),
        F.col("p_retailprice").alias("f_retail"),
        F.col("p_size").cast("double").alias("f_size"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6).alias("score"),
    )


# The same view as SQL text, for DuckDB oracles (ANSI, runs unchanged on Spark).
EVENT_VIEW_SQL = """
select
  concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                 cast(l_partkey as string), cast(l_suppkey as string))      as event_key,
  l_orderkey                                                                as event_number,
  case l_returnflag when 'A' then 'SR' when 'R' then 'QCDCR'
                    else 'TwoDimMassWindow' end                             as region,
  cast(l_linenumber % 3 as int)                                             as tag,
  case p_type when 'PROMO' then concat('sig', cast(1000 + 500 * (p_size % 3) as string))
              when 'SMALL' then 'data'   when 'MEDIUM' then 'fakes'
              when 'LARGE' then 'ttbar'  when 'STANDARD' then 'Zbb' else 'WW' end as sample,
  round(l_discount - 0.02, 2)                                               as weight,
  l_quantity as f_qty, l_extendedprice as f_price, l_tax as f_tax,
  p_retailprice as f_retail, cast(p_size as double)                         as f_size,
  round(1.0 / (1.0 + exp(-((l_quantity - 25.0) / 10.0
        + case when p_type = 'PROMO' then 0.8 else 0.0 end))), 6)           as score
from lineitem join part on l_partkey = p_partkey
"""


def embedding_table(spark: SparkSession, sf_dir: str, positive_label: int = 0) -> DataFrame:
    """``embeddings`` as a labelled feature table: one class against the rest."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id"),
                    (F.col("label") == positive_label).cast("int").alias("label"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("x"))
