"""The first n rows in hash order, per group, by threshold selection.

Taking the n smallest of all rows by a sort ends in one task that merges n rows of
every other task. Here the rows are counted by the first digits of their hash (a
small table, combined on the map side); the running count names the one prefix
that holds the n-th row. Rows with smaller prefixes are in by a plain filter, rows
with larger ones are out, and only the rows of that prefix are ranked, by range
partitioning, however many of them share one hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .prefix import HASH_BUCKET_DIGITS, hash_order
from .ranges import ranks
from .small import join_checked, with_scalars


def first_by_hash(df: DataFrame, n: int, seed, key_cols: Sequence[str], tiebreak: Sequence[str] = (),
                  group_cols: Sequence[str] = (), digits: int = HASH_BUCKET_DIGITS) -> DataFrame:
    """The ``n`` rows (of each group) that come first in ``md5(seed:key)`` order, then ``tiebreak``; all rows
    where there are no more. ``df`` is read three times: store it first when it is dear."""
    if n <= 0:
        return df.limit(0)
    group_cols = list(group_cols)
    d = df.withColumn("_h", hash_order(seed, key_cols)).withColumn("_p", F.substring("_h", 1, digits))
    gk = F.struct(*group_cols) if group_cols else F.lit(0)
    d = d.withColumn("_gk", gk)
    counts = d.groupBy("_gk", "_p").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("_gk").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = counts.withColumn("_run", F.sum("_c").over(upto)).where(
        (F.col("_run") >= n) & (F.col("_run") - F.col("_c") < n)).select(
        "_gk", F.col("_p").alias("_cut"), (F.lit(n) - F.col("_run") + F.col("_c")).alias("_need"))
    cuts = materialize(cuts)  # one row per group that has n rows
    if group_cols:
        j = join_checked(d, cuts, ["_gk"], "left")
    else:
        one = cuts.agg(F.max("_cut").alias("_cut"), F.max("_need").alias("_need"))
        j = with_scalars(d, one)
    sure = j.where(F.col("_cut").isNull() | (F.col("_p") < F.col("_cut"))).select(*df.columns)
    edge = j.where(F.col("_p") == F.col("_cut")).withColumn("_place", F.monotonically_increasing_id())
    # the place only spreads rows that tie in everything else
    edge = ranks(edge.drop("_gk"), group_cols, [F.col("_h"), *[F.col(c) for c in tiebreak], F.col("_place")], "_rank")
    return sure.unionByName(edge.where(F.col("_rank") <= F.col("_need")).select(*df.columns))
