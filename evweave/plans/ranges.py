"""Exact running sums and ranks of any size, by range partitioning.

The rows are dealt by range of (group, order) to as many partitions as the data
needs and sorted there. One streaming pass per partition (Arrow batches, constant
memory) writes the running sums inside the partition; the partitions' totals per
group are a small table, whose running totals are the offsets to add. So the rows
are shuffled once, no cut points are guessed, and no group or bucket is held by
one task: a group that makes up a third of all rows spans a third of the
partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .small import join_checked


def _local_sums(schema: T.StructType, values: list[str], whole: list[bool]):
    """The batch function: running sums of ``values`` since the last change of ``_gh``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry: list = [0] * len(values)
        last = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column(b.schema.get_field_index("_gh")).to_numpy()
            new = np.empty(n, bool)
            new[0] = last is not None and g[0] != last
            new[1:] = g[1:] != g[:-1]
            starts = np.flatnonzero(new)
            segment = np.cumsum(new)  # 0: goes on from the batch before
            cols = []
            for i, (name, exact) in enumerate(zip(values, whole)):
                v = b.column(b.schema.get_field_index(name)).fill_null(0).to_numpy(zero_copy_only=False)
                c = np.cumsum(v)
                base = np.concatenate([[c.dtype.type(-carry[i])], c[starts] - v[starts]])
                out = c - base[segment]
                carry[i] = out[-1]
                cols.append(pa.array(out, pa.int64() if exact else pa.float64()))
            last = g[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, pa.array(np.full(n, part, np.int32))], names=schema.fieldNames())

    return run


def running_sums(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], sums: dict,
                 group_totals: bool = False) -> DataFrame:
    """Add inclusive running sums ``{out_name: value}`` in ``order`` within ``group_cols`` and, with
    ``group_totals``, each group's total as ``{out_name}_total``.

    Whole-number values are summed as longs, others as doubles; a null value counts as 0. Rows that tie in
    ``order`` follow each other in any order. ``df`` is read twice (range sampling, rows): store it first
    when it is dear. The result is read from a stored table."""
    group_cols = list(group_cols)
    vals = {k: (v if isinstance(v, Column) else F.col(v)) for k, v in sums.items()}
    d = df.select("*", F.xxhash64(*[F.col(c) for c in group_cols], F.lit(0)).alias("_gh"),
                  *[v.alias(f"_v_{k}") for k, v in vals.items()])
    whole = [isinstance(d.schema[f"_v_{k}"].dataType, T.IntegralType) for k in vals]
    d = d.withColumns({f"_v_{k}": F.col(f"_v_{k}").cast("long" if w else "double") for k, w in zip(vals, whole)})
    keys = [F.col(c).asc_nulls_first() for c in group_cols] + list(order)
    d = d.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType(d.schema.fields + [T.StructField(f"_l_{k}", T.LongType() if w else T.DoubleType())
                                             for k, w in zip(vals, whole)] + [T.StructField("_part", T.IntegerType())])
    rows = materialize(d.mapInArrow(_local_sums(schema, [f"_v_{k}" for k in vals], whole), schema))
    # one row per (partition, group in it)
    totals = rows.groupBy("_gh", "_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in vals])
    before = Window.partitionBy("_gh").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_gh")
    offsets = materialize(totals.select(
        "_gh", "_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in vals],
        *([F.sum(f"_t_{k}").over(every).alias(f"{k}_total") for k in vals] if group_totals else [])))
    out = join_checked(rows, offsets, ["_gh", "_part"])
    return out.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in vals],
                      *([f"{k}_total" for k in vals] if group_totals else []))


def ranks(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """The exact 1-based position of every row in ``order`` within its group."""
    return running_sums(df, group_cols, order, {out: F.lit(1).cast("long")})
