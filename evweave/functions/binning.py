"""Equal-width bin expressions shared by the histogram operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(x: Column, lo: Column, hi: Column, n: int, keep_flow: bool = False) -> Column:
    """1-based bin of ``x`` among ``n`` equal bins over [lo, hi].

    The right edge belongs to the last bin. With ``keep_flow`` values below
    ``lo`` go to bin 0 and values above ``hi`` to bin n+1 (under/overflow);
    otherwise they get null. A zero-width range puts every value in bin 1.
    """
    width = hi - lo
    raw = F.floor(F.try_divide(x - lo, width) * F.lit(n)) + F.lit(1)
    inside = F.when(width == 0, F.lit(1)).otherwise(F.least(raw, F.lit(n))).cast("int")
    if keep_flow:
        return (F.when(x < lo, F.lit(0)).when(x > hi, F.lit(n + 1)).otherwise(inside)).cast("int")
    return F.when((x >= lo) & (x <= hi), inside).cast("int")


def bin_center(b: Column, lo: Column, hi: Column, n: int) -> Column:
    """Centre of 1-based bin ``b``."""
    return lo + (b.cast("double") - F.lit(0.5)) * (hi - lo) / F.lit(float(n))
