"""Joining a small, data-derived table back onto the rows.

Statistics tables (limits, scaler moments, per-group means, distinct-score
totals) are aggregates whose size depends on the number of groups, not rows.
They are stored once in the shared checkpoint folder (one pass over the data,
reused by every later step), their row count is read from the stored table,
and they are broadcast only when that count is under a bound; above it the
join stays a shuffle join. One-row aggregates are computed once and attached
as literals (no join at all).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20


def stored(small: DataFrame) -> DataFrame:
    """Materialize a small aggregate once (lineage cut, survives executor loss)."""
    return materialize(small)


def with_scalars(df: DataFrame, one_row: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, computing the
    aggregate exactly ONCE (no join).

    Atomic and array values (limits, moments, means, cut points: bounded by
    the number of features or buckets) are fetched as that single row and
    inlined as typed literals, so the main plan gets constants Catalyst can
    fold. Other types (maps, structs) stay scalar subqueries over a stored
    copy of the row, which is cheap to read however often it is referenced."""
    cols = list(cols) if cols is not None else one_row.columns
    types = {f.name: f.dataType for f in one_row.schema.fields}
    simple = all(not isinstance(types[c], (T.MapType, T.StructType)) for c in cols)
    if simple:
        rows = one_row.select(*cols).take(2)
        if len(rows) != 1:
            raise ValueError(f"expected one row, got {len(rows)}")
        r = rows[0]
        return df.withColumns({c: F.lit(r[c]).cast(types[c]) for c in cols})
    one = stored(one_row.select(*cols))
    return df.withColumns({c: one.select(c).scalar() for c in cols})


def _bytes(df: DataFrame) -> int:
    """The planner's size of a table: the bytes of its files when it is stored."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_checked(big: DataFrame, small: DataFrame, on: Sequence[str] | None, how: str = "inner",
                 max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join ``small`` (already stored) onto ``big``: broadcast when it has at most
    ``max_rows`` rows and ``BROADCAST_MAX_BYTES`` stored bytes, a shuffle join otherwise. ``on=None`` means
    a one-row table, attached as scalar subqueries."""
    if on is None:
        return with_scalars(big, small)
    small_enough = small.count() <= max_rows and _bytes(small) <= BROADCAST_MAX_BYTES
    side = F.broadcast(small) if small_enough else small
    return big.join(side, list(on), how)
