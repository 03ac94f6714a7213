"""The driver contract: entry() runs; every oracle query matches DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from evweave.sources.tables import TABLES

from conftest import SF01

ORACLES = E.oracle_sql()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["region", "tag", "signal_w_density", "signal_density", "signal_count", "total_count"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF01}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return ("f", None if math.isnan(v) else round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if isinstance(v, bool):
        return ("i", int(v))
    if isinstance(v, (bytes, bytearray)):
        return ("b", bytes(v))
    return (type(v).__name__, v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_matches(spark, con, name):
    df = E.queries()[name](spark, SF01)
    rows, cols = df.collect(), df.columns
    r = con.execute(ORACLES[name])
    dcols = [d[0] for d in r.description]
    drows = r.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    o = sorted(range(len(cols)), key=lambda i: cols[i])
    od = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted(repr(tuple(_norm(x[i]) for i in o)) for x in rows)
    b = sorted(repr(tuple(_norm(x[i]) for i in od)) for x in drows)
    assert a == b


def test_package_functions_ship_by_value():
    # Python UDFs must not need the package on the executors' import path
    from pyspark import cloudpickle

    import evweave.operators.rank as rank
    assert cloudpickle.cloudpickle._is_registered_pickle_by_value(rank)
