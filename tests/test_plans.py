"""Plan regressions: pruning reaches the scan, no nested-loop or cartesian joins."""

import pytest

import __spark_entry__ as E
from evweave.registry import HEADLINE

from conftest import SF001


def _executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = _executed(E.queries()["a6_distribution_region_tag"](spark, SF001))
    line = [ln for ln in plan.splitlines() if "lineitem.parquet" in ln][0]
    schema = line[line.index("ReadSchema"):]
    for needed in ("l_partkey", "l_linenumber", "l_discount", "l_returnflag"):
        assert needed in schema
    for unused in ("l_shipdate", "l_linestatus", "l_tax", "l_comment"):
        assert unused not in schema


def test_partition_filter_prunes_dataset_folders(spark):
    plan = _executed(E.queries()["s5_merge_signal_file_with_backgrounds"](spark, SF001))
    scan = [ln for ln in plan.splitlines() if "PartitionFilters" in ln][0]
    assert "PartitionFilters: []" not in scan and "dataset" in scan


@pytest.mark.parametrize("name", HEADLINE)
def test_no_nested_loop_or_cartesian(spark, name):
    plan = _executed(E.queries()[name](spark, SF001))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
