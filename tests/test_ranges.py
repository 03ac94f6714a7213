"""Range-partitioned running sums and threshold selection against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evweave.operators import metrics as M
from evweave.operators import split as X
from evweave.plans.prefix import hash_order
from evweave.plans.ranges import ranks, running_sums
from evweave.plans.threshold import first_by_hash
from evweave.session import materialize


def _rows(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaaaaabc"), rng.randint(0, 50), rng.gauss(0, 1), rng.randint(-5, 5)) for i in range(n)]
    rows += [(n + 1, None, 3, 0.5, 1), (n + 2, None, 4, 0.25, None), (n + 3, "d", None, 1.0, 2)]
    return materialize(spark.createDataFrame(rows, "id long, g string, o int, v double, k int").repartition(6))


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_sums_equal_a_window(spark, groups):
    d = _rows(spark)
    order = [F.col("o").desc_nulls_last(), F.col("id")]
    got = running_sums(d, groups, order, {"sv": "v", "sk": "k"}, group_totals=True)
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = d.select("id", F.sum(F.coalesce("v", F.lit(0.0))).over(w).alias("wv"), F.sum(F.coalesce("k", F.lit(0))).over(w).alias("wk"),
                    F.sum("k").over(Window.partitionBy(*groups)).alias("tk"))
    j = got.join(want, "id")
    assert j.count() == d.count() == got.count()
    assert j.where((F.abs(F.col("sv") - F.col("wv")) > 1e-9) | (F.col("sk") != F.col("wk"))
                   | (F.col("sk_total") != F.col("tk"))).count() == 0


def test_running_sums_of_nothing(spark):
    d = _rows(spark).where("id < 0")
    assert running_sums(d, ["g"], [F.col("o")], {"s": "v"}).count() == 0


def test_ranks_of_ties_use_each_place_once(spark):
    d = spark.range(1000).withColumn("x", F.lit(7))
    got = [r["rank"] for r in ranks(d, [], [F.col("x")]).collect()]
    assert sorted(got) == list(range(1, 1001))


@pytest.mark.parametrize("n", [0, 1, 57, 3000, 10_000])
def test_first_by_hash_equals_sort_and_limit(spark, n):
    d = _rows(spark)
    got = {r["id"] for r in first_by_hash(d, n, 9, ["id"]).collect()}
    want = {r["id"] for r in d.orderBy(hash_order(9, ["id"])).limit(n).collect()}
    assert got == want
    for digits in (1, 2):
        assert {r["id"] for r in first_by_hash(d, n, 9, ["id"], digits=digits).collect()} == want


def test_first_by_hash_per_group_with_shared_hashes(spark):
    d = _rows(spark)  # the key has 51 values, so the bound falls among rows that share a hash
    got = first_by_hash(d, 100, 3, ["o"], ["id"], ["g"])
    w = Window.partitionBy("g").orderBy(hash_order(3, ["o"]), "id")
    want = d.withColumn("r", F.row_number().over(w)).where("r <= 100")
    assert sorted((r["id"] for r in got.collect())) == sorted(r["id"] for r in want.collect())


def test_sample_plan_merges_nothing_in_one_task(spark):
    d = _rows(spark)
    plan = X.hash_sample(d, 50, 1, ["id"])._jdf.queryExecution().executedPlan().toString()
    for node in ("TakeOrderedAndProject", "GlobalLimit", "SinglePartition", "Sort "):
        assert node not in plan
    assert X.hash_sample(d, 50, 1, ["id"]).count() == 50


def test_curve_of_a_continuous_score(spark):
    rng = random.Random(5)
    rows = [(i % 3, int(rng.random() < 0.3), rng.random(), rng.uniform(-0.2, 1.0)) for i in range(5000)]
    d = materialize(spark.createDataFrame(rows, "tag int, label int, score double, weight double").repartition(5))
    got = {r["tag"]: r["auc"] for r in M.roc_auc(d, ["tag"]).collect()}
    for tag in range(3):
        mine = sorted(((s, y, w) for t, y, s, w in rows if t == tag), reverse=True)
        tp = area = 0.0
        for _, y, w in mine:
            if y:
                tp += w
            else:
                area += w * tp
        neg = sum(w for _, y, w in mine if not y)
        assert got[tag] == pytest.approx(area / (tp * neg), abs=1e-9)
