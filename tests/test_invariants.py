"""Invariants of the operators (split sizes, ranks, bins, curves, profiles)."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evweave.functions.binning import bin_index
from evweave.operators import hist as H
from evweave.operators import metrics as M
from evweave.operators import profile as P
from evweave.operators import split as X
from evweave.plans.prefix import hash_order, hash_rank
from evweave.queries.common import labelled, labelled_sr

from conftest import SF001, SF01


@pytest.mark.parametrize("sizes,compat", [((0.6, 0.2, 0.2), True), ((0.5, 0.3, 0.2), True),
                                          ((0.5, 0.3, 0.2), False), ((0.7, 0.0, 0.3), True)])
def test_split_sizes_exact_and_disjoint(spark, sizes, compat):
    d = labelled(spark, SF01).select("event_key", "tag")
    s = X.assign_split(d, *sizes, seed=7, strata=["tag"], compat=compat)
    got = {(r["tag"], r["split"]): r["count"] for r in s.groupBy("tag", "split").count().collect()}
    ns = {r["tag"]: r["count"] for r in d.groupBy("tag").count().collect()}
    for tag, n in ns.items():
        n_train, n_val, n_test = X.split_sizes(n, *sizes, compat=compat)
        assert got.get((tag, "train"), 0) == n_train
        assert got.get((tag, "val"), 0) == n_val
        assert got.get((tag, "test"), 0) == n_test
    assert s.count() == d.count() == s.select("event_key").distinct().count()


def test_q1_compat_shares():
    # val share val/(test+train) on the remainder: (0.5, 0.3, 0.2) → val ≈ 0.343·... of n
    tr, va, te = X.split_sizes(1000, 0.5, 0.3, 0.2, compat=True)
    assert (te, va) == (200, math.ceil(0.3 / 0.7 * 800))
    tr2, va2, te2 = X.split_sizes(1000, 0.5, 0.3, 0.2, compat=False)
    assert (te2, va2, tr2) == (200, 300, 500)


def test_bucketed_rank_equals_window_rank(spark):
    d = labelled(spark, SF01).select("event_key", "tag")
    r = hash_rank(d, ["tag"], 11, ["event_key"], out="rk", digits=2)
    plain = d.withColumn("rk2", F.row_number().over(
        Window.partitionBy("tag").orderBy(hash_order(11, ["event_key"]))))
    j = r.join(plain, ["event_key", "tag"])
    assert j.where(F.col("rk") != F.col("rk2")).count() == 0
    assert j.count() == d.count()


def test_max_value_in_last_bin(spark):
    d = spark.createDataFrame([(0.0,), (1.5,), (3.0,)], "x double")
    b = [r[0] for r in d.select(bin_index(F.col("x"), F.lit(0.0), F.lit(3.0), 3)).collect()]
    assert b == [1, 2, 3]
    flow = [r[0] for r in spark.createDataFrame([(-1.0,), (4.0,)], "x double").select(
        bin_index(F.col("x"), F.lit(0.0), F.lit(3.0), 3, keep_flow=True)).collect()]
    assert flow == [0, 4]


def test_histogram_integral_equals_yield(spark):
    ev = labelled(spark, SF001)
    h = H.histogram(ev, "f_qty", 30, by=["sample"])
    hs = {r["sample"]: r["s"] for r in h.groupBy("sample").agg(F.sum("sum_w").alias("s")).collect()}
    ys = {r["sample"]: r["yield"] for r in P.weighted_yield(ev, ["sample"]).collect()}
    for k, v in ys.items():
        assert hs[k] == pytest.approx(v, abs=1e-9)


def test_auc_symmetry_and_ties(spark):
    d = labelled_sr(spark, SF01)
    a = M.roc_auc(d, weight=None).first()["auc"]
    b = M.roc_auc(d.withColumn("score", -F.col("score")), weight=None).first()["auc"]
    assert a + b == pytest.approx(1.0, abs=1e-12)
    flat = M.roc_auc(d.withColumn("score", F.lit(0.5)), weight=None).first()["auc"]
    assert flat == pytest.approx(0.5)


def test_auc_matches_pairwise_count(spark):
    # Mann–Whitney: P(score_pos > score_neg) + ½ P(tie) on a small fixture
    d = labelled_sr(spark, SF001).select("label", "score")
    rows = d.collect()
    pos = [r["score"] for r in rows if r["label"] == 1]
    neg = [r["score"] for r in rows if r["label"] == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert M.roc_auc(d, weight=None).first()["auc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-9)


def test_slices_sum_to_total(spark):
    d = M.with_prediction(labelled_sr(spark, SF01), 0.4)
    per = M.confusion(d, ["tag"]).agg(*[F.sum(f"n_{c}").alias(c) for c in M.CELLS]).first()
    tot = M.confusion(d).first()
    assert all(per[c] == tot[f"n_{c}"] for c in M.CELLS)


def test_wavg_zero_weight_fallback(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 0, -1.0), ("b", 1, 2.0)], "g string, label int, weight double")
    r = {x["g"]: x["signal_w_density"] for x in P.signal_distribution_per(d, ["g"]).collect()}
    assert r["a"] == 0.5 and r["b"] == 1.0


def test_threshold_sweep_equals_single_threshold(spark):
    d = labelled_sr(spark, SF01)
    sweep = {r["th"]: r for r in M.threshold_cells(d, [0.3, 0.5]).collect()}
    for th in (0.3, 0.5):
        one = M.confusion(M.with_prediction(d, th)).first()
        assert all(sweep[th][f"n_{c}"] == one[f"n_{c}"] for c in M.CELLS)
        assert all(sweep[th][f"w_{c}"] == pytest.approx(one[f"w_{c}"]) for c in M.CELLS)


def test_distribution_group_equals_filtered(spark):
    ev = labelled(spark, SF01)
    g = P.signal_distribution_per(ev, ["region", "tag"]).where((F.col("region") == "SR") & (F.col("tag") == 1)).first()
    f = P.signal_distribution_per(ev.where((F.col("region") == "SR") & (F.col("tag") == 1))).first()
    assert g["total_count"] == f["total_count"] and g["signal_count"] == f["signal_count"]
    assert g["signal_w_density"] == pytest.approx(f["signal_w_density"])


def test_drop_fakes_invariance(spark):
    ev = labelled(spark, SF01)
    from evweave.operators.select import drop_fakes
    a = {(r["region"], r["tag"]): r["total_count"] for r in
         P.signal_distribution_per(drop_fakes(ev), ["region", "tag"]).collect()}
    b = {(r["region"], r["tag"]): r["total_count"] for r in
         P.signal_distribution_per(ev.where(F.col("sample") != "fakes"), ["region", "tag"]).collect()}
    n_fakes = ev.where(F.col("sample") == "fakes").count()
    tot = ev.count()
    assert a == b and sum(a.values()) == tot - n_fakes


def test_all_masses_level_is_the_sum(spark):
    from evweave.queries.sweep_q import comb_scores
    d = comb_scores(spark, SF001, with_mass=True)
    cells = M.threshold_cells(d, [0.3, 0.6], ["comb", "mass"])
    summed = {(r["comb"], r["th"]): r["s"] for r in
              cells.groupBy("comb", "th").agg(F.sum("w_tp").alias("s")).collect()}
    lv = M.f1_per_threshold_levels(d, [0.3, 0.6], "comb", "mass")
    per_all = M.threshold_cells(d, [0.3, 0.6], ["comb"])
    direct = {(r["comb"], r["th"]): r["w_tp"] for r in per_all.collect()}
    assert summed.keys() == direct.keys()
    for k in summed:
        assert summed[k] == pytest.approx(direct[k])
    assert lv.where(F.col("mass") == "all").count() == len(direct)


def test_stack_top_equals_bin_total(spark):
    ev = labelled(spark, SF001)
    h = H.histogram(ev, "f_qty", 10, by=["sample"])
    st = H.background_stack(h)
    top = st.groupBy("bin").agg(F.max("stacked_w").alias("a"), F.first("total_w").alias("b"))
    # the running stack over samples ends at the bin total
    last = st.join(st.groupBy("bin").agg(F.max("sample").alias("sample")), ["bin", "sample"])
    assert last.where(F.abs(F.col("stacked_w") - F.col("total_w")) > 1e-9).count() == 0
    assert top.count() == 10
