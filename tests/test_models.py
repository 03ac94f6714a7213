"""Model-dependent operators: invariants instead of golden values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evweave.operators import dense as D
from evweave.operators import models as MD
from evweave.operators.neighbours import nearest_points
from evweave.operators import rank as R
from evweave.operators import resample as RS
from evweave.operators import split as X
from evweave.queries.common import FEATURES
from evweave.queries.model_q import prepared

from conftest import SF001


@pytest.fixture(scope="module")
def data(spark):
    p = prepared(spark, SF001).persist()
    return p.where(F.col("split") == "train"), p.where(F.col("split") == "test")


def test_negative_weight_policies(spark, data):
    train, _ = data
    n_neg = train.where(F.col("weight") < 0).count()
    assert n_neg > 0
    assert MD.training_weights(train, "weight", "drop").count() == train.count() - n_neg
    assert MD.training_weights(train, "weight", "abs").where(F.col("_w") < 0).count() == 0
    with pytest.raises(ValueError):
        MD.training_weights(train, "weight", "bogus")


def test_score_in_unit_interval(spark, data):
    train, test = data
    m = MD.fit_classifier(train, FEATURES, "logistic", negative_weights="signed")
    s = MD.score(m, test)
    r = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    assert 0.0 <= r["lo"] <= r["hi"] <= 1.0 and r["n"] == test.count()
    h = MD.training_history(m)
    assert h is not None and h.count() >= 1


def test_shapley_additivity(spark, data):
    train, test = data
    m = MD.fit_classifier(train, FEATURES, "logistic", negative_weights="signed")
    bg = X.hash_sample(train, 20, 1)
    rows = test.limit(30)
    att = R.sampled_shapley(m, rows, bg, FEATURES, "event_key", permutations=4, seed=3)
    tot = att.groupBy("event_key").agg(F.sum("attribution").alias("s"))
    # f(x) − mean over permutations of f(b(x, p)), recomputed independently
    fx = MD.score(m, rows, "fx", round_digits=None).select("event_key", "fx")
    bgi = bg.select(*FEATURES).collect()
    bgi = sorted(bgi, key=lambda r: tuple(r))
    fb_rows = spark.createDataFrame([tuple(r) + (i,) for i, r in enumerate(bgi)],
                                    ", ".join(f"{c} double" for c in FEATURES) + ", bi int")
    fb = MD.score(m, fb_rows, "fb", round_digits=None).select("bi", "fb")
    pick = rows.select("event_key", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p")).withColumn(
        "bi", F.pmod(F.xxhash64(F.lit(3), F.col("event_key"), F.col("p")), F.lit(len(bgi))).cast("int"))
    mb = pick.join(fb, "bi").groupBy("event_key").agg(F.avg("fb").alias("mfb"))
    chk = tot.join(fx, "event_key").join(mb, "event_key").collect()
    assert len(chk) == 30
    for r in chk:
        assert r["s"] == pytest.approx(r["fx"] - r["mfb"], abs=1e-9)


def test_knn_exact_against_brute_force(spark, data):
    train, _ = data
    mino = train.where(F.col("label") == 1)
    pts = RS.collapse(mino, FEATURES)
    nb = nearest_points(pts.select("c"), pts, 3, True)
    got = {}
    for r in nb.collect():
        got.setdefault(tuple(r["c"]), []).extend([r["dist"]] * int(r["take"]))
    allp = [(tuple(r["c"]), r["mult"]) for r in pts.collect()]
    for c, _ in allp:
        ds = []
        for o, m in allp:
            d = math.dist(c, o)
            ds += [d] * (m - 1 if o == c else m)
        want = sorted(ds)[:3]
        assert sorted(got[c]) == pytest.approx(want, abs=1e-9)


def test_smote_counts_and_segments(spark, data):
    train, _ = data
    ov = RS.Oversampler(train, FEATURES, k=3, minority=1)
    out = ov.smote(0.5)
    n_syn = ov.n_synthetic(0.5)
    assert out.where("synthetic").count() == n_syn
    assert out.where(~F.col("synthetic")).count() == train.count()
    # synthetic points stay inside the minority bounding box
    lim = train.where(F.col("label") == 1).agg(*[F.min(c).alias(f"lo_{c}") for c in FEATURES],
                                               *[F.max(c).alias(f"hi_{c}") for c in FEATURES]).first()
    s = out.where("synthetic")
    for c in FEATURES:
        r = s.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
        assert lim[f"lo_{c}"] - 1e-9 <= r["a"] and r["b"] <= lim[f"hi_{c}"] + 1e-9
    mw = train.agg(F.avg("weight")).first()[0]
    assert s.agg(F.max(F.abs(F.col("weight") - F.lit(mw)))).first()[0] == pytest.approx(0.0)
    ad = ov.adasyn(0.5).where("synthetic").count()
    assert abs(ad - n_syn) <= ov.n_min  # rint per row


def test_dense_unrolled_equals_pandas(spark, data):
    train, _ = data
    layers = D.rule_network(len(FEATURES), 3, 2)
    a = D.dense_score(train, FEATURES, layers, "s", round_digits=None).select("event_key", "s")
    old = D.UNROLL_LIMIT
    D.UNROLL_LIMIT = 0
    try:
        b = D.dense_score(train, FEATURES, layers, "t", round_digits=None).select("event_key", "t")
    finally:
        D.UNROLL_LIMIT = old
    diff = a.join(b, "event_key").agg(F.max(F.abs(F.col("s") - F.col("t")))).first()[0]
    assert diff < 1e-12
    t = D.layers_to_table(spark, layers)
    back = D.layers_from_table(t)
    assert all((w1 == w2).all() and (b1 == b2).all() and a1 == a2 for (w1, b1, a1), (w2, b2, a2) in zip(layers, back))


def test_pca_reconstruction_error_nonnegative(spark):
    from evweave.sources.tables import embedding_table
    e = embedding_table(spark, SF001, 0)
    mean, pca = MD.fit_reconstruction(e.where(F.col("label") == 0), "x", 3)
    d = MD.reconstruction_error(e, mean, pca, "x")
    r = d.agg(F.min("error").alias("lo"), F.count(F.lit(1)).alias("n")).first()
    assert r["lo"] >= 0 and r["n"] == e.count()


def test_chi2_matches_formula(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 3.0), (0, 2.0), (0, 2.0), (0, 0.0)], "label int, x double")
    got = R.chi2_scores(d, ["x"]).first()["chi2"]
    obs = {1: 4.0, 0: 4.0}
    tot = 8.0
    exp = {1: 2 / 5 * tot, 0: 3 / 5 * tot}
    assert got == pytest.approx(sum((obs[c] - exp[c]) ** 2 / exp[c] for c in obs))
    p = R.chi2_pvalues(R.chi2_scores(d, ["x"])).first()["p_value"]
    assert p == pytest.approx(math.erfc(math.sqrt(got / 2)))


def test_model_save_load_round_trip(spark, data):
    from pyspark.ml import PipelineModel

    from evweave.sources import io as IO
    train, test = data
    m = MD.fit_classifier(train, FEATURES, "logistic", negative_weights="abs")
    path = IO.new_store(spark, "t-model")
    IO.save_model(m, MD.training_history(m), path)
    m2, hist = IO.load_model(spark, path, PipelineModel)
    a = MD.score(m, test, "a").select("event_key", "a")
    b = MD.score(m2, test, "b").select("event_key", "b")
    assert a.join(b, "event_key").where(F.col("a") != F.col("b")).count() == 0
    assert hist is not None and hist.count() >= 1


def test_additive_decision_equals_margin_sign(spark, data):
    from evweave.functions.labels import additive_decision
    train, _ = data
    c = R.linear_contributions(train, FEATURES, [1.0, -2.0, 0.5, 0.0, 1.5], 0.25)
    z = F.lit(0.25) + F.col("f_qty") * 1.0 - 2.0 * F.col("f_price") + 0.5 * F.col("f_tax") + 1.5 * F.col("f_size")
    d = c.withColumn("dec", additive_decision("base_value", "contributions")).withColumn("z", z)
    tot = F.aggregate("contributions", F.col("base_value"), lambda a, v: a + v)
    assert d.where(F.abs(tot - F.col("z")) > 1e-9).count() == 0


def test_knn_exact_with_a_dense_spot(spark, data):
    # a third of the points squeezed into a tiny region (a hot spot), the rest as is
    train, _ = data
    mino = train.where(F.col("label") == 1).select(*FEATURES)
    hot = F.pmod(F.xxhash64(*FEATURES), F.lit(3)) == 0
    squeezed = mino.select(*[F.when(hot, F.lit(0.5) + F.col(c) * 1e-4).otherwise(F.col(c)).alias(c)
                             for c in FEATURES])
    pts = RS.collapse(squeezed, FEATURES)
    nb = nearest_points(pts.select("c"), pts, 4, True)
    got = {}
    for r in nb.collect():
        got.setdefault(tuple(r["c"]), []).extend([r["dist"]] * int(r["take"]))
    allp = [(tuple(r["c"]), r["mult"]) for r in pts.collect()]
    assert len(got) == len(allp)
    for c, _ in allp:
        ds = []
        for o, m in allp:
            d = math.dist(c, o)
            ds += [d] * (m - 1 if o == c else m)
        assert sorted(got[c]) == pytest.approx(sorted(ds)[:4], abs=1e-12)


def brute_neighbours(points, k):
    out = {}
    for c in points:
        near = sorted((math.dist(c, o), o) for o in points for _ in range(points[o] - (o == c)))
        out[c] = [d for d, _ in near[:k]]
    return out


def test_knn_with_fourteen_features_and_lone_points(spark, monkeypatch):
    import random

    from evweave.operators import neighbours
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 50)
    monkeypatch.setattr(neighbours, "AT_ONCE", 100)  # slices of a few rows
    rng = random.Random(3)
    spot = [tuple(rng.gauss(0, 1e-3) for _ in range(14)) for _ in range(300)]
    lone = [tuple(rng.gauss(0, 50) for _ in range(14)) for _ in range(12)]
    points = {c: 1 for c in spot + lone}
    points[spot[0]] = 400  # one point many times
    points[lone[0]] = 2
    ref = spark.createDataFrame([(list(c), m) for c, m in points.items()], "c array<double>, mult long")
    got = {}
    for r in nearest_points(ref.select("c"), ref, 5, True).collect():
        got.setdefault(tuple(r["c"]), []).extend([r["dist"]] * r["take"])
    want = brute_neighbours(points, 5)
    assert set(got) == set(want)
    assert all(sorted(got[c]) == pytest.approx(want[c], abs=1e-9) for c in want)
    assert nearest_points(ref.select("c").limit(0), ref, 5, True).count() == 0


def test_knn_visits_few_boxes_and_misses_none():
    from evweave.operators.neighbours import Boxes
    rng = np.random.default_rng(5)
    seen = []
    for n in (4000, 32000):
        x = rng.normal(0, 1, (n, 5))
        x[:, 1] = np.round(x[:, 1] * 2)  # a feature of few values
        boxes = Boxes(x, 16)
        at = boxes.place(x)
        q = x[:200]
        d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
        reach = np.partition(d, 5, 1)[:, 5]
        row, box = boxes.met(q, reach)
        met = np.zeros((len(q), boxes.count), bool)
        met[row, box] = True
        assert all(met[i, at[d[i] <= reach[i]]].all() for i in range(len(q)))
        assert n / 64 <= boxes.count <= n / 16 and np.bincount(at).min() >= 16
        seen.append(len(row) / len(q))
    assert seen[1] < 2 * seen[0] and seen[1] < 100  # of some 1,400 boxes


def test_knn_ties_on_a_lattice_across_boxes(spark, monkeypatch):
    import itertools

    from evweave.operators import neighbours
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 64)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 10)
    points = {tuple(float(v) for v in c): 1 + (sum(c) % 7 == 0) for c in itertools.product(range(6), repeat=3)}
    ref = spark.createDataFrame([(list(c), m) for c, m in points.items()], "c array<double>, mult long")
    got = {}
    for r in nearest_points(ref.select("c"), ref, 5, True).collect():
        got.setdefault(tuple(r["c"]), []).extend([(r["dist"], tuple(r["nc"]))] * r["take"])
    for c in points:
        near = sorted((math.dist(c, o), o) for o in points for _ in range(points[o] - (o == c)))
        assert sorted(got[c]) == near[:5]


def test_knn_leaves_points_without_all_coordinates_out(spark):
    rows = [([float(i), float(i % 7)], 1) for i in range(400)] + [([None, 1.0], 3)]
    ref = spark.createDataFrame(rows, "c array<double>, mult long")
    got = nearest_points(ref.select("c"), ref, 2, True)
    assert got.where(F.exists("nc", lambda x: x.isNull())).count() == 0


def test_forest_rows_are_dealt_over_tasks(spark, monkeypatch):
    d = spark.range(1000, numPartitions=1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    assert MD.in_fit_tasks(d) is d
    assert MD.in_fit_tasks(d.limit(0)).count() == 0
    monkeypatch.setattr(MD, "FIT_ROWS", 150)
    sizes = [r["count"] for r in MD.in_fit_tasks(d).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 7 and sum(sizes) == 1000 and max(sizes) <= 150
    seen = []
    monkeypatch.setattr(MD, "Pipeline", lambda stages: type("P", (), {"fit": lambda self, df: seen.append(df.rdd.getNumPartitions())})())
    MD.fit_forest_regressor(d, ["x"])
    MD.fit_classifier(d.withColumn("w", F.lit(1.0)), ["x"], "gbt", weight="w", negative_weights="abs")
    assert seen == [7, 7]


def test_adasyn_share_on_a_shared_spot(spark):
    rows = [(str(i), 1 if i == 0 else 0, 1.0, 0.0) for i in range(4)]  # one minority, three majority points
    rows += [(str(10 + i), 0, 1.0, 100.0 + i) for i in range(5)] + [("20", 1, 1.0, 200.0)]
    df = spark.createDataFrame(rows, "event_key string, label int, weight double, x double")
    share = {r["c"][0]: r["r"] for r in RS.Oversampler(df, ["x"], k=3).majority_share().collect()}
    assert share[0.0] == pytest.approx(1.0) and share[200.0] == pytest.approx(1.0)


def test_smote_of_fourteen_features_keeps_its_total(spark):
    import random
    rng = random.Random(1)
    feats = [f"x{i}" for i in range(14)]
    rows = [(str(i), int(i < 15), 1.0 if i % 2 else -0.5, *[rng.gauss(0, 1) for _ in feats]) for i in range(120)]
    df = spark.createDataFrame(rows, "event_key string, label int, weight double, " + ", ".join(f"{f} double" for f in feats))
    ov = RS.Oversampler(df, feats, k=5)
    for out in (ov.smote(0.5), ov.adasyn(0.5)):
        n = out.where("synthetic").count()
        assert abs(n - ov.n_synthetic(0.5)) <= 15
    one = df.where("label = 0 or event_key = '3'")  # a class of one row
    assert RS.Oversampler(one, feats, k=5).smote(0.5).where("synthetic").count() == int(0.5 * 105 - 1)


def test_levels_hold_the_rows_of_every_ratio(spark, data):
    train, _ = data
    ov = RS.Oversampler(train, FEATURES, k=3, minority=1)
    ratios = [0.1, 0.3, 0.5, 0.9]
    for method in ("smote", "adasyn"):
        levels = ov.synthetic_levels(method, ratios).persist()
        for i, r in enumerate(ratios):
            got = sorted(x["event_key"] for x in levels.where(F.col("level") <= i).collect())
            assert got == sorted(x["event_key"] for x in getattr(ov, method)(r).where("synthetic").collect())
        levels.unpersist()
    with pytest.raises(ValueError):
        ov.synthetic_levels("smote", [0.5, 0.1])


def test_signed_weights_are_all_used(spark, data):
    train, test = data
    m = MD.fit_classifier(train, FEATURES, "logistic", negative_weights="signed")
    r = train.agg(F.count("*").alias("n"), F.sum(F.abs("weight")).alias("w")).first()
    assert m.n_rows == r["n"] and m.abs_weight == pytest.approx(r["w"])
    assert m.gradient <= 1e-5
    assert MD.training_history(m).count() >= 2
    with pytest.raises(ValueError):
        MD.fit_classifier(train, FEATURES, "logistic")  # a weighted fit must name its policy
    pos = train.withColumn("weight", F.abs("weight"))
    a = MD.fit_classifier(pos, FEATURES, "logistic", negative_weights="signed")
    b = MD.fit_classifier(pos, FEATURES, "logistic", negative_weights="abs", tol=1e-10, maxIter=200)
    assert a.coefs[1:] == pytest.approx(list(b.stages[-1].coefficients.toArray()), rel=1e-3, abs=1e-4)


def test_losses_at_saturated_scores(spark):
    from evweave.functions import labels as L
    d = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, p double")
    r = d.select(L.binary_crossentropy("y", "p").alias("b"), L.focal_loss("y", "p").alias("f")).collect()
    e = 1e-7
    assert r[0]["b"] == pytest.approx(-math.log(2 * e)) and r[1]["b"] == pytest.approx(-math.log(1 - (1 - e) + e))
    assert r[0]["f"] == pytest.approx(-0.25 * math.log(2 * e) * (1 - e) ** 2)


def test_dense_forms_agree_on_nulls_and_large_inputs(spark, monkeypatch):
    d = spark.createDataFrame([(None, 1.0), (800.0, 1.0), (-800.0, 2.0), (float("nan"), 0.0)], "a double, b double")
    for act in D.ACTIVATIONS:
        layers = [([[1.0, -1.0], [0.5, 2.0]], [0.0, 1.0], act), ([[0.25], [0.5]], [0.1], "softplus")]
        got = []
        for limit in (4096, 0):
            monkeypatch.setattr(D, "UNROLL_LIMIT", limit)
            got.append([r["s"] for r in D.dense_score(d, ["a", "b"], layers, "s").collect()])
        assert got[0][0] is None and got[0][3] is None
        assert [x is None for x in got[0]] == [x is None for x in got[1]]
        assert [x for x in got[0] if x is not None] == pytest.approx([x for x in got[1] if x is not None])
        assert all(math.isfinite(x) for x in got[0] if x is not None)
