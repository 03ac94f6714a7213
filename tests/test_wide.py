"""Blocked products, principal axes, exact tree attributions, hexagons."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evweave.operators import hist as H
from evweave.operators import models as MD
from evweave.operators import profile as P
from evweave.operators import trees as TR
from evweave.operators.attribution import leaf_paths, tree_attributions
from evweave.plans import gram
from evweave.session import materialize

from conftest import SF01


def _frame(n=300, k=10, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, k)) @ rng.normal(0, 1, (k, k)) + 1e6  # a large offset
    x[rng.random((n, k)) < 0.05] = np.nan
    x[:, k - 1] = 3.0  # no spread
    x[:, k - 2] = np.nan  # never there
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])


@pytest.mark.parametrize("block", [256, 4, 1])
def test_correlation_equals_pandas_on_gaps(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK", block)
    p = _frame()
    cols = list(p.columns)
    rows = [tuple(None if math.isnan(v) and i % 2 else v for i, v in enumerate(r)) for r in p.itertuples(index=False)]
    d = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in P.correlation_matrix(d, cols).collect()}
    want = p.corr()
    assert len(got) == 100
    for a, b in itertools.product(cols, cols):
        w = want.loc[a, b]
        if math.isnan(w) or "c9" in (a, b):
            assert got[a, b] is None
        else:
            assert got[a, b] == pytest.approx(w, abs=1e-6)


def test_correlation_of_vectors_and_of_nothing(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (80, 6))
    rows = [(v.tolist(),) for v in x] + [(None,), ([1.0, None, 2.0],)]
    d = spark.createDataFrame(rows, "v array<double>")
    whole = d.where("size(v) = 6")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in P.correlation_matrix(whole, "v", 6).collect()}
    want = np.corrcoef(x.T)
    assert all(got[i, j] == pytest.approx(want[i, j]) for i in range(6) for j in range(6))
    n = {(r["feature_a"], r["feature_b"]): r["n"] for r in gram.pair_statistics(d, "v", 6).collect()}
    assert n[0, 0] == 81 and n[1, 1] == 80 and n[0, 2] == 81 and n[5, 0] == 80
    assert P.correlation_matrix(d.limit(0), "v", 6).count() == 0


def test_wide_plan_does_not_grow_with_the_columns(spark):
    d = spark.createDataFrame([tuple(float(i) for i in range(64))], ", ".join(f"c{i} double" for i in range(64)))
    plan = P.correlation_matrix(d, d.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "corr(" not in plan and "posexplode" not in plan


def test_principal_axes_equal_svd(spark):
    from evweave.sources.tables import embedding_table
    e = embedding_table(spark, SF01, 0).where(F.col("label") == 0)
    x = np.array([r["x"] for r in e.collect()])
    mean, axes = MD.fit_reconstruction(e, "x", 3)
    assert mean == pytest.approx(x.mean(0))
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs((axes * vt[:3].T).sum(0)) == pytest.approx(np.ones(3), abs=1e-6)
    got = {r["vec_id"]: r["error"] for r in MD.reconstruction_error(e, mean, axes, "x").collect()}
    c = x - x.mean(0)
    want = ((c - c @ vt[:3].T @ vt[:3]) ** 2).mean(1)
    assert sorted(got.values()) == pytest.approx(sorted(want.tolist()))


# --- attributions ----------------------------------------------------------------------------

FEATS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        x = [rng.gauss(0, 1) for _ in FEATS]
        x[1] = float(rng.randint(0, 3))
        y = int(x[0] * x[1] + x[2] + rng.gauss(0, 0.5) > 0.3)
        rows.append((i, y, rng.uniform(-0.2, 1), *x))
    rows[3] = (*rows[3][:3], None, *rows[3][4:])
    d = materialize(spark.createDataFrame(rows, "id long, label int, weight double, " + ", ".join(f"{f} double" for f in FEATS)))
    return d, TR.fit_trees(d, FEATS, [TR.Member(rounds=3, depth=4, rate=0.5), TR.Member(rounds=2, depth=3, average_start=True)], n_bins=16)


def coalition_value(tree, bins, known):
    def at(v):
        f = tree.feature[v]
        if f < 0:
            return tree.value[v]
        if f in known:
            return at(2 * v + (bins[f] > tree.cut[v]))
        return (tree.rows[2 * v] * at(2 * v) + tree.rows[2 * v + 1] * at(2 * v + 1)) / tree.rows[v]

    return at(1)


@pytest.mark.parametrize("member", [0, 1])
def test_attributions_equal_all_coalitions(spark, fitted, member):
    d, model = fitted
    some = d.where("id < 40")
    got = {(r["id"], r["feature"]): r["attribution"] for r in tree_attributions(model, some, "id", member).collect()}
    rate, k = model.specs[member].rate, len(FEATS)
    for r in some.collect():
        bins = [len(model.edges[f]) if r[f] is None else int(np.searchsorted(model.edges[f], r[f], "left")) for f in FEATS]
        value = {}
        for size in range(k + 1):
            for s in itertools.combinations(range(k), size):
                value[s] = rate * sum(coalition_value(t, bins, s) for t in model.trees[member])
        for f in range(k):
            phi = 0.0
            for size in range(k):
                for s in itertools.combinations([i for i in range(k) if i != f], size):
                    w = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                    phi += w * (value[tuple(sorted((*s, f)))] - value[s])
            assert got[r["id"], FEATS[f]] == pytest.approx(phi, abs=1e-9)


def test_attributions_add_up_to_the_margin(spark, fitted):
    d, model = fitted
    assert any(len(p.features) < 4 for t in model.trees[0] for p in leaf_paths(t))
    a = tree_attributions(model, d, "id").groupBy("id").agg((F.sum("attribution") + F.max("base_value")).alias("m"))
    s = model.score_columns(d).select("id", F.get("scores", F.lit(0)).alias("p"))
    assert a.join(s, "id").where(F.abs(1 / (1 + F.exp(-F.col("m"))) - F.col("p")) > 1e-9).count() == 0
    assert a.count() == d.count()
    assert tree_attributions(model, d.limit(0), "id").count() == 0


# --- hexagons ----------------------------------------------------------------------------------

def test_points_are_in_their_nearest_hexagon(spark):
    rng = random.Random(6)
    pts = [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(500)]
    d = spark.createDataFrame(pts, "x double, y double")
    q, r = H.hexagon(F.col("x"), F.col("y"))
    for row in d.select("x", "y", q.alias("q"), r.alias("r")).collect():
        def centre(q, r):
            return q + r / 2, r * math.sqrt(3) / 2
        own = math.dist((row["x"], row["y"]), centre(row["q"], row["r"]))
        near = min(math.dist((row["x"], row["y"]), centre(row["q"] + a, row["r"] + b)) for a in (-1, 0, 1) for b in (-1, 0, 1))
        assert own <= near + 1e-12


def test_density_counts_every_point_once(spark):
    d = spark.createDataFrame([(0, float(i % 7), float(i % 5)) for i in range(70)] + [(0, None, 1.0), (1, 2.0, 2.0)], "label int, x double, y double")
    g = H.hexagon_density(d, "x", "y", 6)
    assert {r["label"]: r["n"] for r in g.groupBy("label").agg(F.sum("entries").alias("n")).collect()} == {0: 70, 1: 1}
    flat = H.hexagon_density(d.withColumn("y", F.lit(1.0)), "x", "y", 6)
    assert flat.agg(F.sum("entries")).first()[0] == 71
    lim = g.agg(F.min("center_x"), F.max("center_x"), F.min("center_y"), F.max("center_y")).first()
    assert -0.6 <= lim[0] and lim[1] <= 6.6 and -0.5 <= lim[2] and lim[3] <= 4.5
