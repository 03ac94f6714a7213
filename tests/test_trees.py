"""Histogram trees on signed weights against a brute-force builder."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evweave.operators import models as MD
from evweave.operators import rank as R
from evweave.operators import trees as TR
from evweave.session import materialize

FEATS = ["a", "b", "c", "d"]


def make_rows(n=900, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c, d = rng.gauss(0, 1), rng.randint(0, 4), rng.random(), rng.gauss(2, 3)
        y = int(rng.random() < 1 / (1 + math.exp(-(1.5 * a * (1 if b > 2 else -1) + c))))
        w = round(rng.uniform(-0.3, 1.0), 3)
        out.append((f"k{i}", y, w, a, float(b), c, d, i % 5 == 0))
    out[7] = (*out[7][:3], None, *out[7][4:])
    out[8] = (*out[8][:3], float("nan"), *out[8][4:])
    return out


SCHEMA = "event_key string, label int, weight double, a double, b double, c double, d double, val boolean"


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def data(spark, rows):
    return materialize(spark.createDataFrame(rows, SCHEMA).repartition(4))


def edges_of(rows, n=12):
    out = {}
    for i, f in enumerate(FEATS):
        v = [r[3 + i] for r in rows if r[3 + i] is not None and r[3 + i] == r[3 + i]]
        out[f] = [min(v) + (max(v) - min(v)) * j / n for j in range(1, n)]
    return out


def key_of(k):
    return int(hashlib.md5(f"row:{k}".encode()).hexdigest()[:15], 16)


class Brute:
    """Grows the trees of one member row by row."""

    def __init__(self, rows, edges, spec, member=0):
        x = np.array([[np.nan if v is None else v for v in r[3:7]] for r in rows], float)
        self.bins = np.stack([np.where(np.isnan(x[:, i]), len(edges[f]), np.searchsorted(edges[f], x[:, i], "left"))
                              for i, f in enumerate(FEATS)], 1)
        self.y, self.w = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
        self.val = np.array([r[7] for r in rows])
        self.spec, self.member, self.margin = spec, member, np.zeros(len(rows))
        if spec.bootstrap:
            draws = TR.poisson_draws(np.array([key_of(r[0]) for r in rows]), spec.seed * 1000003 + member)
        else:
            draws = np.ones(len(rows))
        self.times, self.splits, self.history = draws, [], []

    def loss(self):
        loss, _, _ = TR.gradients(self.spec.loss, self.y, self.margin)
        return tuple((loss * self.w)[m].sum() / np.abs(self.w[m]).sum() if m.any() else None for m in (~self.val, self.val))

    def grow(self, t):
        s, k = self.spec, len(FEATS)
        self.history.append(self.loss())
        _, g, h = TR.gradients(s.loss, self.y, self.margin)
        g, h = g * self.w * self.times, h * self.w * self.times
        use = ~self.val & (self.times > 0)
        node, value = np.ones(len(g), int), {1: -g[use].sum() / (h[use].sum() + s.reg)}
        for level in range(s.depth):
            nxt = node.copy()
            for v in range(1 << level, 2 << level):
                mine = use & (node == v)
                if not mine.any() or v not in value:
                    continue
                tried = range(k)
                if s.tries and s.tries < k:
                    tried = sorted(range(k), key=lambda f: hashlib.md5(f"{s.seed}:{t}:{self.member}:{v}:f{f}".encode()).hexdigest())[:s.tries]
                best = None
                for f in tried:
                    held = sorted(set(self.bins[mine, f].tolist()))
                    cuts = held[:-1]
                    if s.random_cut and cuts:
                        u = int(hashlib.md5(f"{s.seed}:{t}:{self.member}:{v}:{f}".encode()).hexdigest()[:8], 16) / 2 ** 32
                        drawn = held[0] + math.floor(u * (held[-1] - held[0]))
                        cuts = [max(b for b in held if b <= drawn)]
                    for b in cuts:
                        left = mine & (self.bins[:, f] <= b)
                        right = mine & ~left
                        gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()
                        if min(hl, hr) < s.min_curvature:
                            continue
                        gain = 0.5 * (gl ** 2 / (hl + s.reg) + gr ** 2 / (hr + s.reg) - (gl + gr) ** 2 / (hl + hr + s.reg))
                        if gain > s.min_gain and (best is None or (round(gain, 9), -f, -b) > (round(best[0], 9), -best[1], -best[2])):
                            best = gain, f, b, -gl / (hl + s.reg), -gr / (hr + s.reg)
                if best:
                    gain, f, b, vl, vr = best
                    here = node == v
                    nxt[here] = 2 * v + (self.bins[here, f] > b)
                    value[2 * v], value[2 * v + 1] = vl, vr
                    self.splits.append((t, v, f, b, gain))
            node = nxt
        self.margin = self.margin + s.rate * np.array([value[v] for v in node])


def splits_of(model, j):
    return [(t, v, int(tree.feature[v]), int(tree.cut[v]), tree.gain[v]) for t, tree in enumerate(model.trees[j])
            for v in range(1, len(tree.feature)) if tree.feature[v] >= 0]


def assert_same(got, want):
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want], rel=1e-9, abs=1e-12)


BOOSTED = [TR.Member(rounds=4, depth=2, rate=0.3), TR.Member(rounds=3, depth=3, rate=0.2, loss="exponential", reg=0.5),
           TR.Member(rounds=2, depth=2, rate=1.0, loss="squared", tries=2, seed=7)]


@pytest.mark.parametrize("keep,cells", [(25, 64 << 20), (2, 1)])
def test_boosted_members_equal_brute_force(spark, data, rows, monkeypatch, keep, cells):
    monkeypatch.setattr(TR, "KEEP_EVERY", keep)  # stored margins, and one member a pass, change nothing
    monkeypatch.setattr(TR, "CELL_BYTES", cells)
    edges = edges_of(rows)
    model = TR.fit_trees(data, FEATS, BOOSTED, validation=F.col("val"), edges=edges)
    for j, spec in enumerate(BOOSTED):
        b = Brute(rows, edges, spec, j)
        for t in range(spec.rounds):
            b.grow(t)
        assert len(b.splits) > 3
        assert_same(splits_of(model, j), b.splits)
        b.history.append(b.loss())
        got = model.history[j]
        assert [h[0] for h in got] == list(range(spec.rounds + 1))
        assert [h[1:] for h in got] == [pytest.approx(h) for h in b.history]
        score = {r["event_key"]: r["scores"][j] for r in model.score_columns(data).collect()}
        want = b.margin if spec.loss == "squared" else 1 / (1 + np.exp(-b.margin * (2 if spec.loss == "exponential" else 1)))
        assert [score[r[0]] for r in rows] == pytest.approx(want.tolist())


@pytest.mark.parametrize("extra", [False, True])
def test_forest_importances_equal_brute_force(spark, data, rows, monkeypatch, extra):
    edges = edges_of(rows)
    monkeypatch.setattr(TR, "quantile_edges", lambda *a, **k: edges)
    members = TR.forest_members(len(FEATS), 6, 3, 11, extra)
    assert members[0].random_cut == extra and members[0].bootstrap != extra and members[0].tries == 2
    plain = [(*r[:7], False) for r in rows]
    share = []
    for j, spec in enumerate(members):
        b = Brute(plain, edges, spec, j)
        b.grow(0)
        gains = np.zeros(len(FEATS))
        for _, _, f, _, gain in b.splits:
            gains[f] += gain
        share.append(gains / gains.sum())
    share = np.array(share)
    got = {r["feature"]: r for r in R.forest_importances(data, FEATS, num_trees=6, max_depth=3, weight="weight", seed=11, extra=extra).collect()}
    assert [got[f]["importance"] for f in FEATS] == pytest.approx(share.mean(0).tolist())
    assert [got[f]["std"] for f in FEATS] == pytest.approx(share.std(0).tolist())


def test_a_negative_row_takes_back_a_positive_one(spark, data, rows):
    edges = edges_of(rows)
    one = TR.fit_trees(data, FEATS, BOOSTED[:1], edges=edges)
    extra = [(f"x{i}", 1, s * 0.75, 0.3 * i, 1.0, 0.5, 2.0, False) for i in range(40) for s in (1, -1)]
    two = TR.fit_trees(data.unionByName(spark.createDataFrame(extra, SCHEMA)), FEATS, BOOSTED[:1], edges=edges)
    assert_same(splits_of(one, 0), splits_of(two, 0))


def test_early_stopping_keeps_the_best_round(spark, data):
    spec = dict(depth=4, rate=0.9, reg=0.0, min_curvature=1e-6)
    m = MD.fit_gbt_early_stopping(data, FEATS, F.col("val"), rounds=40, patience=3, **spec)
    val = [h[2] for h in m.history[0]]
    best = min(range(len(val)), key=lambda i: (val[i], i))
    assert len(m.trees[0]) == best and len(val) == best + 4 < 41  # it waited three rounds, then stopped
    s = MD.score(m, data).agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert 0.0 <= s["lo"] < s["hi"] <= 1.0


def test_start_at_the_average(spark, data, rows):
    m = TR.fit_trees(data, FEATS, [TR.Member(rounds=0, average_start=True), TR.Member(rounds=0, average_start=True, loss="squared")])
    p = sum(r[1] * r[2] for r in rows) / sum(r[2] for r in rows)
    got = m.score_columns(data).first()["scores"]
    assert got == pytest.approx([p, p])


def test_signed_classifier_kinds(spark, data):
    for kind in ("gbt", "forest"):
        m = MD.fit_classifier(data, FEATS, kind, negative_weights="signed", maxDepth=3, numTrees=4, maxIter=4)
        s = MD.score(m, data).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n")).first()
        assert -1e-9 <= s["lo"] < s["hi"] and s["n"] == 900
    with pytest.raises(ValueError):
        TR.fit_trees(data, FEATS, [TR.Member(patience=2)])
    with pytest.raises(ValueError):
        TR.fit_trees(data, FEATS, [TR.Member(bootstrap=True)])


def test_saved_trees_are_the_same_trees(spark, data, rows):
    from evweave.sources.io import new_store
    model = TR.fit_trees(data, FEATS, BOOSTED, validation=F.col("val"), edges=edges_of(rows))
    path = new_store(spark, "trees-test")
    model.save(spark, path)
    back = TR.load_trees(spark, path)
    assert back.node_rows() == model.node_rows() and back.history == model.history
    assert back.specs == model.specs and back.edges == model.edges and back.start == model.start


def test_trees_of_nothing(spark, data):
    m = TR.fit_trees(data.limit(0), FEATS, [TR.Member(rounds=2)])
    assert m.node_rows() and all(r[3] is None and r[6] == 0.0 for r in m.node_rows())
    only = data.withColumn("label", F.lit(None).cast("int"))
    assert all(r[7] == 0 for r in TR.fit_trees(only, FEATS, [TR.Member(rounds=1)]).node_rows())


def test_trees_are_applied_alike_by_nodes_and_by_rows(monkeypatch):
    rng = np.random.default_rng(1)
    bins = np.asfortranarray(rng.integers(0, 16, (500, 3)).astype(np.uint16))
    t = TR.Tree(4)
    for v in (1, 2, 3, 4, 6, 12, 13):
        t.feature[v], t.cut[v] = rng.integers(0, 3), rng.integers(2, 14)
    by_nodes = t.place(bins)
    monkeypatch.setattr(TR, "WALK_NODES", -1)
    assert (by_nodes == t.place(bins.astype(np.int64))).all() and len(set(by_nodes)) > 2
    assert (TR.Tree(2).place(bins) == 1).all()


def test_passes_without_losses_skip_them():
    y, m = np.array([0.0, 1.0, 1.0]), np.array([0.3, -1.0, 2.0])
    loss, g, h = TR.gradients("logistic", y, m)
    none, g2, h2 = TR.gradients("logistic", y, m, False)
    assert none is None and loss is not None and (g == g2).all() and (h == h2).all()
