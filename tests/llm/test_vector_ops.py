"""Vector searches against brute force."""

import math
import random

import numpy as np
import pytest

from evweave.llm import rp_forest, voronoi

SCHEMA = "vec_id long, embedding array<float>, rank int, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def odd_vectors(seed=1, n=400, dim=8):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    same = [0.5] * dim
    rows += [(i, same) for i in range(n, n + 150)]  # one vector many times
    rows += [(n + 200, None), (n + 201, [math.nan] * dim), (n + 202, [None] * dim), (n + 203, [math.inf] + [0.0] * (dim - 1)),
             (n + 204, [0.0] * dim), (None, same), (n + 300, [0.0] * dim), (n + 205, [1.0, 2.0]), (5, rows[5][1])]
    return rows


def usable(rows):
    return {(i, tuple(np.float32(v).astype(float))) for i, v in rows if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)}


def brute_inner(rows, k, every):
    good = sorted(usable(rows))
    dim = max((len(v) for _, v in good), default=0)
    ints = [(i, [math.floor(1024 * x) for x in v] + [0] * (dim - len(v))) for i, v in good]
    out = []
    for q, v in ints:
        if q % every == 0:
            best = {}
            for i, x in ints:
                if i != q:
                    s = sum(a * b for a, b in zip(v, x))
                    best[i] = max(best.get(i, s), s)
            out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,group", [(16384, 2048), (16, 3)])
def test_voronoi_is_exact(spark, monkeypatch, block, group):
    monkeypatch.setattr(voronoi, "BLOCK_ROWS", block)
    monkeypatch.setattr(voronoi, "GROUP_ROWS", group)
    rows = odd_vectors()
    got = voronoi.top_inner_products(vectors(spark, rows), k=10, every=50).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_inner(rows, 10, 50)


def test_voronoi_small_tables(spark):
    assert voronoi.top_inner_products(vectors(spark, odd_vectors()).limit(0)).count() == 0
    assert voronoi.top_inner_products(vectors(spark, [(1, [1.0]), (2, [2.0])])).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    got = [tuple(r) for r in voronoi.top_inner_products(vectors(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 524288), (0, 2, 2, 524288)]


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(2 ** 20 + i), float(3 ** 9 * i)]) for i in range(120)]
    got = voronoi.top_inner_products(vectors(spark, rows), k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_inner(rows, 5, 100)


def test_products_beyond_64_bits_are_refused(spark):
    for big in (1e30, 3e6):
        with pytest.raises(ValueError):
            voronoi.top_inner_products(vectors(spark, [(0, [big, 0.0]), (1, [1.0, 2.0])])).collect()


def brute_cosine(rows, k, every):
    good = sorted(x for x in usable(rows) if any(x[1]))
    dim = max(len(v) for _, v in good)
    m = np.array([list(v) + [0.0] * (dim - len(v)) for _, v in good])
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    ids = np.array([i for i, _ in good])
    out = {}
    for j in np.flatnonzero(ids % every == 0):
        s = (m * m[j]).sum(1)
        o = [x for x in np.lexsort((ids, -s)) if ids[x] != ids[j]]
        out.setdefault(int(ids[j]), [(int(ids[x]), float(s[x])) for x in o[:k]])
    return out


def test_forest_recall_and_ties(spark):
    rows = odd_vectors(2, 3000, 16)
    want = brute_cosine(rows, 5, 50)
    got = {}
    for r in rp_forest.nearest_by_cosine(vectors(spark, rows), search_least=2000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hit = sum(s >= want[q][-1][1] - 1e-12 for q in got for _, s in got[q])
    assert hit >= 0.9 * sum(map(len, want.values()))
    q = 3000  # the repeated vector: its copies first, smallest ids
    assert [i for i, _ in got[q]] == [i for i, _ in want[q]] == [3001, 3002, 3003, 3004, 3005]


def test_forest_small_tables(spark):
    assert rp_forest.nearest_by_cosine(vectors(spark, odd_vectors()).limit(0)).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (0, [1.0, 0.0])]
    got = [(r["rank"], r["vec_id"], round(r["score"], 9)) for r in
           rp_forest.nearest_by_cosine(vectors(spark, rows)).orderBy("rank").collect()]
    h = round(math.sqrt(0.5), 9)
    assert got == [(1, 1, h), (2, 2, h), (3, 3, -1.0)]


def test_forest_ties_between_scaled_vectors(spark):
    rng = random.Random(4)
    one = [rng.gauss(0, 1) for _ in range(8)]
    # equal directions, distinct vectors: all tie with the query
    rows = [(i, [x * 2.0 ** (i - 30) for x in one]) for i in range(60)] + [(100 + i, [rng.gauss(0, 1) for _ in one]) for i in range(60)]
    rng.shuffle(rows)
    want = brute_cosine(rows, 5, 50)
    got = {}
    for r in rp_forest.nearest_by_cosine(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
