"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Trees are fitted on a bounded sample (``SAMPLE`` unit vectors); a node splits
its sample at the median of the projection on the difference of two of its
points. Every row of the table is then sent to its leaf of every tree. A query
searches all trees through one shared priority queue ordered by the smallest
margin on the path; leaves are taken until their counted rows reach
a share of all leaf entries. The candidates of the visited leaves are ranked by exact cosine
in double precision.

Equal vectors are reduced first to their k + 1 smallest ids, which is all that a
top-k can show, so a vector repeated over a third of the table is one candidate.
Leaves are cut into blocks by counted rows and query lists into blocks as well,
so no leaf or group is held by one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.small import join_checked
from ..session import materialize
from .vectors import list_column, matrix, usable

SAMPLE = 16384
TREES = 12
LEAF = 48          # sample points of a leaf
SEARCH_SHARE = 0.065  # of all leaf entries (rows x trees) that a query looks at,
SEARCH_LEAST = 12000  # and at least so many
BLOCK_ROWS = 8192  # rows of a leaf block, and queries of a query block
MAX_BROADCAST = 500_000


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    y = x / big  # no overflow or underflow in the squares
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def build_tree(x: np.ndarray, seed: int) -> dict:
    """Arrays of a tree: per node the normal, the offset and the two children
    (a negative child -1-i is leaf i)."""
    rng = np.random.default_rng(seed)
    normals, offsets, kids, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        ref = None
        if len(rows) > LEAF:
            for _ in range(4):
                a, b = x[rng.choice(rows, 2, replace=False)]
                n = (a - b).astype(np.float32)
                n /= max(float(np.sqrt(n @ n)), 1e-30)  # margins of all nodes are distances
                p = x[rows] @ n
                cut = np.median(p)
                right = p > cut
                if 0 < right.sum() < len(rows):
                    ref = len(normals)
                    normals.append(n)
                    offsets.append(cut)
                    kids.append([0, 0])
                    todo += [(rows[~right], ref, 0), (rows[right], ref, 1)]
                    break
        if ref is None:
            ref, leaves = -1 - leaves, leaves + 1
        if parent is not None:
            kids[parent][side] = ref
    d = x.shape[1]
    return {"n": np.array(normals, np.float32).reshape(-1, d), "c": np.array(offsets, np.float64),
            "k": np.array(kids, np.int32).reshape(-1, 2), "leaves": leaves}


def leaf_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row: all rows go down one level at a time."""
    at = np.zeros(len(x), np.int32) if len(tree["c"]) else np.full(len(x), -1, np.int32)
    while True:
        go = np.flatnonzero(at >= 0)
        if not len(go):
            return -1 - at
        node = at[go]
        side = np.einsum("ij,ij->i", x[go], tree["n"][node]) > tree["c"][node]
        at[go] = tree["k"][node, side.astype(np.int8)]


def visited_leaves(forest: list[dict], sizes: list[np.ndarray], q: np.ndarray, search_rows: int) -> list[tuple[int, int]]:
    """Leaves of one query, from one queue over all trees, widest margin first."""
    heap = [(-np.inf, t, 0 if len(tree["c"]) else -1) for t, tree in enumerate(forest)]
    out, found = [], 0
    margins = [tree["n"] @ q - tree["c"] for tree in forest]
    while heap and found < search_rows:
        m, t, node = heapq.heappop(heap)
        while node >= 0:
            d = margins[t][node]
            near, far = forest[t]["k"][node][::-1] if d > 0 else forest[t]["k"][node]
            heapq.heappush(heap, (max(m, abs(d)), t, int(far)))
            node = int(near)
        out.append((t, -1 - node))
        found += int(sizes[t][-1 - node])
    return out


def nearest_by_cosine(df: DataFrame, k: int = 5, every: int = 50, trees: int = TREES,
                      search_share: float = SEARCH_SHARE, search_least: int = SEARCH_LEAST, id_col: str = "vec_id",
                      vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: for each query (id divisible by
    ``every``) the k largest cosines found among all rows but its own, ties to
    the smaller id.

    A query visits leaves until they hold ``search_share`` of all leaf entries
    (and ``search_least`` at least), counted over all trees. Rows with a
    null id, or a vector that is null, empty, zero or holds null or non-finite
    components, take no part. Shorter vectors count as padded with zeros. A
    repeated (id, vector) row counts once. An empty table or one without queries
    gives no rows. Other columns are ignored."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col, F.transform(F.col(vec_col), lambda x: x.cast("double"))).where(
        F.exists("v", lambda x: x != 0)).dropDuplicates(["id", "v"])
    w = Window.partitionBy("v").orderBy("id")
    # k + 1 smallest ids of each distinct vector: pruned before the shuffle
    few = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k + 1)
    shared = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.where(F.col("id") % every == 0).select("id", "v")
    top = shared.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    dim, n = top["d"] or 0, top["n"]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    sample = shared.select("v").orderBy(F.md5(F.col("v").cast("string")), "v").limit(SAMPLE).toArrow()
    unit = _unit(matrix(sample.column("v"), dim, np.float64)).astype(np.float32)
    forest = [build_tree(unit, seed + t) for t in range(trees)]
    search_rows = max(search_least, int(search_share * trees * n))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), dim, np.float64)
            u = _unit(v).astype(np.float32)
            leaves = np.stack([leaf_of(t, u) for t in forest], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), list_column(v), list_column(leaves.astype(np.int32))],
                                             names=["ids", "v", "leaves"])

    indexed = materialize(shared.select("ids", "v").mapInArrow(index, "ids array<long>, v array<double>, leaves array<int>"))
    at_leaf = indexed.select("ids", "v", F.posexplode("leaves").alias("tree", "leaf"))
    counts = at_leaf.groupBy("tree", "leaf").count().toArrow()  # one row per leaf: bounded by the sample
    sizes = [np.zeros(t["leaves"], np.int64) for t in forest]
    for t, leaf, c in zip(*[counts.column(i).to_pylist() for i in range(3)]):
        sizes[t][leaf] = c

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), dim, np.float64)
            u = _unit(v).astype(np.float32)
            for i in range(0, len(v), 512):
                seen = [visited_leaves(forest, sizes, q, search_rows) for q in u[i:i + 512]]
                rep = np.repeat(np.arange(i, i + len(seen)), [len(s) for s in seen])
                tl = np.array([x for s in seen for x in s], np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tl[:, 0]), pa.array(tl[:, 1]), pa.array(b.column(0).to_numpy()[rep]), list_column(v[rep])],
                    names=["tree", "leaf", "id", "v"])

    visits = materialize(asked.mapInArrow(search, "tree int, leaf int, id long, v array<double>"))
    plan = materialize(visits.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("qb")).join(
        at_leaf.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("xb")), ["tree", "leaf"]))
    data = join_checked(at_leaf, plan, ["tree", "leaf"], "inner", MAX_BROADCAST).select(
        "tree", "leaf", F.pmod(F.xxhash64("v"), F.col("xb")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "ids", "v")
    ask = join_checked(visits, plan, ["tree", "leaf"], "inner", MAX_BROADCAST).select(
        "tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("xb") - 1)).alias("x"),
        F.pmod(F.xxhash64("id"), F.col("qb")).cast("int").alias("q"), "id", "v")

    def rank(qt: pa.Table, xt: pa.Table) -> pa.Table:
        qid, qv = qt.column("id").to_numpy(), matrix(qt.column("v"), dim, np.float64)
        ids, xv = xt.column("ids").to_pylist(), matrix(xt.column("v"), dim, np.float64)
        out = ([], [], [])
        if len(qid) and len(ids):
            qu, xu = _unit(qv), _unit(xv)
            some = np.array([len(x) for x in ids])
            flat, at = np.concatenate([np.array(x, np.int64) for x in ids]), np.cumsum(some) - some
            slack = 8 * (dim + 1) * np.finfo(np.float64).eps  # two ways of summing a product
            for i in range(0, len(qid), 256):
                s = qu[i:i + 256] @ xu.T
                take = min(s.shape[1], 2 * k + 2)
                least = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take] - slack
                for j in range(len(s)):
                    near = np.flatnonzero(s[j] >= least[j])  # all that tie at the cut
                    # the exact measure, summed row by row: equal vectors give equal bits
                    n = some[near]
                    exact = np.repeat((qu[i + j] * xu[near]).sum(1), n)
                    v = flat[np.repeat(at[near] - np.cumsum(n) + n, n) + np.arange(len(exact))]
                    mine = int(qid[i + j])
                    got = np.lexsort((v, -exact))
                    got = got[v[got] != mine][:k]
                    out[0].extend([mine] * len(got))
                    out[1].extend(v[got].tolist())
                    out[2].extend(exact[got].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    keys = ["tree", "leaf", "x", "q"]
    local = ask.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    best = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    o = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(o)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
