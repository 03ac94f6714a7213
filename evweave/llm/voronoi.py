"""Exact top-k search by inner product as a Voronoi kNN join.

Queries and data are put into the cells of a few hundred pivots. Neighbouring
query cells form groups of at most ``GROUP_ROWS`` queries. For a data row x of
the cell of pivot p, at distance r = |x - p|, every query q obeys
``q.x <= q.p + |q| r``; the scores of a query on the pivots, which are data rows,
give a lower bound on its k-th best score. From these summaries each (group,
cell) gets the least r a row must have to matter to any query of the group, so
only necessary data rows are sent, and each group solves its rows locally.

Memory: pivots are at most ``MAX_PIVOTS``; a group is cut into blocks by counted
rows, so a crowded cell or one vector repeated many times spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.small import join_checked
from ..session import materialize
from .vectors import first_of_each, list_column, matrix, usable

MAX_PIVOTS = 512
GROUP_ROWS = 2048
BLOCK_ROWS = 16384
MAX_PAIR_BROADCAST = 200_000


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integer matrices: by BLAS where doubles hold every sum."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    ma, mb = int(np.abs(a).max()), int(np.abs(b).max())
    if ma * mb * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def top_inner_products(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024,
                       id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: for each query (id divisible by
    ``every``) the k largest inner products of the vectors ``floor(scale * x)``
    over all rows but its own, ties to the smaller id; all rows if fewer than k.

    Rows with a null id, or a vector that is null or holds null or non-finite
    components, take no part. Shorter vectors (also empty ones) count as padded
    with zeros. A (query, row) pair of repeated ids counts once, with its best
    score. An empty table or one without queries gives no rows. Scores are exact;
    components whose products might not fit 64 bits raise. Other columns are ignored."""
    spark = df.sparkSession
    ints = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = usable(df, id_col, vec_col, ints)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n"), F.max(square).alias("m")).first()
    dim, n = top["d"] or 0, top["n"]
    if (top["m"] or 0.0) >= 2.0 ** 63:  # no sum of products is larger than the largest square
        raise ValueError("inner products of these vectors may not fit 64 bits")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    m = int(min(MAX_PIVOTS, max(8, n ** 0.5)))
    picked = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(m).toArrow()
    pid, piv = picked.column("id").to_numpy(), matrix(picked.column("v"), dim, np.int64)
    keep = first_of_each(np.unique(piv, axis=0, return_inverse=True)[1].ravel())
    cells = piv[keep]
    fcells = cells.astype(np.float64)
    norms = (fcells * fcells).sum(1)

    def nearest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = v.astype(np.float64)
        cell = np.argmin(norms[None, :] - 2 * (x @ fcells.T), axis=1)
        gap = x - fcells[cell]
        return cell, np.sqrt((gap * gap).sum(1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), dim, np.int64)
            cell, r = nearest(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(r),
                                              list_column(v)], names=["id", "cell", "r", "v"])

    placed = materialize(rows.mapInArrow(place, "id long, cell int, r double, v array<long>"))
    queries = placed.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])

    # groups of neighbouring query cells: at most MAX_PIVOTS counts come here
    sizes = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
    if not sizes:
        return empty
    first, parts, g, filled = {}, {}, 0, 0
    left = list(sizes)
    at = min(left)
    while left:  # a chain from pivot to nearest unused pivot
        left.remove(at)
        if filled and filled + sizes[at] > GROUP_ROWS:
            g, filled = g + 1, 0
        first[at], parts[at] = g, -(-sizes[at] // GROUP_ROWS)
        filled += sizes[at]
        if parts[at] > 1:
            g, filled = g + parts[at], 0
        if left:
            gap = ((fcells[left] - fcells[at]) ** 2).sum(1)
            at = left[int(gap.argmin())]
    lookup = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in first],
                                   "cell int, first int, parts int")
    grouped = materialize(queries.join(F.broadcast(lookup), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("grp"), "id", "v"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(2), dim, np.int64)
            s = _dot(q, piv)  # scores on the pivots' own rows: real candidates
            own = b.column(1).to_numpy()[:, None] == pid[None, :]
            s = np.where(own, np.iinfo(np.int64).min, s).astype(np.float64)
            uniq = first_of_each(pid)
            s = s[:, uniq]
            least = np.partition(s, len(uniq) - k, axis=1)[:, len(uniq) - k] if len(uniq) > k else np.full(len(q), -np.inf)
            least = np.where(least <= float(np.iinfo(np.int64).min), -np.inf, least)
            length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            qp = q.astype(np.float64) @ fcells.T
            with np.errstate(divide="ignore", invalid="ignore"):
                r = (least[:, None] - qp) / length[:, None]
            # a zero query scores 0 everywhere: it needs all rows; a hair of slack for rounding
            r = np.where(np.isfinite(r), r - 1e-9 * np.abs(r) - 1e-6, -1.0)
            for grp in np.unique(b.column(0).to_numpy()):
                w = r[b.column(0).to_numpy() == grp].min(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(w), grp, np.int32)), pa.array(np.arange(len(w), dtype=np.int32)),
                     pa.array(w)], names=["grp", "cell", "least_r"])

    pairs = grouped.mapInArrow(bounds, "grp int, cell int, least_r double").groupBy("grp", "cell").agg(
        F.min("least_r").alias("least_r"))
    reach = placed.groupBy("cell").agg(F.max("r").alias("far"))
    pairs = materialize(pairs.join(reach, "cell").where(F.col("far") >= F.col("least_r")).select("grp", "cell", "least_r"))
    sent = join_checked(placed, pairs, ["cell"],
                        "inner", MAX_PAIR_BROADCAST).where(F.col("r") >= F.col("least_r"))
    blocks = materialize(sent.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    data = join_checked(sent, blocks, ["grp"]).select(
        "grp", F.pmod(F.xxhash64("id", "r"), F.col("blocks")).cast("int").alias("block"), "id", "v")
    asked = join_checked(grouped, blocks, ["grp"]).select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        qid, xid = q.column("id").to_numpy(), x.column("id").to_numpy()
        qv, xv = matrix(q.column("v"), dim, np.int64), matrix(x.column("v"), dim, np.int64)
        out = []
        for i in range(0, len(qid), 256):
            s = _dot(qv[i:i + 256], xv)
            for j in range(len(s)):
                ok = xid != qid[i + j]
                sc, ids = s[j][ok], xid[ok]
                if len(sc) > 4 * k:  # keep all that tie with the k-th of distinct ids
                    cut = np.partition(sc, len(sc) - k)[len(sc) - k]
                    while True:
                        near = sc >= cut
                        if near.sum() == len(sc) or len(np.unique(ids[near])) >= k:
                            break
                        lower = sc[~near]
                        cut = np.partition(lower, max(0, len(lower) - k))[max(0, len(lower) - k)]
                    sc, ids = sc[near], ids[near]
                o = np.lexsort((ids, -sc))
                o = o[first_of_each(ids[o])][:k]
                out.append((np.full(len(o), qid[i + j]), ids[o], sc[o]))
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.int64())})

    local = asked.groupBy("grp", "block").cogroup(data.groupBy("grp", "block")).applyInArrow(
        solve, "query_id long, vec_id long, score long")
    best = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
