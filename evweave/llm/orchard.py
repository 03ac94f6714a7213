"""Centroid clustering whose assignments are Orchard searches.

Every centroid keeps the list of all centroids, nearest first. A vector starts at
some centroid and walks that centroid's list: a closer centroid makes it jump to the
closer one's list, centroids seen before are passed over, and the walk ends at the
first entry strictly beyond twice the current distance, as by the triangle
inequality no later one can be as near. All arithmetic is on integers, so ties are
exact. A batch of vectors walks in step: one numpy operation moves all of them on.

A round is one scan of the stored integer vectors. A task adds up the members of
each centroid and sends ``k`` rows of sums; Spark adds these by centroid. Only the
``k`` centroids reach the driver. A centroid that a third of all vectors belong to
costs one row per task like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, release
from .textops import returning_memory
from .vectors import finite_vector, matrix

LARGEST = 1 << 26     # of a component's absolute value: squared distances stay below 2^62
MOST_CENTROIDS = 4096  # the neighbour lists hold k^2 entries in every task
WALK_ROWS = 4096      # vectors that walk in step


class Orchard:
    """Neighbour lists of a set of integer centroids, and the search on them."""

    def __init__(self, centroids: np.ndarray):
        c = self.centroids = np.ascontiguousarray(centroids, np.int64)
        k = len(c)
        self.order, self.apart = np.zeros((k, k), np.int32), np.zeros((k, k), np.int64)
        for j in range(k):
            d = ((c - c[j]) ** 2).sum(1)
            d[j] = -1  # itself first, then by distance
            self.order[j] = np.argsort(d, kind="stable")
            self.apart[j] = d[self.order[j]]

    def assign(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """``(centroid, squared distance)`` of each row of ``x`` (ties: the smaller
        number), and the distances computed to find them."""
        n, k = len(x), len(self.centroids)
        best = np.zeros(n, np.int64) if start is None else start.astype(np.int64)
        near = ((x - self.centroids[best]) ** 2).sum(1)
        at = best.copy()                    # whose list a row walks
        limit = near.copy()                 # squared distance to that centroid
        place = np.ones(n, np.int64)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), best] = True
        looked, live = n, np.arange(n)
        while True:
            live = live[place[live] < k]
            live = live[self.apart[at[live], place[live]] <= 4 * limit[live]]
            if not len(live):
                return best, near, looked
            j = self.order[at[live], place[live]].astype(np.int64)
            place[live] += 1
            new = ~seen[live, j]
            rows, j = live[new], j[new]
            if not len(rows):
                continue
            seen[rows, j] = True
            looked += len(rows)
            diff = x[rows] - self.centroids[j]
            d = np.einsum("ij,ij->i", diff, diff)
            better = (d < near[rows]) | ((d == near[rows]) & (j < best[rows]))
            closer = d[better] < near[rows[better]]
            rows, j, d = rows[better], j[better], d[better]
            best[rows], near[rows] = j, d
            jump = rows[closer]             # a tie stays on its list, which covers all ties
            at[jump], limit[jump], place[jump] = best[jump], near[jump], 1


def floor_mean(total: np.ndarray, count: int) -> np.ndarray:
    """The exact floor of total / count, component by component."""
    return np.array([int(t) // count for t in total.tolist()], np.int64)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: ``id_col, cluster, distance,
    cluster_inertia, inertia, centroid_sha256``.

    Vectors take part that have exactly ``dim`` components, none null or not finite;
    others are left out. Component x becomes floor(scale * x). The first centroids are
    the ``k`` vectors with the smallest sha256 of ``seed:id`` (fewer vectors: all of
    them); equal ids follow the order of their components, null ids come last. A
    round assigns every vector and moves each centroid that has members to the
    floor of their mean; empty ones stay. Then vectors are assigned once more.

    Repeated rows, repeated ids and null ids are vectors like any other; equal
    centroids share no members, the smaller number gets them. An empty table, or one
    where no vector takes part, gives no rows. Other columns are ignored. A component
    beyond 2^26 after scaling raises, as its distances would not fit a long."""
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k must be 1 to {MOST_CENTROIDS}")
    whole = df.where(finite_vector(vec_col) & (F.size(vec_col) == dim)).select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("raw"))
    fits = F.forall("raw", lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) <= F.lit(float(LARGEST)))
    scaled = F.transform("raw", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    points = materialize(whole.select("id", F.when(fits, scaled).otherwise(
        F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}"))).alias("v")))
    # k rows of every task meet on the driver
    key = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), F.lit("~"))
    first = points.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        release(points)
        return df.sparkSession.createDataFrame([], _result_type(whole)).withColumnRenamed("id", id_col)
    centroids = np.array([r["v"] for r in first], np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), dim), np.int64)
        for _, best, _, x in _walk(search, batches, dim, with_id=False):
            for c in np.unique(best):
                mine = best == c
                count[c] += int(mine.sum())
                total[c] += x[mine].sum(0)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(count[held]), *(pa.array(total[held, i]) for i in range(dim))],
            names=["cluster", "n", *(f"s{i}" for i in range(dim))])

    fields = "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(dim))
    for _ in range(rounds):
        moved = points.select("v").mapInArrow(returning_memory(sums), fields).groupBy("cluster").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dim)]).collect()
        centroids = centroids.copy()
        for r in moved:
            centroids[r["cluster"]] = floor_mean(np.array(r[2:], np.int64), r["n"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for ids, best, near, _ in _walk(search, batches, dim, with_id=True):
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(near)],
                                             names=["id", "cluster", "distance"])

    placed = materialize(points.mapInArrow(returning_memory(last), T.StructType(
        [T.StructField("id", whole.schema["id"].dataType), T.StructField("cluster", T.IntegerType()),
         T.StructField("distance", T.LongType())])))
    release(points)
    per = placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # at most k rows
    inertia = sum(r["d"] for r in per)
    facts = {r["cluster"]: (r["d"], hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
             for r in per}
    side = df.sparkSession.createDataFrame([(c, d, s) for c, (d, s) in sorted(facts.items())],
                                           "cluster int, cluster_inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(side), "cluster").select(  # k rows
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"),
        "centroid_sha256")


def _result_type(whole: DataFrame) -> T.StructType:
    return T.StructType([whole.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
                         T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()),
                         T.StructField("centroid_sha256", T.StringType())])


def _walk(search: Orchard, batches: Iterator[pa.RecordBatch], dim: int, with_id: bool):
    """``(ids, centroid, squared distance, vectors)`` of slices of the batches."""
    for b in batches:
        for a in range(0, b.num_rows, WALK_ROWS):
            part = b.slice(a, WALK_ROWS)
            x = matrix(part.column(part.num_columns - 1), dim, np.int64)
            best, near, _ = search.assign(x)
            yield part.column(0) if with_id else None, best, near, x
