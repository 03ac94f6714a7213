"""Connected components as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release


def _parents(edges: DataFrame) -> DataFrame:
    """Every node's smallest neighbour or itself, then two jumps along parents."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    p = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
    up = p.select(F.col("a").alias("q"), F.col("p").alias("up"))
    return p.join(up, p.p == up.q).select("a", F.col("up").alias("p"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the root is the smallest
    node that the component's contraction reaches, the same for all its nodes.

    Each round points nodes to their smallest neighbour (a map-side combined
    minimum, so a node with very many edges is no hot group) and contracts the
    edges; rounds grow with the logarithm of the longest path. Every round is
    stored in the shared checkpoint folder. An empty edge table gives no rows;
    loops and repeated edges are allowed."""
    e = materialize(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    maps = []
    while not e.isEmpty():
        p = materialize(_parents(e))
        maps.append(p)
        pa, pb = p.select("a", F.col("p").alias("na")), p.select(F.col("a").alias("b"), F.col("p").alias("nb"))
        nxt = materialize(e.join(pa, "a").join(pb, "b").where(F.col("na") != F.col("nb")).select(
            F.col("na").alias("a"), F.col("nb").alias("b")).distinct())
        release(e)
        e = nxt
    out = edges.sparkSession.createDataFrame([], e.select(F.col("a").alias("node"), F.col("b").alias("root")).schema)
    if maps:
        out = maps[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
        for m in maps[1:]:
            step = m.select(F.col("a").alias("root"), F.col("p").alias("next"))
            out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        out = materialize(out)
        release(*maps)
    release(e)
    return out
