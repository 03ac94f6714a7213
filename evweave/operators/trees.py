"""Histogram trees on signed weights: boosted trees (M3, M4, M11), random forests
(R3, M5) and extremely randomised trees (R4).

Feature values become bin numbers once, in a stored table. A level of a tree is one
pass over it: every task adds up, per (member, node, feature, bin), the gradient,
the curvature, the weight and the rows of its batches (Arrow batches, numpy), Spark
sums these cells, and the split of highest gain per node is found by running sums
over the bins, in Spark. Only the chosen splits reach the driver. Weights keep their
sign all through: a row of negative weight takes away from its bin what a row of
the same positive weight adds.

All members of an ensemble grow in the same passes: a parameter grid of boosted
models, or all trees of a forest, scans the rows as often as one tree does. The pass
that opens a tree also adds up the losses of the training and the validation rows.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.prefix import hash_order
from ..session import materialize, release

CELL_BYTES = 64 << 20  # of the cells that a task holds at once; larger ensembles take several passes a level
KEEP_EVERY = 10        # boosting rounds between two stored margins
WALK_NODES = 64        # a tree of at most as many inner nodes is applied node by node, to whole columns

LOSSES = ("logistic", "exponential", "squared")


@dataclass
class Member:
    """What one member of an ensemble is fitted with."""
    rounds: int = 10                 # boosting rounds; 1: a single tree
    depth: int = 3
    rate: float = 0.1                # share of a leaf's value that is added
    loss: str = "logistic"           # or exponential (labels -1 and 1), squared
    reg: float = 1.0                 # added to the curvature of a leaf
    min_curvature: float = 1e-3      # that both sides of a split must have
    min_rows: int = 1
    min_gain: float = 0.0            # a split must gain more
    tries: int | None = None         # features drawn per node (None: all)
    random_cut: bool = False         # one drawn cut per feature instead of the best
    bootstrap: bool = False          # rows count as often as a Poisson(1) draw says
    patience: int | None = None      # rounds without a lower validation loss before it stops
    average_start: bool = False      # start at the (weighted) mean of the labels instead of 0
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number: 1 is the root, the children of i are 2i and 2i + 1; feature -1: a leaf."""
    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)     # bins up to the cut go left
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    rows: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 1 << (self.depth + 1)
        self.feature, self.cut, self.rows = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.value, self.gain, self.weight = np.zeros(n), np.zeros(n), np.zeros(n)

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node of every row, as deep as the tree has grown. Fastest on bins stored feature by feature."""
        if (self.feature >= 0).sum() <= WALK_NODES:
            return np.broadcast_to(self._below(1, bins), len(bins))
        node = np.ones(len(bins), np.int64)
        at = np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            node = np.where(inner, 2 * node + (bins[at, np.maximum(f, 0)] > self.cut[node]), node)
        return node

    def _below(self, v: int, bins: np.ndarray) -> np.ndarray | np.int64:
        """The node under ``v`` that every row would reach from there."""
        f = self.feature[v]
        if f < 0:
            return np.int64(v)
        return np.where(bins[:, f] > int(self.cut[v]), self._below(2 * v + 1, bins), self._below(2 * v, bins))


def gradients(loss: str, y: np.ndarray, margin: np.ndarray, with_loss: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Loss (only ``with_loss``), gradient and curvature per unit of weight."""
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        return np.logaddexp(0.0, margin) - y * margin if with_loss else None, p - y, p * (1.0 - p)
    if loss == "exponential":
        s = 2.0 * y - 1.0
        e = np.exp(-s * margin)
        return e, -s * e, e
    if loss == "squared":
        return 0.5 * (margin - y) ** 2, margin - y, np.ones_like(y)
    raise ValueError(f"unknown loss {loss}")


# --- bins ---------------------------------------------------------------------------------

def uniform_edges(df: DataFrame, features: Sequence[str], n_bins: int) -> dict[str, list[float]]:
    """``n_bins`` bins of equal width between each feature's least and largest value."""
    r = df.agg(*[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(features)],
               *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(features)]).first()
    out = {}
    for i, c in enumerate(features):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        out[c] = [] if lo is None else [lo + (hi - lo) * j / float(n_bins) for j in range(1, n_bins)]
    return out


def quantile_edges(df: DataFrame, features: Sequence[str], n_bins: int = 64, accuracy: int = 10000) -> dict[str, list[float]]:
    """Edges at the (approximate) quantiles of each feature, equal ones once."""
    at = F.array(*[F.lit(j / n_bins) for j in range(1, n_bins)])
    r = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, accuracy).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return {c: sorted(set(r[f"q{i}"] or [])) for i, c in enumerate(features)}


def binned(df: DataFrame, features: Sequence[str], edges: dict[str, list[float]], label: str, weight: str | None,
           validation: Column | None, key_cols: Sequence[str], start: Sequence[float]) -> DataFrame:
    """The stored table of the passes, in blocks of rows: ``b`` (bin of every feature, 16 bits each), ``y``, ``w``, ``val``,
    ``k`` (from the md5 of the key), ``m`` (margins of the members). Rows without label or weight are not used."""
    cut = [np.array(edges[c], np.float64) for c in features]
    key = F.conv(F.substring(hash_order("row", key_cols), 1, 15), 16, 10).cast("long") if key_cols else F.lit(0).cast("long")
    src = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"),
                    (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                    F.coalesce(validation, F.lit(False)).alias("val") if validation is not None else F.lit(False).alias("val"),
                    key.alias("k")).where(F.col("y").isNotNull() & F.col("w").isNotNull())
    k, first = len(features), np.array([start], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bins = np.empty((k, b.num_rows), np.uint16)
            for i in range(k):
                x = b.column(i).to_numpy(zero_copy_only=False)
                bins[i] = np.where(np.isnan(x), len(cut[i]), np.searchsorted(cut[i], x, "left"))
            yield _packed(bins, *(b.column(k + i).to_numpy(zero_copy_only=False).astype(t) for i, t in enumerate(("f8", "f8", "?", "i8"))),
                          np.repeat(first, b.num_rows, 0))

    return materialize(src.mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCK)))


BLOCK = {"b": np.uint16, "y": np.float64, "w": np.float64, "val": np.bool_, "k": np.int64, "m": np.float64}


def _packed(*columns: np.ndarray) -> pa.RecordBatch:
    """A block of rows as one record: the bytes of every column, so that Spark hands a task blocks and not rows."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], names=list(BLOCK))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The blocks of stored rows: ``b`` with a row per row (stored feature by feature), ``m`` likewise."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = {c: np.frombuffer(batch.column(j)[i].as_buffer(), BLOCK[c]) for j, c in enumerate(batch.schema.names)}
            n = len(block["y"])
            block["b"], block["m"] = block["b"].reshape(-1, n).T, block["m"].reshape(n, -1)
            yield block


def poisson_draws(key: np.ndarray, salt: int) -> np.ndarray:
    """How often a row counts in a bootstrap sample: a Poisson(1) draw from its key."""
    x = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    below = np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040]))
    return np.searchsorted(below, u, "right").astype(np.float64)


# --- the pass over the rows -------------------------------------------------------------------

def _margins(block: dict[str, np.ndarray], specs: list[Member], new: list[list[Tree]]) -> np.ndarray:
    bins, m = block["b"], block["m"].copy()
    for j, (spec, trees) in enumerate(zip(specs, new)):
        for t in trees:
            m[:, j] += spec.rate * t.value[t.place(bins)]
    return m


def _cells(specs, new, growing, open_nodes, allowed, n_bins, k, with_loss):
    """The batch function of a pass: cells ``(member, node, feature, bin, g, h, w, n)``; losses as node 0
    (feature 0: training, 1: validation; g the loss, h the weight, w the absolute weight)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {j: np.zeros((4, len(nodes) * k * n_bins)) for j, nodes in open_nodes.items()}
        losses = np.zeros((len(specs), 2, 4))
        look = {j: _lookup(nodes, specs[j].depth) for j, nodes in open_nodes.items()}
        for block in _blocks(batches):
            bins, y, w, val = (block[c] for c in ("b", "y", "w", "val"))
            margins = _margins(block, specs, new)
            for j in open_nodes:
                spec = specs[j]
                loss, g, h = gradients(spec.loss, y, margins[:, j], with_loss)
                times = poisson_draws(block["k"], spec.seed * 1000003 + j) if spec.bootstrap else np.ones(len(y))
                wj = w * times
                if with_loss:
                    for i, mask in enumerate((~val, val)):
                        losses[j, i] += ((loss * w)[mask].sum(), w[mask].sum(), np.abs(w[mask]).sum(), mask.sum())
                slot = look[j][growing[j].place(bins)]
                use = np.flatnonzero((slot >= 0) & ~val & (times > 0))
                slot, gw, hw, ww = slot[use], (g * wj)[use], (h * wj)[use], wj[use]
                size, base = cells[j].shape[1], slot * (k * n_bins)
                for f in range(k):
                    at = base + f * n_bins + bins[:, f][use]
                    gg, hh, www = gw, hw, ww
                    if not allowed[j][:, f].all():
                        ok = allowed[j][:, f][slot]
                        at, gg, hh, www = at[ok], gw[ok], hw[ok], ww[ok]
                    for i, x in enumerate((gg, hh, www, None)):
                        cells[j][i] += np.bincount(at, x, size)
        for j, nodes in open_nodes.items():
            held = np.flatnonzero(cells[j][3])
            slot, rest = np.divmod(held, k * n_bins)
            f, bin_ = np.divmod(rest, n_bins)
            yield _cell_batch(j, np.array(nodes, np.int64)[slot], f, bin_, cells[j][:, held])
            if with_loss:
                yield _cell_batch(j, np.zeros(2, np.int64), np.arange(2), np.zeros(2, np.int64), losses[j].T)

    return run


def _lookup(nodes: Sequence[int], depth: int) -> np.ndarray:
    out = np.full(1 << (depth + 1), -1)
    out[np.array(nodes, np.int64)] = np.arange(len(nodes))
    return out


_CELL = "member int, node long, feature int, bin int, g double, h double, w double, n double"


def _cell_batch(j: int, node, feature, bin_, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(node), j, np.int32)), pa.array(node), pa.array(feature.astype(np.int32)), pa.array(bin_.astype(np.int32)),
         *(pa.array(np.ascontiguousarray(s)) for s in sums)], names=["member", "node", "feature", "bin", "g", "h", "w", "n"])


# --- the splits ---------------------------------------------------------------------------------

def split_gains(cells: DataFrame, specs: list[Member], round_no: int, with_loss: bool = True) -> DataFrame:
    """Per (member, node) the totals and the chosen split: ``feature, bin, gain`` and the left side's sums; a
    null split where none gains. Without losses (node 0) the cells are made once. Equal gains (to 9 digits) go to the smaller feature, then the smaller bin."""
    cells = cells.repartition("member", "node", "feature").groupBy("member", "node", "feature", "bin").agg(
        *[F.sum(c).alias(c) for c in "ghwn"])
    loss = cells.where(F.col("node") == 0)
    up = Window.partitionBy("member", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("member", "node", "feature")
    d = cells.where(F.col("node") > 0).select("*", *[F.sum(c).over(up).alias(f"l{c}") for c in "ghwn"],
                                              *[F.sum(c).over(every).alias(f"t{c}") for c in "ghwn"],
                                              F.min("bin").over(every).alias("lo"), F.max("bin").over(every).alias("hi"),
                                              F.lead("bin").over(Window.partitionBy("member", "node", "feature").orderBy("bin")).alias("next"))

    def of(name: str) -> Column:
        return F.element_at(F.array(*[F.lit(float(getattr(s, name))) for s in specs]), F.col("member") + 1)

    reg = of("reg")
    rg, rh = F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")

    def part(g, h):
        return F.try_divide(g * g, h + reg)

    gain = 0.5 * (part(F.col("lg"), F.col("lh")) + part(rg, rh) - F.coalesce(part(F.col("tg"), F.col("th")), F.lit(0.0)))
    fits = ((F.col("bin") < F.col("hi")) & (F.col("lh") >= of("min_curvature")) & (rh >= of("min_curvature"))
            & (F.col("ln") >= of("min_rows")) & (F.col("tn") - F.col("ln") >= of("min_rows")) & (gain > of("min_gain")))
    if any(s.random_cut for s in specs):
        u = F.conv(F.substring(F.md5(F.concat_ws(":", of("seed").cast("long").cast("string"), F.lit(str(round_no)), "member", "node", "feature")),
                               1, 8), 16, 10).cast("double") / float(1 << 32)
        drawn = F.col("lo") + F.floor(u * (F.col("hi") - F.col("lo")))
        fits = fits & ((of("random_cut") == 0.0) | ((F.col("bin") <= drawn) & (F.col("next") > drawn)))
    d = d.withColumn("gain", F.when(fits, gain))
    best = d.groupBy("member", "node").agg(
        F.max_by(F.struct("feature", "bin", "gain", "lg", "lh", "lw", "ln"),
                 F.when(F.col("gain").isNotNull(), F.struct(F.round("gain", 9), -F.col("feature"), -F.col("bin")))).alias("s"),
        *[F.max_by(f"t{c}", -F.col("feature")).alias(f"t{c}") for c in "ghwn"])
    best = best.select("member", "node", "s.*", *[f"t{c}" for c in "ghwn"])
    if not with_loss:
        return best
    return best.unionByName(loss.select("member", "node", "feature", "bin", F.lit(None).cast("double").alias("gain"),
                                        *[F.lit(None).cast("double").alias(f"l{c}") for c in "ghwn"],
                                        *[F.col(c).alias(f"t{c}") for c in "ghwn"]))


def _drawn_features(spec: Member, member: int, round_no: int, node: int, k: int) -> np.ndarray:
    if spec.tries is None or spec.tries >= k:
        return np.ones(k, bool)
    order = sorted(range(k), key=lambda f: hashlib.md5(f"{spec.seed}:{round_no}:{member}:{node}:f{f}".encode()).hexdigest())
    out = np.zeros(k, bool)
    out[order[:spec.tries]] = True
    return out


# --- fitting --------------------------------------------------------------------------------------

class TreeEnsemble:
    """Fitted members: ``trees[j]`` are the trees of member j, ``history[j]`` its (round, loss, val_loss)."""

    def __init__(self, features: Sequence[str], edges: dict[str, list[float]], specs: list[Member], start: list[float], vote: bool = False):
        self.features, self.edges, self.specs, self.start, self.vote = list(features), edges, specs, start, vote
        self.trees: list[list[Tree]] = [[] for _ in specs]
        self.history: list[list[tuple]] = [[] for _ in specs]

    def score_columns(self, df: DataFrame, out: str = "scores") -> DataFrame:
        """Add ``out``: the probability of class 1 (squared loss: the prediction) under every member."""
        specs, trees, start, k = self.specs, self.trees, self.start, len(self.features)
        cut = [np.array(self.edges[c], np.float64) for c in self.features]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scores(*cols):
            import pandas as pd
            bins = np.empty((len(cols[0]), k), np.uint16, order="F")
            for i, c in enumerate(cols):
                x = c.to_numpy(dtype=np.float64, na_value=np.nan)
                bins[:, i] = np.where(np.isnan(x), len(cut[i]), np.searchsorted(cut[i], x, "left"))
            got = np.tile(np.array(start), (len(bins), 1))
            for j, spec in enumerate(specs):
                for t in trees[j]:
                    got[:, j] += spec.rate * t.value[t.place(bins)]
                if spec.loss != "squared":
                    got[:, j] = 1.0 / (1.0 + np.exp(-got[:, j] * (2.0 if spec.loss == "exponential" else 1.0)))
            return pd.Series(list(got))

        return df.withColumn(out, scores(*[F.col(c).cast("double") for c in self.features]))

    def transform(self, df: DataFrame, member: int = 0) -> DataFrame:
        """Add ``probability`` (of class 0 and 1) as pipeline models do: by one member, or, where the ensemble
        votes (a forest), by the mean of all."""
        p = self.score_columns(df, "_scores")
        one = F.get("_scores", F.lit(member))
        if self.vote:
            one = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x) / float(len(self.specs))
        return p.withColumn("probability", array_to_vector(F.array(1.0 - one, one))).drop("_scores")

    def node_rows(self) -> list[tuple]:
        """``(member, tree, node, feature, cut, gain, value, n_rows, sum_w)`` of every node (leaves: feature null)."""
        out = []
        for j, trees in enumerate(self.trees):
            for t, tree in enumerate(trees):
                for v in range(1, len(tree.feature)):
                    if v == 1 or tree.feature[v // 2] >= 0:
                        f = int(tree.feature[v])
                        out.append((j, t, v, self.features[f] if f >= 0 else None, self.edges[self.features[f]][int(tree.cut[v])] if f >= 0 else None,
                                    float(tree.gain[v]) if f >= 0 else None, float(tree.value[v]), int(tree.rows[v]), float(tree.weight[v])))
        return out

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table, to store or to join."""
        return spark.createDataFrame(self.node_rows(), "member int, tree int, node long, feature string, cut double, gain double, "
                                                       "value double, n_rows long, sum_w double")

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as four small tables in ``path``: members, edges, nodes and history."""
        members = [(j, json.dumps(asdict(m)), self.start[j], self.vote, len(self.trees[j])) for j, m in enumerate(self.specs)]
        spark.createDataFrame(members, "member int, spec string, start double, vote boolean, n_trees int").write.mode("overwrite").parquet(f"{path}/members")
        spark.createDataFrame([(i, f, [float(e) for e in self.edges[f]]) for i, f in enumerate(self.features)],
                              "place int, feature string, edges array<double>").write.mode("overwrite").parquet(f"{path}/edges")
        rows = [(j, t, v, int(tree.feature[v]), int(tree.cut[v]), float(tree.value[v]), float(tree.gain[v]), int(tree.rows[v]), float(tree.weight[v]))
                for j, trees in enumerate(self.trees) for t, tree in enumerate(trees) for v in range(1, len(tree.feature))
                if v == 1 or tree.feature[v // 2] >= 0]
        spark.createDataFrame(rows, "member int, tree int, node int, feature int, cut long, value double, gain double, n_rows long, sum_w double"
                              ).write.mode("overwrite").parquet(f"{path}/nodes")
        self.history_table(spark).write.mode("overwrite").parquet(f"{path}/history")

    def importances(self) -> np.ndarray:
        """Per member the share of each feature in the summed gains."""
        out = np.zeros((len(self.specs), len(self.features)))
        for j, trees in enumerate(self.trees):
            for t in trees:
                inner = t.feature >= 0
                np.add.at(out[j], t.feature[inner], t.gain[inner])
        total = out.sum(1, keepdims=True)
        return np.divide(out, total, out=np.zeros_like(out), where=total != 0)

    def history_table(self, spark: SparkSession) -> DataFrame:
        """(member, iteration, loss, val_loss), both per unit of absolute weight; val_loss null without validation rows."""
        return spark.createDataFrame([(j, *h) for j, hs in enumerate(self.history) for h in hs],
                                     "member int, iteration int, loss double, val_loss double")


def fit_trees(df: DataFrame, features: Sequence[str], members: Sequence[Member], label: str = "label", weight: str | None = "weight",
              validation: Column | None = None, edges: dict[str, list[float]] | None = None, n_bins: int = 64,
              key_cols: Sequence[str] = (), vote: bool = False) -> TreeEnsemble:
    """Fit all ``members`` in shared passes. ``weight`` may be signed and is used as it is; a split needs positive
    curvature on both sides, a leaf without it gets the value 0. ``validation``: rows that only give the
    validation loss. ``edges``: bin edges per feature (default: quantiles of ``n_bins`` bins). ``key_cols``:
    what identifies a row, for bootstrap draws. Null features count as above the last edge; rows without label
    or weight are not used; without rows all trees are a root of value 0."""
    members, features = list(members), list(features)
    for s in members:
        if s.loss not in LOSSES:
            raise ValueError(f"unknown loss {s.loss}")
        if s.bootstrap and not key_cols:
            raise ValueError("bootstrap draws need key_cols")
        if s.patience is not None and validation is None:
            raise ValueError("patience needs validation rows")
    edges = edges if edges is not None else quantile_edges(df, features, n_bins)
    start = _starts(df, members, label, weight, validation)
    model = TreeEnsemble(features, edges, members, start, vote)
    k = len(features)
    bins_most = max((len(edges[c]) + 1 for c in features), default=1)
    rows = binned(df, features, edges, label, weight, validation, key_cols, start)
    kept = [0] * len(members)  # trees whose values are in the stored margins
    going = {j for j in range(len(members)) if members[j].rounds > 0}
    best: dict[int, tuple[float, int]] = {}
    done_rounds = 0
    while going:
        growing = {j: Tree(members[j].depth) for j in sorted(going)}
        new = [model.trees[j][kept[j]:] for j in range(len(members))]
        open_nodes = {j: [1] for j in growing}
        level = 0
        while open_nodes:
            found = _level(rows, members, new, growing, open_nodes, done_rounds, bins_most, k, level == 0)
            nxt: dict[int, list[int]] = {}
            for r in found:
                j = r["member"]
                if r["node"] == 0:
                    continue
                tree, spec, v = growing[j], members[j], r["node"]
                if level == 0:
                    _leaf(tree, 1, r["tg"], r["th"], r["tw"], r["tn"], spec)
                if r["gain"] is None:
                    continue
                tree.feature[v], tree.cut[v], tree.gain[v] = r["feature"], r["bin"], r["gain"]
                _leaf(tree, 2 * v, r["lg"], r["lh"], r["lw"], r["ln"], spec)
                _leaf(tree, 2 * v + 1, r["tg"] - r["lg"], r["th"] - r["lh"], r["tw"] - r["lw"], r["tn"] - r["ln"], spec)
                if level + 1 < spec.depth:
                    nxt.setdefault(j, []).extend([2 * v, 2 * v + 1])
            if level == 0:
                stop = _note_losses(model, found, going, best, done_rounds)
                for j in stop:
                    growing.pop(j)
                    nxt.pop(j, None)
                going -= stop
            open_nodes = {j: sorted(v) for j, v in nxt.items()}
            level += 1
        for j, tree in growing.items():
            model.trees[j].append(tree)
        done_rounds += 1
        going = {j for j in going if len(model.trees[j]) < members[j].rounds}
        if going and done_rounds % KEEP_EVERY == 0:
            new = [model.trees[j][kept[j]:] for j in range(len(members))]
            old, rows = rows, _store_margins(rows, members, new)
            release(old)
            kept = [len(t) for t in model.trees]
    if validation is not None and any(s.rounds > 1 or s.patience is not None for s in members):  # the losses after the last round
        new = [model.trees[j][kept[j]:] for j in range(len(members))]
        ends = {j: Tree(members[j].depth) for j in range(len(members)) if len(model.trees[j]) == members[j].rounds}
        if ends:
            found = _level(rows, members, new, ends, {j: [1] for j in ends}, done_rounds, bins_most, k, True)
            _note_losses(model, found, set(ends), best, None)
    for j, spec in enumerate(members):
        if spec.patience is not None and j in best:
            model.trees[j] = model.trees[j][:best[j][1]]
    release(rows)
    return model


def load_trees(spark: SparkSession, path: str) -> TreeEnsemble:
    """The ensemble that :meth:`TreeEnsemble.save` wrote to ``path``."""
    edges = spark.read.parquet(f"{path}/edges").orderBy("place").collect()
    members = spark.read.parquet(f"{path}/members").orderBy("member").collect()
    specs = [Member(**json.loads(m["spec"])) for m in members]
    model = TreeEnsemble([e["feature"] for e in edges], {e["feature"]: list(e["edges"]) for e in edges}, specs,
                         [m["start"] for m in members], bool(members and members[0]["vote"]))
    model.trees = [[Tree(specs[j].depth) for _ in range(m["n_trees"])] for j, m in enumerate(members)]
    for r in spark.read.parquet(f"{path}/nodes").toLocalIterator():
        tree, v = model.trees[r["member"]][r["tree"]], r["node"]
        tree.feature[v], tree.cut[v], tree.value[v] = r["feature"], r["cut"], r["value"]
        tree.gain[v], tree.rows[v], tree.weight[v] = r["gain"], r["n_rows"], r["sum_w"]
    for r in spark.read.parquet(f"{path}/history").orderBy("member", "iteration").collect():
        model.history[r["member"]].append((r["iteration"], r["loss"], r["val_loss"]))
    return model


def fit_signed_trees(df: DataFrame, features: Sequence[str], kind: str, label: str = "label", weight: str | None = "weight",
                     maxIter: int = 20, maxDepth: int = 5, stepSize: float = 0.1, numTrees: int = 20, seed: int = 42, n_bins: int = 64,
                     key_cols: Sequence[str] = ("event_key",)) -> TreeEnsemble:
    """``gbt`` (one boosted member) or ``forest`` (bootstrapped trees on drawn features that vote) on signed weights."""
    if kind == "gbt":
        return fit_trees(df, features, [Member(rounds=maxIter, depth=maxDepth, rate=stepSize, seed=seed)], label, weight, n_bins=n_bins)
    if kind != "forest":
        raise ValueError(f"unknown kind {kind}")
    return fit_trees(df, features, forest_members(len(features), numTrees, maxDepth, seed), label, weight, n_bins=n_bins,
                     key_cols=key_cols, vote=True)


def forest_members(k: int, num_trees: int, max_depth: int, seed: int = 42, extra: bool = False) -> list[Member]:
    """The trees of a random forest (bootstrap draws, the best cut of √k drawn features) or, with ``extra``, of
    extremely randomised trees (all rows, one drawn cut for each of √k drawn features). With squared loss, no
    penalty and 0/1 labels a split's gain is half the fall of the summed squared error."""
    return [Member(rounds=1, depth=max_depth, rate=1.0, loss="squared", reg=0.0, min_curvature=1e-9, tries=max(1, math.ceil(math.sqrt(k))),
                   random_cut=extra, bootstrap=not extra, seed=seed) for _ in range(num_trees)]


def _starts(df: DataFrame, members: list[Member], label: str, weight: str | None, validation: Column | None) -> list[float]:
    """The first margin of every member."""
    if not any(s.average_start for s in members):
        return [0.0] * len(members)
    fit = df.where(~F.coalesce(validation, F.lit(False))) if validation is not None else df
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = fit.agg(F.try_divide(F.sum(w * F.col(label)), F.sum(F.when(F.col(label).isNotNull(), w))).alias("p")).first()["p"]
    out = []
    for s in members:
        if not s.average_start or mean is None:
            out.append(0.0)
        elif s.loss == "squared":
            out.append(float(mean))
        elif 0.0 < mean < 1.0:
            out.append(float(np.log(mean / (1.0 - mean))) * (0.5 if s.loss == "exponential" else 1.0))
        else:  # signed weights can put the mean outside: no odds to start from
            out.append(0.0)
    return out


def _leaf(tree: Tree, v: int, g: float, h: float, w: float, n: float, spec: Member) -> None:
    tree.value[v] = -g / (h + spec.reg) if h + spec.reg > 0 and h > 0 else 0.0
    tree.rows[v], tree.weight[v] = int(round(n)), w


def _level(rows, members, new, growing, open_nodes, round_no, n_bins, k, with_loss) -> list:
    """The chosen splits (and losses) of all open nodes; members in as many passes as their cells need."""
    out, group, size = [], {}, 0
    for j in [*open_nodes, None]:
        cost = 0 if j is None else len(open_nodes[j]) * k * n_bins * 32
        if group and (j is None or size + cost > CELL_BYTES):
            allowed = {i: np.array([_drawn_features(members[i], i, round_no, v, k) for v in nodes]).reshape(len(nodes), k)
                       for i, nodes in group.items()}
            sent = rows if any(members[i].bootstrap for i in group) else rows.drop("k")
            cells = sent.mapInArrow(_cells(members, new, growing, group, allowed, n_bins, k, with_loss), _CELL)
            out += split_gains(cells, members, round_no, with_loss).collect()
            group, size = {}, 0
        if j is not None:
            group[j] = open_nodes[j]
            size += cost
    return out


def _note_losses(model, found, going, best, round_no) -> set[int]:
    """Write the losses of a pass to the history; the members that have waited too long."""
    at: dict[int, dict[int, tuple]] = {}
    for r in found:
        if r["node"] == 0:
            at.setdefault(r["member"], {})[r["feature"]] = (r["tg"], r["tw"])
    stop = set()
    for j in going:
        if j not in at:
            continue
        loss, val = (s / a if a else None for s, a in (at[j].get(i, (0.0, 0.0)) for i in (0, 1)))
        n = len(model.trees[j])
        model.history[j].append((n, loss, val))
        patience = model.specs[j].patience
        if patience is not None and val is not None:
            if j not in best or val < best[j][0]:
                best[j] = (val, n)
            elif n - best[j][1] >= patience:
                stop.add(j)
    return stop if round_no is not None else set()


def _store_margins(rows: DataFrame, specs: list[Member], new: list[list[Tree]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _packed(block["b"].T, *(block[c] for c in ("y", "w", "val", "k")), _margins(block, specs, new))

    return materialize(rows.mapInArrow(run, rows.schema))
