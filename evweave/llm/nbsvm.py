"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators (hashed to ``BUCKETS``): words and word
pairs, byte triples, and runs of up to three word shapes (case, digits, symbols,
"same word again"). Indicators are scaled by the log of the ratio of their
smoothed counts in the two classes; a linear hinge-loss model on the scaled
indicators, normalised by the text's size, is fitted by dual coordinate descent;
a logistic map of the margin, fitted on rows kept from the descent, gives scores
in 0..1.

The fit reads a bounded sample of labelled rows (``MAX_TRAIN``, by hash of the
id); a model is two vectors of ``BUCKETS`` numbers. Scoring is map-only over
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops

BUCKETS = 1 << 17
MAX_TRAIN = 16384    # labelled rows of the fit
LEAST_TEXTS = 5      # an n-gram in fewer sample texts says nothing
SMOOTH = 1.0
PENALTY = 1.0        # C of the hinge loss
EPOCHS = 12
KEPT = 5             # every KEPT-th sample row fits the score's logistic map


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # per bucket: log-count ratio times hinge weight
    bias: float
    slope: float
    shift: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


# --- n-grams ---------------------------------------------------------------------

def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 17)).astype(np.int32)


def shapes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A small code per word: letter case, digits, number of symbols, and whether
    the word before it (in the same text) is the same."""
    def count(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[e] - c[s]

    upper = count((raw >= 65) & (raw <= 90))
    lower = count(((raw >= 97) & (raw <= 122)) | (raw >= 128))
    digit = count((raw >= 48) & (raw <= 57))
    case = np.where(upper == 0, 0, np.where(lower > 0, 1, 2))
    symbol = np.minimum(e - s - upper - lower - digit, 3)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = 0
    return case + 3 * ((digit > 0) + 2 * (symbol + 4 * same))


def _grams(v: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of every run of n values (shorter than v by n - 1)."""
    h = np.full(max(0, len(v) - n + 1), salt, np.uint64)
    for i in range(n):
        h = textops.mix64(h + v[i:len(v) - n + 1 + i])
    return h


class Features:
    """Distinct buckets per text (made inside a task)."""

    def __init__(self):
        self.hasher = textops.Hasher()
        self.mark = np.zeros(BUCKETS, bool)

    def rows(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """``(row, sorted distinct buckets)`` of every row of a text column."""
        for i, _, raw, off in textops.text_slices(col):
            if len(off) == 2 and len(raw) > 2 * textops.SLICE:
                self.mark[:] = False
                for a in range(0, len(raw), textops.SLICE):  # a long text, part by part
                    part = raw[a:a + textops.SLICE]
                    for _, idx in self._slice(part, np.array([0, len(part)])):
                        self.mark[idx] = True
                yield i, np.flatnonzero(self.mark).astype(np.int32)
            else:
                for k, idx in self._slice(raw, off):
                    yield i + k, idx

    def _slice(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        s, e, h, first = self.hasher.words(raw, off)
        sh = shapes(raw, s, e, h, first).astype(np.uint64) if len(s) else np.zeros(0, np.uint64)
        wide = raw.astype(np.uint32)
        triple = wide[:-2] | (wide[1:-1] << 8) | (wide[2:] << 16) if len(raw) > 2 else np.zeros(0, np.uint32)
        triple = ((triple * np.uint32(0x9E3779B1)) >> np.uint32(32 - 17)).astype(np.int32)
        kinds = [(_bucket(_grams(h, n, n)), n) for n in (1, 2)] + [(_bucket(_grams(sh, n, 8 + n)), n) for n in (1, 2, 3)]
        mark = np.zeros(BUCKETS, bool) if len(off) == 2 else self.mark
        for k in range(len(off) - 1):
            mark[:] = False
            mark[triple[off[k]:max(off[k], off[k + 1] - 2)]] = True
            for g, n in kinds:
                mark[g[first[k]:max(first[k], first[k + 1] - n + 1)]] = True
            yield k, np.flatnonzero(mark).astype(np.int32)


# --- the fit (a bounded sample, in one task) ------------------------------------------

def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for idx, label in zip(rows, y):
        (pos if label > 0 else neg)[idx] += 1
    rare = pos + neg < LEAST_TEXTS
    p, q = pos + SMOOTH, neg + SMOOTH
    r = np.log((p / p.sum()) / (q / q.sum()))
    r[rare] = 0.0
    return r


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, epochs: int = EPOCHS,
                            seed: int = 3) -> tuple[np.ndarray, float]:
    """Hinge-loss weights on the scaled indicators r / sqrt(n): each step solves one
    row's dual variable exactly within 0..C (C weighted to balance the classes)."""
    scale = np.array([1.0 / np.sqrt(max(1, len(i))) for i in rows])
    norm = np.array([s * s * float((r[i] ** 2).sum()) + 1.0 for i, s in zip(rows, scale)])
    n_pos = max(1, int((y > 0).sum()))
    n_neg = max(1, len(y) - int((y > 0).sum()))
    cap = PENALTY * np.where(y > 0, len(y) / (2 * n_pos), len(y) / (2 * n_neg))
    alpha, w, bias = np.zeros(len(y)), np.zeros(BUCKETS), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for j in rng.permutation(len(y)):
            x = r[rows[j]] * scale[j]
            grad = y[j] * (float(w[rows[j]] @ x) + bias) - 1.0
            a = min(max(alpha[j] - grad / norm[j], 0.0), cap[j])
            d = (a - alpha[j]) * y[j]
            if d:
                alpha[j] = a
                w[rows[j]] += d * x
                bias += d
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, bias


def fit_logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Newton steps of p = 1 / (1 + exp(-(a m + b))) with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        g, v = t - p, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        d *= min(1.0, 2.0 / max(1e-12, np.abs(d).max()))
        a, b = max(1e-6, a + d[0]), b + d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, shift) from texts' buckets and labels of +1 / -1."""
    if not len(y) or (y > 0).all() or (y < 0).all():
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)  # one class: its smoothed share for all
        return np.zeros(BUCKETS), 0.0, 1e-6, float(np.log(share / (1 - share)))
    kept = np.arange(len(y)) % KEPT == 0
    if (y[kept] > 0).all() or (y[kept] < 0).all():
        kept[:] = True
    fit = ~kept if (~kept).any() and len(set(y[~kept])) == 2 else np.ones(len(y), bool)
    r = log_count_ratio([x for x, f in zip(rows, fit) if f], y[fit])
    w, bias = dual_coordinate_descent([x for x, f in zip(rows, fit) if f], y[fit], r)
    weight = r * w
    margin = np.array([weight[x].sum() / np.sqrt(max(1, len(x))) + bias for x, k in zip(rows, kept) if k])
    return (weight, bias, *fit_logistic(margin, y[kept]))


def learning_fold(id_col: str) -> "F.Column":
    """True for ids whose crc32 as text leaves a remainder by 5; a null id is ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` labelled rows of the learning fold, by hash of
    the id. Labels other than 0 and 1, null labels and null ids are ignored; an id
    with several labels counts with the smallest; of rows repeating an id one is
    used. Without rows of both classes
    every score is the smoothed share of label 1 (one half without any)."""
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & learning_fold(id_col)).groupBy(
        F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    picked = lab.orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_train)  # bounded: 16 bytes a row
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        feats, pack = Features(), zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            got = [pack(idx.tobytes()) for _, idx in feats.rows(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), pa.array(got, pa.binary())],
                                             names=["id", "y", "idx"])

    def train(t: pa.Table) -> pa.Table:
        import zstandard
        grow = zstandard.ZstdDecompressor().decompress
        t = t.sort_by("id")
        x = [np.frombuffer(grow(b), np.int32) if len(b) else np.zeros(0, np.int32) for b in t.column("idx").to_pylist()]
        w, bias, slope, shift = fit_rows(x, np.where(t.column("y").to_numpy() > 0, 1.0, -1.0))
        return pa.table({"weight": pa.array([w.astype(np.float64).tobytes()], pa.binary()), "bias": [bias],
                         "slope": [slope], "shift": [shift]})

    sample = rows.select("id", "text", "y").mapInArrow(textops.returning_memory(extract), "id string, y int, idx binary").groupBy("id").agg(
        F.min("y").alias("y"), F.min("idx").alias("idx")).withColumn("all", F.lit(0))  # at most max_train rows
    got = sample.groupBy("all").applyInArrow(
        train, "weight binary, bias double, slope double, shift double").collect()
    if not got:
        return Model(np.zeros(BUCKETS), 0.0, 1e-6, 0.0)
    return Model(np.frombuffer(got[0]["weight"], np.float64), got[0]["bias"], got[0]["slope"], got[0]["shift"])


def _scores(model: Model, feats: Features, col: pa.Array) -> np.ndarray:
    out = np.empty(len(col))
    for i, idx in feats.rows(col):
        out[i] = model.weight[idx].sum() / np.sqrt(max(1, len(idx))) + model.bias
    return model.score(out)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.3) -> DataFrame:
    """``id_col, held_out, score, predicted`` per row. Null and empty texts have no
    n-grams and are scored by the bias alone; repeated rows repeat their score; an
    empty table gives no rows; other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_scores(model, feats, b.column(2)))],
                                             names=["id", "held_out", "score"])

    src = docs.select(F.col(id_col).alias("id"), (~learning_fold(id_col)).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType())])
    return src.mapInArrow(textops.returning_memory(run), schema).select(F.col("id").alias(id_col), "held_out", "score",
                                              (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches ``threshold``: map-only."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features()
        for b in batches:
            yield b.filter(pa.array(_scores(model, feats, b.column(at).cast(pa.string())) >= threshold))

    return docs.mapInArrow(textops.returning_memory(run), docs.schema)
