"""Evaluation with signed weights.

Spark's ``ml.evaluation`` rejects negative weights, so every metric here is a
DataFrame aggregation:

* confusion-matrix cells (unweighted and weighted) are ONE ``groupBy(slice)``
  with conditional sums; reports, accuracy and F1 are arithmetic on that row;
* a threshold sweep never rescans per threshold: each row gets the number
  of thresholds below its score (a JVM-side fold over the short threshold
  array), the table is aggregated to (slice, count, label) — a few rows —
  and the cells of threshold j sum the rows whose count exceeds j;
* ROC / PR curves aggregate to distinct scores first, then use range-partitioned
  running sums (no single-task window). The "previous point" of a curve is the
  running total minus the row's own contribution, so AUC, AP and crossing
  points are row-local — no global ``lag``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import predict_class
from ..plans.ranges import running_sums
from ..plans.small import join_checked, stored, with_scalars
from ..schema import DEFAULT_ROLES, Roles

CELLS = ("tn", "fp", "fn", "tp")


def _div(a: Column, b: Column) -> Column:
    """a / b, with 0 where b = 0 (zero-division → 0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# --- E1: confusion matrix -------------------------------------------------------

def confusion(df: DataFrame, keys: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
              weight: str | None = "weight") -> DataFrame:
    """Per slice the four cells, counted (``n_*``) and weighted (``w_*``)."""
    y, p = F.col(label), F.col(prediction)
    conds = {"tn": (y == 0) & (p == 0), "fp": (y == 0) & (p == 1),
             "fn": (y == 1) & (p == 0), "tp": (y == 1) & (p == 1)}
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*keys).agg(
        *[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(f"n_{k}") for k, c in conds.items()],
        *[F.sum(F.when(c, w).otherwise(0.0)).alias(f"w_{k}") for k, c in conds.items()])


def _class_stats(tn, fp, fn, tp):
    s0, s1 = tn + fp, fn + tp
    p0, r0, f0 = _div(tn, tn + fn), _div(tn, tn + fp), _div(2 * tn, 2 * tn + fn + fp)
    p1, r1, f1 = _div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fn + fp)
    return (s0, p0, r0, f0), (s1, p1, r1, f1)


def f1_columns(prefix: str = "w_") -> list[Column]:
    """F1 of class 0, class 1 and their support-weighted mean, from the
    cells ``{prefix}tn`` … ``{prefix}tp`` of a confusion row."""
    tn, fp, fn, tp = (F.col(f"{prefix}{c}").cast("double") for c in CELLS)
    (s0, _, _, f0), (s1, _, _, f1) = _class_stats(tn, fp, fn, tp)
    return [f0.alias("f1_0"), f1.alias("f1_1"), _div(f0 * s0 + f1 * s1, s0 + s1).alias("f1_wavg")]


def accuracy_columns() -> list[Column]:
    """Accuracy unweighted and weighted from a confusion row."""
    n = [F.col(f"n_{c}").cast("double") for c in CELLS]
    w = [F.col(f"w_{c}") for c in CELLS]
    return [_div(n[0] + n[3], n[0] + n[1] + n[2] + n[3]).alias("accuracy"),
            _div(w[0] + w[3], w[0] + w[1] + w[2] + w[3]).alias("weighted_accuracy")]


def class_report(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, weighted, class, precision, recall, f1, support) for
    classes 0 and 1, ``macro avg`` and ``weighted avg``, both unweighted and
    weighted; zero division gives 0."""
    structs = []
    for weighted, pre in ((False, "n_"), (True, "w_")):
        tn, fp, fn, tp = (F.col(f"{pre}{c}").cast("double") for c in CELLS)
        (s0, p0, r0, f0), (s1, p1, r1, f1) = _class_stats(tn, fp, fn, tp)
        tot = s0 + s1

        def row(cls, p, r, f, s):
            return F.struct(F.lit(weighted).alias("weighted"), F.lit(cls).alias("class"), p.alias("precision"),
                            r.alias("recall"), f.alias("f1"), s.alias("support"))
        structs += [row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
                    row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
                    row("weighted avg", _div(p0 * s0 + p1 * s1, tot), _div(r0 * s0 + r1 * s1, tot),
                        _div(f0 * s0 + f1 * s1, tot), tot)]
    return cm.select(*keys, F.explode(F.array(*structs)).alias("r")).select(*keys, "r.*")


def evaluate(df: DataFrame, th: float = 0.4, keys: Sequence[str] = (), score: str = "score",
             label: str = "label", weight: str = "weight", inclusive: bool = False) -> DataFrame:
    """Complete evaluation at threshold ``th`` per slice as long
    rows (keys, weighted, class, metric, value): class report (support
    included), accuracy and the confusion cells — all from ONE aggregation."""
    d = df.withColumn("prediction", predict_class(score, th, inclusive))
    cm = confusion(d, keys, label, "prediction", weight)
    rep = class_report(cm, keys)
    metrics = ["precision", "recall", "f1", "support"]
    long_rep = rep.select(*keys, "weighted", "class", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")
    ).select(*keys, "weighted", "class", "m.metric", "m.value")
    acc = cm.select(*keys, *accuracy_columns())
    long_acc = acc.select(*keys, F.explode(F.array(
        F.struct(F.lit(False).alias("weighted"), F.col("accuracy").alias("value")),
        F.struct(F.lit(True).alias("weighted"), F.col("weighted_accuracy").alias("value")))).alias("a")
    ).select(*keys, "a.weighted", F.lit("all").alias("class"), F.lit("accuracy").alias("metric"), "a.value")
    cells = cm.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(w).alias("weighted"), F.lit(f"cm_{c}").alias("metric"),
                 F.col(f"{'w' if w else 'n'}_{c}").cast("double").alias("value"))
        for w in (False, True) for c in CELLS])).alias("c")
    ).select(*keys, "c.weighted", F.lit("all").alias("class"), "c.metric", "c.value")
    return long_rep.unionByName(long_acc).unionByName(cells)


def evaluation_json(df: DataFrame, th: float = 0.4, keys: Sequence[str] = (), score: str = "score",
                    label: str = "label", weight: str = "weight") -> DataFrame:
    """E5 in the nested shape of the reference's JSON report: per slice one
    row with ``class_report``, ``weighted_class_report`` (maps class → metrics),
    ``accuracy``, ``weighted_accuracy``, ``cm`` and ``weighted_cm``
    (``[[TN, FP], [FN, TP]]``). Write it with ``df.write.json``."""
    d = df.withColumn("prediction", predict_class(score, th))
    cm = confusion(d, keys, label, "prediction", weight)
    rep = class_report(cm, keys)
    metrics = F.struct("precision", "recall", "f1", "support")
    maps = rep.groupBy(*keys, "weighted").agg(F.map_from_entries(F.collect_list(F.struct("class", metrics)))
                                              .alias("report"))
    unw = maps.where(~F.col("weighted")).select(*keys, F.col("report").alias("class_report"))
    wtd = maps.where(F.col("weighted")).select(*keys, F.col("report").alias("weighted_class_report"))
    base = cm.select(*keys, *accuracy_columns(),
                     F.array(F.array("n_tn", "n_fp"), F.array("n_fn", "n_tp")).alias("cm"),
                     F.array(F.array("w_tn", "w_fp"), F.array("w_fn", "w_tp")).alias("weighted_cm"))
    if keys:
        return base.join(unw, list(keys)).join(wtd, list(keys))
    return with_scalars(with_scalars(base, unw), wtd)


# --- J7 / E14–E16: threshold sweeps ---------------------------------------------

def threshold_cells(df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (),
                    score: str = "score", label: str = "label", weight: str | None = "weight",
                    inclusive: bool = False) -> DataFrame:
    """Confusion cells for every threshold and slice in one pass.

    ``k`` = number of thresholds strictly below the score (``<=`` for the
    inclusive rule); the row is predicted positive at threshold j iff j < k.
    The data is aggregated to (keys, k, label) before anything else, so the
    shuffle carries at most (#slices × (#thresholds+1) × 2) rows per task."""
    ths = sorted(float(t) for t in set(thresholds))
    s = F.col(score)
    k = F.lit(0)  # a sum of conditions stays in generated code; an array aggregate would not
    for t in ths:
        k = k + F.when((F.lit(t) <= s) if inclusive else (F.lit(t) < s), 1).otherwise(0)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    small = df.groupBy(*keys, k.alias("_k"), F.col(label).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    # each small row once per threshold (a fixed list): small × #thresholds rows
    th_arr = F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(t).alias("th")) for j, t in enumerate(ths)])
    x = small.select("*", F.explode(th_arr).alias("_t")).select(*small.columns, "_t._j", "_t.th")
    pos = F.col("_k") > F.col("_j")
    y = F.col("_y")
    conds = {"tn": (y == 0) & ~pos, "fp": (y == 0) & pos, "fn": (y == 1) & ~pos, "tp": (y == 1) & pos}
    return x.groupBy(*keys, "th").agg(
        *[F.sum(F.when(c, F.col("_n")).otherwise(0)).cast("long").alias(f"n_{n}") for n, c in conds.items()],
        *[F.sum(F.when(c, F.col("_w")).otherwise(0.0)).alias(f"w_{n}") for n, c in conds.items()])


def f1_per_threshold(df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (),
                     score: str = "score", label: str = "label", weight: str | None = "weight") -> DataFrame:
    """(keys, th, f1_0, f1_1, f1_wavg), sample-weighted as the reference."""
    cells = threshold_cells(df, thresholds, keys, score, label, weight)
    return cells.select(*keys, "th", *f1_columns("w_"))


def f1_per_threshold_levels(df: DataFrame, thresholds: Sequence[float], comb: str = "comb", slice_col: str = "mass",
                            score: str = "score", label: str = "label", weight: str = "weight") -> DataFrame:
    """F1 per (comb, slice, th) and per (comb, th) over all slices, the
    latter labelled ``all`` — cells of every slice are computed once and
    the "all" level is a second aggregation of that small table."""
    cells = threshold_cells(df, thresholds, [comb, slice_col], score, label, weight)
    cols = [f"{p}{c}" for p in ("n_", "w_") for c in CELLS]
    per = cells.withColumn(slice_col, F.col(slice_col).cast("string"))
    allr = cells.groupBy(comb, "th").agg(*[F.sum(c).alias(c) for c in cols]).withColumn(slice_col, F.lit("all"))
    both = per.unionByName(allr)
    return both.select(comb, slice_col, "th", *f1_columns("w_"))


def split_metrics(df: DataFrame, th: float = 0.5, score: str = "score", label: str = "label",
                  split: str = "split", weight: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 (class 1) on each split."""
    d = df.withColumn("prediction", predict_class(score, th))
    cm = confusion(d, [split], label, "prediction", weight)
    pre = "w_" if weight else "n_"
    tn, fp, fn, tp = (F.col(f"{pre}{c}").cast("double") for c in CELLS)
    return cm.select(split, _div(tn + tp, tn + fp + fn + tp).alias("accuracy"),
                     _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
                     _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


# --- E9–E13: curves -----------------------------------------------------------------

def score_totals(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
                 weight: str | None = "weight") -> DataFrame:
    """Per (keys, distinct score): positive and negative weight."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label)
    return df.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos_w"),
        F.sum(F.when(y == 0, w).otherwise(0.0)).alias("neg_w"))


def curve_points(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
                 weight: str | None = "weight") -> DataFrame:
    """Running positives/negatives at every distinct score, highest first:
    columns keys, threshold, pos_w, neg_w, tps, fps, tps_total, fps_total.

    The distinct scores are range-partitioned, as many tasks as they need, so a
    continuous score over any number of rows is summed exactly."""
    # the distinct-score table is stored once so the source is read once
    st = stored(score_totals(df, keys, score, label, weight))
    return running_sums(st, keys, [F.col("threshold").desc()], {"tps": "pos_w", "fps": "neg_w"}, group_totals=True)


def roc_curve(df: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    """(keys, threshold, fpr, tpr) at each distinct score (ties merged),
    without dropping collinear points."""
    c = curve_points(df, keys, **kw)
    return c.select(*keys, "threshold", _div(F.col("fps"), F.col("fps_total")).alias("fpr"),
                    _div(F.col("tps"), F.col("tps_total")).alias("tpr"))


def roc_auc(df: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Trapezoid area under the ROC curve (from (0,0)), per slice."""
    c = curve_points(df, keys, **kw)
    prev_tps = F.col("tps") - F.col("pos_w")
    term = F.col("neg_w") * (prev_tps + F.col("tps")) / 2.0
    return c.groupBy(*keys).agg(
        _div(F.sum(term), F.first("tps_total") * F.first("fps_total")).alias("auc"))


def pr_curve(df: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Precision and recall at every distinct score (``score >=
    threshold`` predicted positive), plus ``crossing`` = the sign of
    precision − recall differs from the next higher threshold's."""
    c = curve_points(df, keys, **kw)
    tps, fps = F.col("tps"), F.col("fps")
    prec, rec = _div(tps, tps + fps), _div(tps, F.col("tps_total"))
    ptps, pfps = tps - F.col("pos_w"), fps - F.col("neg_w")
    pprec, prec_rec = _div(ptps, ptps + pfps), _div(ptps, F.col("tps_total"))
    first = (ptps == 0) & (pfps == 0)
    crossing = F.when(first, F.lit(False)).otherwise(F.signum(prec - rec) != F.signum(pprec - prec_rec))
    return c.select(*keys, "threshold", prec.alias("precision"), rec.alias("recall"), crossing.alias("crossing"))


def average_precision(df: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    """AP = Σ (Rₙ − Rₙ₋₁)·Pₙ over thresholds, highest first."""
    c = curve_points(df, keys, **kw)
    tps, fps = F.col("tps"), F.col("fps")
    term = _div(F.col("pos_w"), F.col("tps_total")) * _div(tps, tps + fps)
    return c.groupBy(*keys).agg(F.sum(term).alias("average_precision"))


# --- E21, J8, L9 -------------------------------------------------------------------

def smoothed_scores(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label",
                    eps: float = 1e-7) -> DataFrame:
    """Batch-style precision/recall/F1 with ε in the denominators and
    scores rounded half-to-even after clipping to [0, 1]."""
    y = F.col(label).cast("double")
    p = F.col(score).cast("double")

    def clip(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    g = df.groupBy(*keys).agg(F.sum(F.bround(clip(y * p), 0)).alias("_tp"),
                              F.sum(F.bround(clip(p), 0)).alias("_pp"),
                              F.sum(F.bround(clip(y), 0)).alias("_ap"))
    prec = F.col("_tp") / (F.col("_pp") + F.lit(eps))
    rec = F.col("_tp") / (F.col("_ap") + F.lit(eps))
    return g.select(*keys, prec.alias("precision"), rec.alias("recall"),
                    (F.lit(2.0) * (prec * rec) / (prec + rec + F.lit(eps))).alias("f1"))


def error_by_class(df: DataFrame, error: str = "error", label: str = "label") -> DataFrame:
    """Reconstruction error beside the true class, summarised per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error"),
                                 F.min(error).alias("min_error"), F.max(error).alias("max_error"))


def predict_at_mean(df: DataFrame, score: str = "score", keys: Sequence[str] = (), out: str = "prediction") -> DataFrame:
    """Threshold each row at the mean score of its slice (one aggregate row
    per slice joined back)."""
    m = df.groupBy(*keys).agg(F.avg(score).alias("_mean_score"))
    j = join_checked(df, stored(m), keys) if keys else with_scalars(df, m)
    return j.withColumn(out, (F.col(score) > F.col("_mean_score")).cast("int"))


def with_prediction(df: DataFrame, th: float, score: str = "score", inclusive: bool = False,
                    roles: Roles = DEFAULT_ROLES) -> DataFrame:
    return df.withColumn("prediction", predict_class(score, th, inclusive))
