"""Golden confusion matrices written in the reference's text ([[TN,FP],[FN,TP]])."""

import pytest
from pyspark.sql import functions as F

from evweave.operators import metrics as M

GOLDEN = {  # name: (matrix, accuracy, P1, R1, F1_1, R0)
    "tag0": ([[7660, 141], [547, 436]], 0.9217, 0.7556, 0.4435, 0.5590, 0.9819),
    "tag1": ([[511, 129], [219, 2174]], 0.8853, 0.9440, 0.9085, 0.9259, 0.7984),
    "tag2": ([[16, 12], [25, 1695]], 0.9788, 0.9930, 0.9855, 0.9892, 0.5714),
    "tag2_only": ([[17, 11], [33, 1687]], 0.9748, 0.9935, 0.9808, 0.9871, 0.6071),
    "dnn": ([[78, 30], [676, 4459]], 0.8653, 0.9933, 0.8684, 0.9266, 0.7222),
}


def _rows(spark, m):
    (tn, fp), (fn, tp) = m
    spec = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    parts = [spark.range(n).select(F.lit(y).alias("label"), F.lit(p).alias("prediction"),
                                   F.lit(1.0).alias("weight")) for y, p, n in spec]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.mark.parametrize("name", list(GOLDEN))
def test_golden_reports(spark, name):
    m, acc, p1, r1, f1, r0 = GOLDEN[name]
    cm = M.confusion(_rows(spark, m))
    row = cm.select(*M.accuracy_columns(), *M.f1_columns("n_")).first()
    assert round(row["accuracy"], 4) == acc
    assert round(row["weighted_accuracy"], 4) == acc   # unit weights
    assert round(row["f1_1"], 4) == f1
    rep = {(r["weighted"], r["class"]): r for r in M.class_report(cm).collect()}
    assert round(rep[(False, "1")]["precision"], 4) == p1
    assert round(rep[(False, "1")]["recall"], 4) == r1
    assert round(rep[(False, "0")]["recall"], 4) == r0
    assert rep[(False, "1")]["support"] == m[1][0] + m[1][1]


def test_zero_division_gives_zero(spark):
    # nothing predicted positive: precision of class 1 is 0/0 → 0
    d = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (1, 0, 2.0)], "label int, prediction int, weight double")
    rep = {(r["weighted"], r["class"]): r for r in M.class_report(M.confusion(d)).collect()}
    assert rep[(False, "1")]["precision"] == 0.0
    assert rep[(False, "1")]["f1"] == 0.0
    assert rep[(True, "1")]["recall"] == 0.0


def test_signed_weights_every_cell(spark):
    rows = [(0, 0, -1.0), (0, 0, 3.0), (0, 1, -0.5), (0, 1, 2.0), (1, 0, -2.0), (1, 0, 5.0), (1, 1, -1.0),
            (1, 1, 4.0)]
    d = spark.createDataFrame(rows, "label int, prediction int, weight double")
    r = M.confusion(d).first()
    assert (r["w_tn"], r["w_fp"], r["w_fn"], r["w_tp"]) == (2.0, 1.5, 3.0, 3.0)
    assert (r["n_tn"], r["n_fp"], r["n_fn"], r["n_tp"]) == (2, 2, 2, 2)
    acc = M.confusion(d).select(*M.accuracy_columns()).first()
    assert acc["weighted_accuracy"] == pytest.approx(5.0 / 9.5)
