"""Evaluation queries on the event view's ``score`` column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.util import round_doubles
from ..operators import metrics as M
from ..operators import split as X
from ..registry import ev_sql, query
from .common import LABELLED_CTE, SR_CTE, THRESHOLDS, labelled, labelled_sr

TH = 0.4


def _div(a: str, b: str) -> str:
    return f"case when ({b}) != 0 then cast({a} as double) / cast({b} as double) else 0.0 end"


def _cm_sql(src: str, keys: str = "", th: float = TH, op: str = ">") -> str:
    k = f"{keys}, " if keys else ""
    g = f"group by {keys}" if keys else ""
    p = f"case when score {op} {th} then 1 else 0 end"
    cells = {"tn": f"label = 0 and {p} = 0", "fp": f"label = 0 and {p} = 1",
             "fn": f"label = 1 and {p} = 0", "tp": f"label = 1 and {p} = 1"}
    n = ", ".join(f"cast(sum(case when {c} then 1 else 0 end) as bigint) as n_{x}" for x, c in cells.items())
    w = ", ".join(f"sum(case when {c} then weight else 0.0 end) as w_{x}" for x, c in cells.items())
    return f"select {k}{n}, {w} from {src} {g}"


def _round_cells(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return (f"select {k}n_tn, n_fp, n_fn, n_tp, round(w_tn, 6) as w_tn, round(w_fp, 6) as w_fp, "
            f"round(w_fn, 6) as w_fn, round(w_tp, 6) as w_tp from cm")


@query("e1_confusion_by_tag", headline=True, oracle=ev_sql(
    _round_cells("tag"), LABELLED_CTE, SR_CTE, f"cm as ({_cm_sql('sr', 'tag')})"))
def e1_confusion(spark, sf):
    """L7 → E1: confusion cells per tag at th 0.4, counted and weighted (signed weights)."""
    d = M.with_prediction(labelled_sr(spark, sf), TH)
    return round_doubles(M.confusion(d, ["tag"]))


def _report_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    parts = []
    for weighted, pre in (("false", "n_"), ("true", "w_")):
        tn, fp, fn, tp = (f"cast({pre}{c} as double)" for c in ("tn", "fp", "fn", "tp"))
        s0, s1 = f"({tn} + {fp})", f"({fn} + {tp})"
        p0, r0, f0 = _div(tn, f"{tn} + {fn}"), _div(tn, f"{tn} + {fp}"), _div(f"2 * {tn}", f"2 * {tn} + {fn} + {fp}")
        p1, r1, f1 = _div(tp, f"{tp} + {fp}"), _div(tp, f"{tp} + {fn}"), _div(f"2 * {tp}", f"2 * {tp} + {fn} + {fp}")
        tot = f"({s0} + {s1})"
        rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
                ("macro avg", f"(({p0}) + ({p1})) / 2", f"(({r0}) + ({r1})) / 2", f"(({f0}) + ({f1})) / 2", tot),
                ("weighted avg", _div(f"({p0}) * {s0} + ({p1}) * {s1}", tot),
                 _div(f"({r0}) * {s0} + ({r1}) * {s1}", tot), _div(f"({f0}) * {s0} + ({f1}) * {s1}", tot), tot)]
        for cls, p, r, f, s in rows:
            parts.append(f"select {k}{weighted} as weighted, '{cls}' as class, round({p}, 6) as precision, "
                         f"round({r}, 6) as recall, round({f}, 6) as f1, round({s}, 6) as support from cm")
    return " union all ".join(parts)


@query("e2_class_report", oracle=ev_sql(_report_sql(), LABELLED_CTE, SR_CTE, f"cm as ({_cm_sql('sr')})"))
def e2_class_report(spark, sf):
    """precision/recall/F1/support for 0, 1, macro and weighted averages, both ways."""
    d = M.with_prediction(labelled_sr(spark, sf), TH)
    return round_doubles(M.class_report(M.confusion(d)))


@query("e3_accuracy_by_tag", oracle=ev_sql(
    f"select tag, round({_div('n_tn + n_tp', 'n_tn + n_fp + n_fn + n_tp')}, 6) as accuracy, "
    f"round({_div('w_tn + w_tp', 'w_tn + w_fp + w_fn + w_tp')}, 6) as weighted_accuracy from cm",
    LABELLED_CTE, SR_CTE, f"cm as ({_cm_sql('sr', 'tag')})"))
def e3_accuracy(spark, sf):
    d = M.with_prediction(labelled_sr(spark, sf), TH)
    return round_doubles(M.confusion(d, ["tag"]).select("tag", *M.accuracy_columns()))


def _f1_sql(keys: str = "", pre: str = "w_") -> str:
    k = f"{keys}, " if keys else ""
    tn, fp, fn, tp = (f"cast({pre}{c} as double)" for c in ("tn", "fp", "fn", "tp"))
    s0, s1 = f"({tn} + {fp})", f"({fn} + {tp})"
    f0, f1 = _div(f"2 * {tn}", f"2 * {tn} + {fn} + {fp}"), _div(f"2 * {tp}", f"2 * {tp} + {fn} + {fp}")
    return (f"select {k}round({f0}, 6) as f1_0, round({f1}, 6) as f1_1, "
            f"round({_div(f'({f0}) * {s0} + ({f1}) * {s1}', f'{s0} + {s1}')}, 6) as f1_wavg from cm")


@query("e4_f1_weighted", oracle=ev_sql(_f1_sql(), LABELLED_CTE, SR_CTE, f"cm as ({_cm_sql('sr')})"))
def e4_f1(spark, sf):
    """F1 of each class and the support-weighted mean, sample-weighted."""
    d = M.with_prediction(labelled_sr(spark, sf), TH)
    return round_doubles(M.confusion(d).select(*M.f1_columns("w_")))


def _eval_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    rep = _report_sql(keys)
    longrep = " union all ".join(
        f"select {k}weighted, class, '{m}' as metric, {m} as value from rep" for m in ("precision", "recall", "f1", "support"))
    acc = (f"select {k}false as weighted, 'all' as class, 'accuracy' as metric, "
           f"round({_div('n_tn + n_tp', 'n_tn + n_fp + n_fn + n_tp')}, 6) as value from cm union all "
           f"select {k}true, 'all', 'accuracy', round({_div('w_tn + w_tp', 'w_tn + w_fp + w_fn + w_tp')}, 6) from cm")
    cells = " union all ".join(
        f"select {k}{w}, 'all', 'cm_{c}', round(cast({'w' if w == 'true' else 'n'}_{c} as double), 6) from cm"
        for w in ("false", "true") for c in ("tn", "fp", "fn", "tp"))
    return f"select * from ({longrep} union all {acc} union all {cells}) t", f"rep as ({rep})"


def _eval_oracle(keys: str, src_ctes: list[str], src: str) -> str:
    body, rep = _eval_sql(keys)
    return ev_sql(body, *src_ctes, f"cm as ({_cm_sql(src, keys)})", rep)


@query("e5_complete_evaluation", oracle=_eval_oracle("", [LABELLED_CTE, SR_CTE], "sr"))
def e5_complete(spark, sf):
    """Class report, accuracy and confusion cells, unweighted and weighted, th 0.4."""
    return round_doubles(M.evaluate(labelled_sr(spark, sf), TH))


@query("e7_evaluation_per_tag", oracle=_eval_oracle("tag", [LABELLED_CTE, SR_CTE], "sr"))
def e7_per_tag(spark, sf):
    """Complete evaluation for every tag from one aggregation."""
    return round_doubles(M.evaluate(labelled_sr(spark, sf), TH, ["tag"]))


_MP_SR = ("mpsr as (select cast(regexp_extract(sample, '([0-9]+)', 1) as int) as mass, label, weight, score from sr "
          "where sample like 'sig%' union all select m.mass, label, weight, score from sr cross join "
          "(select unnest([1000, 1500, 2000]) as mass) m where not (sample like 'sig%'))")


@query("e8_evaluation_per_mass", oracle=_eval_oracle("mass", [LABELLED_CTE, SR_CTE, _MP_SR], "mpsr"))
def e8_per_mass(spark, sf):
    """J1 → E8: complete evaluation per signal mass (background shared by all masses)."""
    from ..operators.select import mass_parameterised
    mp = mass_parameterised(labelled_sr(spark, sf).select("sample", "label", "weight", "score"), [1000, 1500, 2000])
    return round_doubles(M.evaluate(mp.drop("sample"), TH, ["mass"]))


_CURVE = ("cur as (select threshold, pos_w, neg_w, "
          "sum(pos_w) over (order by threshold desc rows between unbounded preceding and current row) as tps, "
          "sum(neg_w) over (order by threshold desc rows between unbounded preceding and current row) as fps, "
          "sum(pos_w) over () as tps_total, sum(neg_w) over () as fps_total from "
          "(select score as threshold, sum(case when label = 1 then weight else 0.0 end) as pos_w, "
          "sum(case when label = 0 then weight else 0.0 end) as neg_w from sr group by score) s)")


@query("e9_roc_curve", oracle=ev_sql(
    f"select threshold, round({_div('fps', 'fps_total')}, 6) as fpr, round({_div('tps', 'tps_total')}, 6) as tpr from cur",
    LABELLED_CTE, SR_CTE, _CURVE))
def e9_roc(spark, sf):
    """Weighted ROC points at every distinct score (two-level running sums)."""
    return round_doubles(M.roc_curve(labelled_sr(spark, sf)))


@query("e10_roc_auc", headline=True, oracle=ev_sql(
    f"select round({_div('sum(neg_w * ((tps - pos_w) + tps) / 2.0)', 'max(tps_total) * max(fps_total)')}, 6) as auc "
    "from cur", LABELLED_CTE, SR_CTE, _CURVE))
def e10_auc(spark, sf):
    """Trapezoid ROC AUC with signed weights."""
    return round_doubles(M.roc_auc(labelled_sr(spark, sf)))


@query("e10_roc_auc_unweighted", oracle=ev_sql(
    f"select round({_div('sum(neg_w * ((tps - pos_w) + tps) / 2.0)', 'max(tps_total) * max(fps_total)')}, 6) as auc "
    "from cur", LABELLED_CTE, "sr as (select label, score, 1.0 as weight from lab where region = 'SR' "
    "and sample <> 'data')", _CURVE))
def e10_auc_unweighted(spark, sf):
    """E10 unweighted (equals the Mann–Whitney statistic; 0.650203 at sf0.01)."""
    return round_doubles(M.roc_auc(labelled_sr(spark, sf), weight=None))


@query("e11_pr_curve", oracle=ev_sql(
    f"select threshold, round(p, 6) as precision, round(r, 6) as recall, "
    "case when ptps = 0 and pfps = 0 then false else sign(p - r) != sign(pp - pr) end as crossing from ("
    f"select threshold, tps - pos_w as ptps, fps - neg_w as pfps, {_div('tps', 'tps + fps')} as p, "
    f"{_div('tps', 'tps_total')} as r, {_div('tps - pos_w', '(tps - pos_w) + (fps - neg_w)')} as pp, "
    f"{_div('tps - pos_w', 'tps_total')} as pr from cur) t",
    LABELLED_CTE, SR_CTE, _CURVE))
def e11_pr(spark, sf):
    """E11 + E13: precision/recall per threshold and the precision = recall crossings."""
    return round_doubles(M.pr_curve(labelled_sr(spark, sf)))


@query("e12_average_precision", oracle=ev_sql(
    f"select round(sum({_div('pos_w', 'tps_total')} * {_div('tps', 'tps + fps')}), 6) as average_precision from cur",
    LABELLED_CTE, SR_CTE, _CURVE))
def e12_ap(spark, sf):
    return round_doubles(M.average_precision(labelled_sr(spark, sf)))


def _th_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    ths = ", ".join(repr(float(t)) for t in sorted(THRESHOLDS))
    cells = {"tn": "label = 0 and not (score > th)", "fp": "label = 0 and score > th",
             "fn": "label = 1 and not (score > th)", "tp": "label = 1 and score > th"}
    n = ", ".join(f"cast(sum(case when {c} then 1 else 0 end) as bigint) as n_{x}" for x, c in cells.items())
    w = ", ".join(f"sum(case when {c} then weight else 0.0 end) as w_{x}" for x, c in cells.items())
    return (f"select {k}th, {n}, {w} from {src} cross join (select cast(unnest([{ths}]) as double) as th) t "
            f"group by {k}th")


@query("e14_f1_per_threshold", headline=True, oracle=ev_sql(
    _f1_sql("th"), LABELLED_CTE, SR_CTE, f"cm as ({_th_sql('sr')})"))
def e14_f1_thresholds(spark, sf):
    """J7 → E14: weighted F1 per threshold, all thresholds in one pass."""
    return round_doubles(M.f1_per_threshold(labelled_sr(spark, sf), THRESHOLDS))


@query("e14_f1_per_threshold_tag", oracle=ev_sql(
    _f1_sql("tag, th"), LABELLED_CTE, SR_CTE, f"cm as ({_th_sql('sr', 'tag')})"))
def e14_f1_thresholds_tag(spark, sf):
    """E14 per tag: weighted F1 per (tag, threshold) in one pass."""
    return round_doubles(M.f1_per_threshold(labelled_sr(spark, sf), THRESHOLDS, ["tag"]))


def _x1_cte():
    from .split_q import _ranked_cte, _split_case
    return [_ranked_cte("lab"),
            f"s as (select label, score, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r)"]


@query("e19_metrics_per_split", oracle=ev_sql(
    "select split, " + ", ".join([
        f"round({_div('n_tn + n_tp', 'n_tn + n_fp + n_fn + n_tp')}, 6) as accuracy",
        f"round({_div('n_tp', 'n_tp + n_fp')}, 6) as precision",
        f"round({_div('n_tp', 'n_tp + n_fn')}, 6) as recall",
        f"round({_div('2 * n_tp', '2 * n_tp + n_fp + n_fn')}, 6) as f1"]) + " from cm",
    LABELLED_CTE, *_x1_cte(),
    "cm as (select split, " + ", ".join(
        f"sum(case when label = {y} and (case when score > 0.5 then 1 else 0 end) = {p} then 1 else 0 end) as n_{c}"
        for c, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))) + " from s group by split)"))
def e19_per_split(spark, sf):
    """X1 → E19: accuracy, precision, recall, F1 on train / val / test."""
    d = labelled(spark, sf).select("event_key", "label", "score")
    s = X.assign_split(d, 0.6, 0.2, 0.2, 42)
    return round_doubles(M.split_metrics(s, 0.5))


@query("e21_smoothed_scores", oracle=ev_sql(
    "select round(tp / (pp + 1e-7), 6) as precision, round(tp / (ap + 1e-7), 6) as recall, "
    "round(2.0 * ((tp / (pp + 1e-7)) * (tp / (ap + 1e-7))) / ((tp / (pp + 1e-7)) + (tp / (ap + 1e-7)) + 1e-7), 6) "
    "as f1 from (select sum(round_even(least(greatest(label * score, 0.0), 1.0), 0)) as tp, "
    "sum(round_even(least(greatest(score, 0.0), 1.0), 0)) as pp, "
    "sum(round_even(least(greatest(cast(label as double), 0.0), 1.0), 0)) as ap from sr) t",
    LABELLED_CTE, SR_CTE))
def e21_smoothed(spark, sf):
    """ε-smoothed precision/recall/F1 on half-even-rounded clipped scores."""
    return round_doubles(M.smoothed_scores(labelled_sr(spark, sf)))


# --- row-level expressions -----------------------------------------------------------

@query("l7_l8_threshold_rules", oracle=ev_sql(
    "select tag, cast(sum(case when score > 0.5 then 1 else 0 end) as bigint) as n_strict, "
    "cast(sum(case when score >= 0.5 then 1 else 0 end) as bigint) as n_inclusive from sr group by tag",
    LABELLED_CTE, SR_CTE))
def l7_l8(spark, sf):
    """Strict and inclusive threshold rules, counted per tag."""
    d = labelled_sr(spark, sf)
    return d.groupBy("tag").agg(F.sum(L.predict_class("score", 0.5)).cast("long").alias("n_strict"),
                                F.sum(L.predict_class("score", 0.5, True)).cast("long").alias("n_inclusive"))


@query("l9_threshold_at_mean", oracle=ev_sql(
    "select tag, label, cast(sum(case when score > m then 1 else 0 end) as bigint) as n_pos, count(*) as n "
    "from sr join (select tag as t2, avg(score) as m from sr group by tag) a on tag = t2 group by tag, label",
    LABELLED_CTE, SR_CTE))
def l9_mean_threshold(spark, sf):
    """Predict 1 above the mean score of the row's tag."""
    d = M.predict_at_mean(labelled_sr(spark, sf), "score", ["tag"])
    return d.groupBy("tag", "label").agg(F.sum("prediction").cast("long").alias("n_pos"),
                                         F.count(F.lit(1)).alias("n"))


def _clip(x: str) -> str:
    return f"least(greatest({x}, 1e-7), 1.0 - 1e-7)"


@query("l12_l14_losses", oracle=ev_sql(
    "select tag, round(avg(bce), 6) as bce, round(avg(focal), 6) as focal, round(avg(logit_bce), 6) as logit_bce "
    "from (select tag, "
    f"-(label * ln({_clip('score')} + 1e-7) + (1 - label) * ln(1.0 - {_clip('score')} + 1e-7)) as bce, "
    f"-0.25 * (label * ln({_clip('score')} + 1e-7) * pow(1.0 - {_clip('score')}, 2.0) + "
    f"(1 - label) * ln(1.0 - {_clip('score')} + 1e-7) * pow({_clip('score')}, 2.0)) as focal, "
    f"greatest(ln({_clip('score')} / (1.0 - {_clip('score')})), 0.0) - ln({_clip('score')} / (1.0 - {_clip('score')})) * label "
    f"+ ln(1 + exp(-abs(ln({_clip('score')} / (1.0 - {_clip('score')}))))) as logit_bce from sr) t group by tag",
    LABELLED_CTE, SR_CTE))
def l12_losses(spark, sf):
    """Mean clipped cross-entropy, focal loss and logit cross-entropy per tag."""
    d = labelled_sr(spark, sf)
    return round_doubles(d.groupBy("tag").agg(
        F.avg(L.binary_crossentropy("label", "score")).alias("bce"),
        F.avg(L.focal_loss("label", "score", 0.25, 2.0)).alias("focal"),
        F.avg(L.logit_crossentropy("label", "score")).alias("logit_bce")))


@query("l15_class_weighted_yield", oracle=ev_sql(
    "select label, round(sum(weight * case when label = 1 then 10.0 else 15.0 end), 6) as w "
    "from lab group by label", LABELLED_CTE))
def l15_class_weighted(spark, sf):
    """Class-weighted sample weights (background 15, signal 10), summed per class."""
    d = labelled(spark, sf)
    return round_doubles(d.groupBy("label").agg(F.sum(L.class_weighted("weight", "label", 15.0, 10.0)).alias("w")))


@query("e13_precision_recall_crossings", oracle=ev_sql(
    "select threshold, round(p, 6) as precision, round(r, 6) as recall from ("
    f"select threshold, tps - pos_w as ptps, fps - neg_w as pfps, {_div('tps', 'tps + fps')} as p, "
    f"{_div('tps', 'tps_total')} as r, {_div('tps - pos_w', '(tps - pos_w) + (fps - neg_w)')} as pp, "
    f"{_div('tps - pos_w', 'tps_total')} as pr from cur) t "
    "where not (ptps = 0 and pfps = 0) and sign(p - r) != sign(pp - pr)",
    LABELLED_CTE, SR_CTE, _CURVE))
def e13_crossings(spark, sf):
    """E11 → E13: thresholds where precision − recall changes sign."""
    c = M.pr_curve(labelled_sr(spark, sf))
    return round_doubles(c.where(F.col("crossing")).select("threshold", "precision", "recall"))


_LAB_NODATA = "nd as (select * from lab where sample <> 'data')"


@query("e6_evaluation_default_th_by_region", oracle=_eval_oracle("region", [LABELLED_CTE, _LAB_NODATA], "nd"))
def e6_default_th(spark, sf):
    """The evaluation at the default threshold 0.4 (with and without
    weights) for every region, data sample excluded."""
    d = labelled(spark, sf).where(F.col("sample") != "data")
    return round_doubles(M.evaluate(d, keys=["region"]))
