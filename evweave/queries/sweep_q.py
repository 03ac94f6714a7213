"""Sweep, comparison, top-k and set-operation queries over stored-network
scores (M7, J3, J4, J6, E15, E16, E20, T1–T5, T7, U3).

Each combination of the grid is a stored dense network (weights from a fixed
rule); all combinations are scored in ONE pass over the events (one score
column per combination, then unpivoted), so the sweep costs one scan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.util import round_doubles
from ..operators import dense as D
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import scale as S
from ..operators import sweep as W
from ..operators.select import mass_parameterised
from ..registry import ev_sql, query
from ..sources import io as IO
from .common import FEATURES, LABELLED_CTE, MASSES, SR_CTE, THRESHOLDS, labelled_sr
from .metrics_q import _f1_sql

COMBS = [0, 1, 2, 3]
HIDDEN = 3


def comb_scores(spark, sf, with_mass: bool = False):
    """(event_key, sample, label, weight, comb, score) for every combination."""
    d = labelled_sr(spark, sf).select("event_key", "sample", "label", "weight", *FEATURES)
    d = S.minmax_scale(d, FEATURES)
    for c in COMBS:
        d = D.dense_score(d, FEATURES, D.rule_network(len(FEATURES), HIDDEN, c), out=f"s{c}")
    long = d.select("event_key", "sample", "label", "weight", *[f"s{c}" for c in COMBS]).unpivot(
        ["event_key", "sample", "label", "weight"], [f"s{c}" for c in COMBS], "comb_name", "score")
    long = long.withColumn("comb", F.substring("comb_name", 2, 5).cast("int")).drop("comb_name")
    if with_mass:
        long = mass_parameterised(long, MASSES)
    return long


def _scores_ctes(with_mass: bool = False) -> list[str]:
    mm = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in FEATURES)
    scaled = ", ".join(
        f"({c} - lo_{c}) / case when hi_{c} - lo_{c} = 0 then 1.0 else hi_{c} - lo_{c} end as {c}" for c in FEATURES)
    parts = [f"select event_key, sample, label, weight, {c} as comb, "
             f"round({D.network_sql(FEATURES, D.rule_network(len(FEATURES), HIDDEN, c))}, 6) as score from sc"
             for c in COMBS]
    ctes = [LABELLED_CTE, SR_CTE,
            f"sc as (select event_key, sample, label, weight, {scaled} from sr cross join (select {mm} from sr) m)",
            f"cs as ({' union all '.join(parts)})"]
    if with_mass:
        ctes.append("csm as (select event_key, label, weight, comb, score, "
                    "cast(regexp_extract(sample, '([0-9]+)', 1) as int) as mass from cs where sample like 'sig%' "
                    "and cast(regexp_extract(sample, '([0-9]+)', 1) as int) in (1000, 1500, 2000) "
                    "union all select event_key, label, weight, comb, score, m.mass from cs cross join "
                    "(select unnest([1000, 1500, 2000]) as mass) m where not (sample like 'sig%'))")
    return ctes


def _th_cells(src: str, keys: str) -> str:
    ths = ", ".join(repr(float(t)) for t in sorted(THRESHOLDS))
    cells = {"tn": "label = 0 and not (score > th)", "fp": "label = 0 and score > th",
             "fn": "label = 1 and not (score > th)", "tp": "label = 1 and score > th"}
    n = ", ".join(f"cast(sum(case when {c} then 1 else 0 end) as bigint) as n_{x}" for x, c in cells.items())
    w = ", ".join(f"sum(case when {c} then weight else 0.0 end) as w_{x}" for x, c in cells.items())
    return (f"select {keys}, th, {n}, {w} from {src} cross join (select cast(unnest([{ths}]) as double) as th) t "
            f"group by {keys}, th")


@query("m7_dense_scores", oracle=ev_sql("select event_key, comb, score from cs", *_scores_ctes()))
def m7_dense_scores(spark, sf):
    """F2 → M7: four stored 5-3-1 networks (relu, sigmoid) scored in one pass."""
    return comb_scores(spark, sf).select("event_key", "comb", "score")


def _e15(spark, sf):
    return M.f1_per_threshold(comb_scores(spark, sf), THRESHOLDS, ["comb"])


_E15_CTES = _scores_ctes() + [f"cm as ({_th_cells('cs', 'comb')})"]


@query("e15_f1_per_comb_threshold", headline=True, oracle=ev_sql(_f1_sql("comb, th"), *_E15_CTES))
def e15_f1_per_comb(spark, sf):
    """J6 grid → M7 → E15: weighted F1 per (combination, threshold) in one pass."""
    return round_doubles(_e15(spark, sf))


@query("j6_grid_of_scores", oracle=ev_sql(
    "select cast(row_number() over (order by comb, th) - 1 as int) as comb_id, comb, th, f1_0, f1_1, f1_wavg from (" + _f1_sql("comb, th") + ")", *_E15_CTES))
def j6_grid(spark, sf):
    """The full product of networks and thresholds as a table with its stable comb_id, joined with the scores."""
    grid = W.param_grid(spark, {"comb": COMBS, "th": sorted(THRESHOLDS)})
    return round_doubles(grid.join(_e15(spark, sf), ["comb", "th"]))


def _e16_sql() -> tuple[str, list[str]]:
    ctes = _scores_ctes(True) + [
        f"cmm as ({_th_cells('csm', 'comb, mass')})",
        "cm as (select comb, cast(mass as varchar) as mass, th, n_tn, n_fp, n_fn, n_tp, w_tn, w_fp, w_fn, w_tp "
        "from cmm union all select comb, 'all', th, sum(n_tn), sum(n_fp), sum(n_fn), sum(n_tp), sum(w_tn), "
        "sum(w_fp), sum(w_fn), sum(w_tp) from cmm group by comb, th)"]
    return _f1_sql("comb, mass, th"), ctes


def _e16(spark, sf):
    return M.f1_per_threshold_levels(comb_scores(spark, sf, with_mass=True), THRESHOLDS, "comb", "mass")


@query("e16_f1_per_comb_mass_threshold", headline=True, oracle=ev_sql(_e16_sql()[0], *_e16_sql()[1]))
def e16_f1_per_mass(spark, sf):
    """J1 → E16: F1 per (comb, mass, th) and per (comb, all masses, th)."""
    return round_doubles(_e16(spark, sf))


@query("e20_error_per_comb", oracle=ev_sql(
    "select comb, round(m.wmean, 6) as wmean, round(sqrt(sum(weight * (e - m.wmean) * (e - m.wmean)) / sum(weight)), 6) "
    "as wstd from (select comb, weight, (score - label) * (score - label) as e from cs) x "
    "join (select comb as c2, sum((score - label) * (score - label) * weight) / sum(weight) as wmean from cs "
    "group by comb) m on comb = m.c2 group by comb, m.wmean", *_scores_ctes()))
def e20_error_per_comb(spark, sf):
    """Weighted mean and population std of the squared error per combination."""
    d = comb_scores(spark, sf).withColumn("e", (F.col("score") - F.col("label")) ** 2)
    return round_doubles(P.weighted_mean_std(d, "e", ["comb"]))


@query("t1_top5_comb_threshold", oracle=ev_sql(
    "select * from (" + _f1_sql("comb, th") + ") t order by f1_1 desc, f1_wavg desc, comb, th limit 5", *_E15_CTES))
def t1_top5(spark, sf):
    """E15 → T1: five best (comb, th) by F1 of class 1, then the weighted mean."""
    return W.top_n(round_doubles(_e15(spark, sf)), 5, ["f1_1", "f1_wavg"], ["comb", "th"])


@query("t2_smallest_error", oracle=ev_sql(
    "select comb, round(sum((score - label) * (score - label) * weight) / sum(weight), 6) as wmean from cs "
    "group by comb order by wmean, comb limit 2", *_scores_ctes()))
def t2_smallest(spark, sf):
    """E20 → T2: the two combinations with the smallest weighted error."""
    d = comb_scores(spark, sf).withColumn("e", (F.col("score") - F.col("label")) ** 2)
    e = round_doubles(d.groupBy("comb").agg((F.sum(F.col("e") * F.col("weight")) / F.sum("weight")).alias("wmean")))
    return W.top_n(e, 2, ["wmean"], ["comb"], ascending=True)


@query("t3_top3_per_mass", oracle=ev_sql(
    "select * from (select *, row_number() over (partition by mass order by f1_wavg desc, comb, th) as rank from ("
    + _e16_sql()[0] + ") t where mass <> 'all') u where rank <= 3", *_e16_sql()[1]))
def t3_top_per_mass(spark, sf):
    """E16 → T3: three best (comb, th) for every mass."""
    e = round_doubles(_e16(spark, sf)).where(F.col("mass") != "all")
    return W.top_n_per(e, 3, ["mass"], ["f1_wavg"], ["comb", "th"])


@query("t4_best_per_metric", oracle=ev_sql(
    "select comb, th, metric, value from (select *, row_number() over (partition by metric order by value desc, "
    "comb, th) as r from (select comb, th, 'f1_0' as metric, f1_0 as value from e union all "
    "select comb, th, 'f1_1', f1_1 from e union all select comb, th, 'f1_wavg', f1_wavg from e) l) x where r = 1",
    *_E15_CTES, f"e as ({_f1_sql('comb, th')})"))
def t4_best_per_metric(spark, sf):
    """E15 → T4: the best (comb, th) for each metric column."""
    return W.best_per_metric(round_doubles(_e15(spark, sf)), ["f1_0", "f1_1", "f1_wavg"], ["comb", "th"])


@query("t5_sorted_scores", oracle=ev_sql(
    "select * from (" + _f1_sql("comb, th") + ") t order by f1_wavg desc", *_E15_CTES))
def t5_sorted(spark, sf):
    """E15 → T5: score table sorted by the weighted F1, descending."""
    return W.sorted_desc(round_doubles(_e15(spark, sf)), ["f1_wavg"])


@query("t7_score_slice", oracle=ev_sql(
    "select * from (" + _e16_sql()[0] + ") t where comb = 1 and th = 0.5", *_e16_sql()[1]))
def t7_slice(spark, sf):
    """E16 → T7: the (comb 1, every mass, th 0.5) slice."""
    return W.score_slice(round_doubles(_e16(spark, sf)), 1, 0.5)


@query("u3_common_top_over_masses", oracle=ev_sql(
    "select comb, th from (select *, row_number() over (partition by mass order by f1_wavg desc, comb, th) as rank "
    "from (" + _e16_sql()[0] + ") t where mass <> 'all') u where rank <= 8 group by comb, th "
    "having count(distinct mass) = 3", *_e16_sql()[1]))
def u3_common_top(spark, sf):
    """E16 → T3 → U3: (comb, th) pairs in the top 8 of every mass."""
    e = round_doubles(_e16(spark, sf)).where(F.col("mass") != "all")
    return W.common_top(e, 8, "mass", ["comb", "th"], ["f1_wavg"], ["comb", "th"])


def _j3_sql(extra_key: str = "") -> str:
    from .metrics_q import _cm_sql, _eval_sql
    src_keys = f"comb{', ' + extra_key if extra_key else ''}"
    body, rep = _eval_sql(src_keys)
    cols = ", ".join(f"max(case when comb = {c} then value end) as comb_{c}" for c in COMBS)
    k = f"{extra_key}, " if extra_key else ""
    src = "csm" if extra_key else "cs"
    ctes = _scores_ctes(bool(extra_key)) + [
        f"cm as ({_cm_sql(src, src_keys, 0.5)})", rep, f"ev_long as ({body})"]
    return ev_sql(f"select {k}weighted, class, metric, {cols} from ev_long where metric <> 'support' "
                  f"group by {k}weighted, class, metric", *ctes)


@query("j3_compare_models", oracle=_j3_sql())
def j3_compare(spark, sf):
    """E5 per comb → J3: models side by side per (weighted, class, metric), support dropped."""
    ev = round_doubles(M.evaluate(comb_scores(spark, sf), 0.5, ["comb"]))
    return W.compare_reports(ev, COMBS)


@query("j4_compare_models_per_mass", oracle=_j3_sql("mass"))
def j4_compare_mass(spark, sf):
    """E8 per comb → J4: the comparison with the mass in the key."""
    ev = round_doubles(M.evaluate(comb_scores(spark, sf, with_mass=True), 0.5, ["comb", "mass"]))
    return W.compare_reports(ev, COMBS, keys=("mass", "weighted", "class", "metric"))


@query("t6_preview", oracle=ev_sql(f"select * from ({_f1_sql('comb, th')}) e order by comb, th limit 5", *_E15_CTES))
def t6_preview(spark, sf):
    """The first five rows of the score table by combination and threshold (a preview)."""
    return W.preview(round_doubles(_e15(spark, sf)), 5, ["comb", "th"])


@query("s12_w3_stored_network_sweep", oracle=ev_sql(
    f"select comb as comb_id, e.* exclude (comb) from ({_f1_sql('comb, th')}) e", *_E15_CTES))
def s12_stored_sweep(spark, sf):
    """S12 + W3: scores of the stored networks, one folder per combination; the first
    call dies after writing half of the grid, the second one adds what is missing."""
    path = IO.new_store(spark, "networks")
    d = S.minmax_scale(labelled_sr(spark, sf).select("label", "weight", *FEATURES), FEATURES)
    grid = [{"comb_id": c} for c in COMBS]

    def run(g):
        net = D.rule_network(len(FEATURES), HIDDEN, g["comb_id"])
        return M.f1_per_threshold(D.dense_score(d, FEATURES, net), THRESHOLDS)

    W.run_sweep(spark, grid[:2], run, path)
    return round_doubles(W.run_sweep(spark, grid, run, path))
