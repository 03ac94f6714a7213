"""Feature ranking, model training/scoring, attribution and sweep queries
(R1–R9, M1–M6, M8–M11, E17, W1–W3, Z1, Z4).

Fits that SQL can follow step by step (Newton steps of one feature, boosted trees
over fixed bins, gradient steps on the focal loss) have SQL oracles, as have
R1/R5/Z1/Z4; the other trained models are checked by brute force and
invariants in ``tests/``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.util import round_doubles
from ..operators import batch as B
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import rank as R
from ..operators import scale as S
from ..operators import split as X
from ..operators import sweep as W
from ..operators import trees as TR
from ..operators.attribution import tree_attributions
from ..plans.small import with_scalars
from ..registry import ev_sql, query
from ..session import materialize
from ..sources import io as IO
from ..sources.tables import embedding_table
from .metrics_q import _f1_sql
from .split_q import _ranked_cte, _split_case
from .common import FEATURES, LABELLED_CTE, SR_CTE, THRESHOLDS, labelled, labelled_sr

SEED = 42
TAGS = [0, 1, 2]

#: the training rows of ``_train_test`` in SQL
TRAIN_CTES = (LABELLED_CTE, SR_CTE, _ranked_cte("sr"),
              f"t as (select * from (select *, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r) s "
              "where split = 'train')")


def prepared(spark, sf, scaled=True):
    """SR events (no data) → exact 0.6/0.2/0.2 split → standardised on train."""
    d = labelled_sr(spark, sf).select("event_key", "tag", "sample", "label", "weight", "score", *FEATURES)
    s = X.assign_split(d, 0.6, 0.2, 0.2, SEED)
    return S.standard_scale(s, FEATURES, F.col("split") == "train") if scaled else s


def _train_test(spark, sf, scaled=True):
    p = materialize(prepared(spark, sf, scaled))
    return p.where(F.col("split") == "train"), p.where(F.col("split") == "test"), p


# --- R1, R2, R5 --------------------------------------------------------------------

def _chi2_sql() -> str:
    mm = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in FEATURES)
    long = " union all ".join(
        f"select label, '{c}' as feature, ({c} - lo_{c}) / case when hi_{c} - lo_{c} = 0 then 1.0 else hi_{c} - lo_{c} end "
        f"as value from lab cross join mm" for c in FEATURES)
    return ("g as (select feature, label, sum(value) as obs, count(*) as n from lng group by feature, label), "
            "h as (select feature, label, obs, n * 1.0 / sum(n) over (partition by feature) as share, "
            "sum(obs) over (partition by feature) as total from g), "
            "c as (select feature, sum((obs - share * total) * (obs - share * total) / (share * total)) as chi2 "
            "from h group by feature)", f"mm as (select {mm} from lab)", f"lng as ({long})")


@query("r1_chi2_scores", oracle=ev_sql("select feature, round(chi2, 6) as chi2 from c",
                                       LABELLED_CTE, _chi2_sql()[1], _chi2_sql()[2], _chi2_sql()[0]))
def r1_chi2(spark, sf):
    """F2 → R1: χ² score of each min-max-scaled feature against the label."""
    d = S.minmax_scale(labelled(spark, sf).select("label", *FEATURES), FEATURES)
    return round_doubles(R.chi2_scores(d, FEATURES))


@query("r5_rank_by_chi2", oracle=ev_sql(
    "select feature, round(chi2, 6) as chi2, row_number() over (order by round(chi2, 6) desc, feature) as rank from c",
    LABELLED_CTE, _chi2_sql()[1], _chi2_sql()[2], _chi2_sql()[0]))
def r5_rank(spark, sf):
    """R1 → R5: features ranked by χ², descending."""
    d = S.minmax_scale(labelled(spark, sf).select("label", *FEATURES), FEATURES)
    return R.rank_by(round_doubles(R.chi2_scores(d, FEATURES)), "chi2")


@query("r2_chi2_pvalues")
def r2_pvalues(spark, sf):
    """R1 → R2: p-values (1 degree of freedom) of the χ² scores."""
    d = S.minmax_scale(labelled(spark, sf).select("label", *FEATURES), FEATURES)
    return R.chi2_pvalues(R.chi2_scores(d, FEATURES))


@query("r3_forest_importances")
def r3_forest(spark, sf):
    """Importances of a random forest fitted on the signed weights, and their deviation over trees."""
    train, _, _ = _train_test(spark, sf)
    return R.forest_importances(train, FEATURES, num_trees=30, max_depth=5, weight="weight")


@query("r4_extra_trees_importances")
def r4_extra(spark, sf):
    """Importances of 50 extremely randomised trees (drawn cuts), unweighted as in the reference."""
    train, _, _ = _train_test(spark, sf)
    return R.forest_importances(train, FEATURES, num_trees=50, max_depth=5, extra=True)


SETS = {"all": FEATURES, "no_price": [c for c in FEATURES if c != "f_price"], "qty_size": ["f_qty", "f_size"],
        "chi2": ["f_qty", "f_retail", "f_size"]}


@query("r6_feature_set_comparison")
def r6_sets(spark, sf):
    """One logistic model per named feature set, fitted in one batch; AUC and F1 on the test rows."""
    train, test, _ = _train_test(spark, sf)
    return R.compare_feature_sets(train, test, {k: SETS[k] for k in ("all", "no_price", "qty_size")})


BG_WEIGHTS = range(10, 21)          # background class weights, signal 10
CW_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query("r6_feature_sets_class_weights", headline=True)
def r6_sweep(spark, sf):
    """R6 in full: 4 feature sets × 11 class weights = 44 models in one batch, F1 at 8 thresholds each."""
    train, test, _ = _train_test(spark, sf)
    return R.feature_set_sweep(train, test, SETS, BG_WEIGHTS, CW_THRESHOLDS)


def _shapley(spark, sf):
    train, test, _ = _train_test(spark, sf)
    model = MD.fit_classifier(train, FEATURES, "logistic", negative_weights="signed")
    bg = X.hash_sample(train, 100, SEED)
    return R.sampled_shapley(model, test, bg, FEATURES, "event_key", permutations=8, seed=SEED)


@query("r7_sampled_shapley", headline=True)
def r7_shapley(spark, sf):
    """X12 → M1 → R7: sampled Shapley attributions of every test row."""
    return _shapley(spark, sf)


@query("r8_global_importance")
def r8_global(spark, sf):
    """R7 → R8: mean |attribution| per feature, ranked."""
    return R.global_importance(_shapley(spark, sf))


@query("r9_dependence_pairs")
def r9_dependence(spark, sf):
    """R7 → R9: (value, attribution) pairs of one feature."""
    return R.dependence(_shapley(spark, sf), "f_qty")


# --- M1–M6, M10, M11 --------------------------------------------------------------------

def _tag_specs(**kw):
    return [B.Spec(str(t), FEATURES, rows=f"tag = {t}", **kw) for t in TAGS]


@query("m1_weighted_classifier_per_tag")
def m1_per_tag(spark, sf):
    """M1 + M6 → E7: one weighted logistic model per tag, fitted in one batch (signed weights), each evaluated
    on its tag's test rows."""
    train, test, _ = _train_test(spark, sf)
    batch = B.fit_many(train, _tag_specs())
    scored = batch.score(test, {str(t): f"tag = {t}" for t in TAGS}).drop("model")
    return M.evaluate(scored, 0.4, ["tag"])


@query("m1_signed_fit_rows_used", oracle=ev_sql(
    "select tag, count(*) as n_rows, round(sum(abs(weight)), 6) as abs_weight, true as converged from t group by tag",
    *TRAIN_CTES))
def m1_rows_used(spark, sf):
    """M1: rows and Σ|w| that each tag's signed fit used (all of its training rows),
    and whether the gradient vanished at the fit."""
    train, _, _ = _train_test(spark, sf)
    facts = B.fit_many(train, _tag_specs()).facts(spark)
    return facts.select(F.col("model").cast("int").alias("tag"), "n_rows", F.round("abs_weight", 6).alias("abs_weight"),
                        (F.col("gradient") <= 1e-5).alias("converged"))


def _newton_sql(src: str, key: str, models: dict[str, tuple[str, str]], reg: float = 1e-6, steps: int = 9) -> list[str]:
    """CTEs of one-feature logistic fits by Newton steps, one per (name, group): the last one, ``fit``, has
    ``model, grp, b0, b1`` for the raw feature. ``models``: name -> (feature, weight expression)."""
    rows = " union all ".join(f"select '{n}' as model, {key} as grp, cast({x} as double) as x0, label as y, cast({w} as double) as w0 "
                              f"from {src}" for n, (x, w) in models.items())
    out = [f"nr as materialized ({rows})",
           "ns as materialized (select model, grp, avg(x0) as mu, stddev_pop(x0) as sd, sum(abs(w0)) as a from nr group by model, grp)",
           "nz as materialized (select model, grp, (x0 - mu) / sd as x, y, w0 / a as w from nr join ns using (model, grp))",
           "n0 as materialized (select model, grp, cast(0 as double) as b0, cast(0 as double) as b1 from ns)"]
    for i in range(steps):
        out.append(f"""n{i + 1} as materialized (
  select model, grp, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as b0,
         b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b1
  from (select model, grp, any_value(b0) as b0, any_value(b1) as b1, sum(w * (p - y)) as g0,
          sum(w * (p - y) * x) + {reg!r} * any_value(b1) as g1, sum(w * p * (1 - p)) as h00,
          sum(w * p * (1 - p) * x) as h01, sum(w * p * (1 - p) * x * x) + {reg!r} as h11
        from (select *, 1 / (1 + exp(-(b0 + b1 * x))) as p from nz join n{i} using (model, grp)) group by model, grp))""")
    out.append(f"fit as (select model, grp, b0 - b1 * mu / sd as b0, b1 / sd as b1 from n{steps} join ns using (model, grp))")
    return out


_CW_NAMES = {f"{b}": ("f_qty", f"weight * case when label = 1 then 10.0 else {float(b)} end") for b in BG_WEIGHTS}


@query("m10_class_weight_coefficients", oracle=ev_sql(
    "select cast(model as int) as bg_weight, grp as tag, round(b0, 6) as constant, round(b1, 6) as f_qty from fit",
    *TRAIN_CTES, *_newton_sql("t", "tag", _CW_NAMES)))
def m10_coefficients(spark, sf):
    """M1 + M10: the coefficients of 33 one-feature models (11 background class weights × 3 tags, signed
    weights) fitted in one batch."""
    train, _, _ = _train_test(spark, sf, scaled=False)
    specs = [B.Spec(f"{b}|{t}", ["f_qty"], rows=f"tag = {t}", class_weights=(float(b), 10.0), tol=1e-10)
             for b in BG_WEIGHTS for t in TAGS]
    c = B.fit_many(train, specs).coefficients(spark)
    part = F.split("model", "[|]")
    return c.groupBy(part[0].cast("int").alias("bg_weight"), part[1].cast("int").alias("tag")).agg(
        F.round(F.max(F.when(F.col("feature").isNull(), F.col("coefficient"))), 6).alias("constant"),
        F.round(F.max(F.when(F.col("feature") == "f_qty", F.col("coefficient"))), 6).alias("f_qty"))


ONE_FEATURE = {"qty": "f_qty", "retail": "f_retail", "size": "f_size"}


def _one_feature_sql() -> str:
    """F1 of one-feature fits (3 features × 11 class weights) at 8 thresholds on the test rows."""
    models = {f"{n}|{b}": (f, f"weight * case when label = 1 then 10.0 else {float(b)} end") for n, f in ONE_FEATURE.items() for b in BG_WEIGHTS}
    x = "case split_part(model, '|', 1) " + " ".join(f"when '{n}' then {f}" for n, f in ONE_FEATURE.items()) + " end"
    ths = ", ".join(repr(t) for t in CW_THRESHOLDS)
    return ev_sql(
        _f1_sql("feature_set, bg_weight, th"), *TRAIN_CTES, *_newton_sql("t", "0", models),
        f"te as (select label, weight, {', '.join(ONE_FEATURE.values())} from (select *, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r) "
        "where split = 'test')",
        f"sc as materialized (select model, label, weight, 1 / (1 + exp(-(b0 + b1 * {x}))) as score from te cross join fit)",
        "cm as (select split_part(model, '|', 1) as feature_set, cast(split_part(model, '|', 2) as double) as bg_weight, th, "
        "sum(case when label = 0 and not (score > th) then weight else 0.0 end) as w_tn, sum(case when label = 0 and score > th then weight else 0.0 end) as w_fp, "
        "sum(case when label = 1 and not (score > th) then weight else 0.0 end) as w_fn, sum(case when label = 1 and score > th then weight else 0.0 end) as w_tp "
        f"from sc cross join (select cast(unnest([{ths}]) as double) as th) group by all)")


@query("r6_one_feature_sets_class_weights", oracle=_one_feature_sql())
def r6_one_feature(spark, sf):
    """M10 → R6 → E17: 3 one-feature sets × 11 background class weights fitted in one batch (signed weights), F1 at 8
    thresholds on the test rows."""
    train, test, _ = _train_test(spark, sf, scaled=False)
    return round_doubles(R.feature_set_sweep(train, test, {n: [f] for n, f in ONE_FEATURE.items()}, BG_WEIGHTS, CW_THRESHOLDS))


@query("m2_weighted_coefficients", oracle=ev_sql(
    "select model as training, round(b0, 6) as constant, round(b1, 6) as f_qty from fit",
    *TRAIN_CTES, *_newton_sql("t", "0", {"weighted": ("f_qty", "weight"), "unweighted": ("f_qty", "1.0")})))
def m2_coefficients(spark, sf):
    """M2: a one-feature model with and without the weights, fitted in one batch; coefficients."""
    train, _, _ = _train_test(spark, sf, scaled=False)
    c = B.fit_many(train, [B.Spec("weighted", ["f_qty"], tol=1e-10), B.Spec("unweighted", ["f_qty"], weighted=False, tol=1e-10)]).coefficients(spark)
    return c.groupBy(F.col("model").alias("training")).agg(
        F.round(F.max(F.when(F.col("feature").isNull(), F.col("coefficient"))), 6).alias("constant"),
        F.round(F.max(F.when(F.col("feature") == "f_qty", F.col("coefficient"))), 6).alias("f_qty"))


@query("m6_scores_of_a_fit", oracle=ev_sql(
    "select event_key, round(1 / (1 + exp(-(b0 + b1 * f_qty))), 6) as model_score from sr, fit",
    *TRAIN_CTES, *_newton_sql("t", "0", {"m": ("f_qty", "weight")})))
def m6_scores(spark, sf):
    """M1 → M6: every event of the table scored by a fitted one-feature model."""
    train, _, p = _train_test(spark, sf, scaled=False)
    model = B.fit_many(train, [B.Spec("m", ["f_qty"], tol=1e-10)]).models["m"]
    return MD.score(model, p).select("event_key", F.round("score", 6).alias("model_score"))


@query("m2_weighted_vs_unweighted")
def m2_weighting(spark, sf):
    """M2: the same split trained with and without weights; AUC on test."""
    train, test, _ = _train_test(spark, sf)
    batch = B.fit_many(train, [B.Spec("weighted", FEATURES), B.Spec("unweighted", FEATURES, weighted=False)])
    s = materialize(batch.score(test.select("label", "weight", *FEATURES), model="training").select("training", "label", "weight", "score"))
    return M.roc_auc(s, ["training"]).select("auc", "training")


# --- M3, M4: boosted trees on signed weights

BOOST = dict(rate=0.3, depth=2)
N_BINS = 16


def _boost_ctes(rounds: int, depth: int = 2, rate: float = 0.3, reg: float = 1.0, least: float = 1e-3, bins: int = N_BINS) -> list[str]:
    """CTEs that grow boosted trees on the training rows: ``nodes`` (all nodes of all trees) and ``hist``
    (the losses before each round and after the last)."""
    k = len(FEATURES)
    lim = ", ".join(f"min({c}) as lo{i}, max({c}) as hi{i}" for i, c in enumerate(FEATURES))
    bin_ = [" + ".join(f"case when lo{i} + (hi{i} - lo{i}) * {j} / {float(bins)!r} < {c} then 1 else 0 end" for j in range(1, bins))
            for i, c in enumerate(FEATURES)]
    out = [LABELLED_CTE, SR_CTE, _ranked_cte("sr"),
           f"tv as materialized (select * from (select *, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r) where split <> 'test')",
           f"lim as materialized (select {lim} from tv where split = 'train')",
           "m0 as materialized (select row_number() over () as id, split = 'val' as val, cast(label as double) as y, weight as w, "
           + ", ".join(f"{x} as b{i}" for i, x in enumerate(bin_)) + ", cast(0 as double) as m from tv cross join lim)"]
    nodes, losses = [], []
    for t in range(rounds + 1):
        losses.append(f"select {t} as iteration, sum(l * w) filter (not val) / sum(abs(w)) filter (not val) as loss, "
                      f"sum(l * w) filter (val) / sum(abs(w)) filter (val) as val_loss from "
                      f"(select w, val, greatest(m, 0) + ln(1 + exp(-abs(m))) - y * m as l from m{t})")
        if t == rounds:
            break
        out.append(f"t{t}_0 as materialized (select *, cast(1 as bigint) as node, w * (p - y) as g, w * p * (1 - p) as h "
                   f"from (select *, 1 / (1 + exp(-m)) as p from m{t}))")
        for d in range(depth):
            cells = " union all ".join(f"select node, {i} as f, b{i} as b, sum(g) as g, sum(h) as h, sum(w) as w, count(*) as n from t{t}_{d} "
                                       f"where not val and node >= {1 << d} group by node, b{i}" for i in range(k))
            part = "partition by node, f"
            out += [f"c{t}_{d} as materialized (select *, " + ", ".join(
                        f"sum({x}) over ({part} order by b) as l{x}, sum({x}) over ({part}) as t{x}" for x in "ghwn")
                    + f", max(b) over ({part}) as hi from ({cells}))",
                    f"g{t}_{d} as (select *, 0.5 * (lg * lg / (lh + {reg!r}) + (tg - lg) * (tg - lg) / (th - lh + {reg!r}) - tg * tg / (th + {reg!r})) as gain "
                    f"from c{t}_{d} where b < hi and lh >= {least!r} and th - lh >= {least!r})",
                    f"s{t}_{d} as materialized (select * from (select *, row_number() over (partition by node order by round(gain, 9) desc, f, b) as k "
                    f"from g{t}_{d} where gain > 0) where k = 1)"]
            go = "case s.f " + " ".join(f"when {i} then b{i}" for i in range(k)) + " end"
            out.append(f"t{t}_{d + 1} as materialized (select x.* exclude (node), case when s.node is null then x.node "
                       f"else 2 * x.node + case when {go} > s.b then 1 else 0 end end as node from t{t}_{d} x left join s{t}_{d} s using (node))")
        leaf = [f"select cast(1 as bigint) as node, sum(g) as g, sum(h) as h, sum(w) as w, count(*) as n from t{t}_0 where not val"]
        for d in range(depth):
            leaf += [f"select 2 * node, lg, lh, lw, ln from s{t}_{d}", f"select 2 * node + 1, tg - lg, th - lh, tw - lw, tn - ln from s{t}_{d}"]
        splits = " union all ".join(f"select node, f, b, gain from s{t}_{d}" for d in range(depth))
        out += [f"v{t} as materialized (select {t} as tree, a.node, s.f, s.b, s.gain, "
                f"case when h > 0 and h + {reg!r} > 0 then -g / (h + {reg!r}) else 0.0 end as value, n, w "
                f"from ({' union all '.join(leaf)}) a left join ({splits}) s using (node))",
                f"m{t + 1} as materialized (select x.* exclude (m, node, g, h, p), x.m + {rate!r} * v.value as m from t{t}_{depth} x join v{t} v using (node))"]
        nodes.append(f"select * from v{t}")
    out += ["nodes as (" + " union all ".join(nodes) + ")", "hist as (" + " union all ".join(losses) + ")"]
    return out


def _edge_sql() -> str:
    return "case f " + " ".join(f"when {i} then lo{i} + (hi{i} - lo{i}) * (b + 1) / {float(N_BINS)!r}" for i in range(len(FEATURES))) + " end"


def _boosted(spark, sf, rounds):
    _, _, p = _train_test(spark, sf, scaled=False)
    tv = p.where(F.col("split") != "test")
    edges = TR.uniform_edges(tv.where(F.col("split") == "train"), FEATURES, N_BINS)
    return TR.fit_trees(tv, FEATURES, [TR.Member(rounds=rounds, **BOOST)], validation=F.col("split") == "val", edges=edges)


@query("m3_signed_boost_trees", oracle=ev_sql(
    "select tree, node, case f " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(FEATURES)) + f" end as feature, round({_edge_sql()}, 6) as cut, "
    "round(gain, 6) as gain, round(value, 6) as value, cast(n as bigint) as n_rows, round(w, 6) as sum_w from nodes cross join lim",
    *_boost_ctes(3)))
def m3_trees(spark, sf):
    """M3: every node of three boosted trees of depth 2 on signed weights: split, gain, leaf value, rows and Σw."""
    n = _boosted(spark, sf, 3).nodes(spark)
    return n.select("tree", "node", "feature", *[F.round(c, 6).alias(c) for c in ("cut", "gain", "value")], "n_rows", F.round("sum_w", 6).alias("sum_w"))


@query("m4_boost_history", oracle=ev_sql(
    "select cast(iteration as int) as iteration, round(loss, 6) as loss, round(val_loss, 6) as val_loss from hist", *_boost_ctes(3)))
def m4_history(spark, sf):
    """M4 + M11: training and validation loss before each boosting round and after the last (signed weights)."""
    return round_doubles(_boosted(spark, sf, 3).history_table(spark).drop("member"))


def _attribution_sql(body: str, rounds: int = 3, rate: float = 0.3) -> str:
    """``body`` over ``phi``, the Shapley values of the boosted trees by enumeration of all coalitions, for the test rows."""
    k = len(FEATURES)
    w = [math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)]
    bin_ = [" + ".join(f"case when lo{i} + (hi{i} - lo{i}) * {j} / {float(N_BINS)!r} < {c} then 1 else 0 end" for j in range(1, N_BINS))
            for i, c in enumerate(FEATURES)]
    at = "case {f} " + " ".join(f"when {i} then b{i}" for i in range(k)) + " end"

    def value(v, lv, rv):
        known = f"case when {at.format(f=f'f{v}')} <= c{v} then {lv} else {rv} end"
        return (f"case when f{v} is null then v{v} when (mask >> f{v}) & 1 = 1 then {known} "
                f"else (n{2 * v} * {lv} + n{2 * v + 1} * {rv}) / n{v} end")

    tree = ", ".join(f"max({x}) filter (node = {v}) as {y}{v}" for v in range(1, 8) for x, y in (("f", "f"), ("b", "c"), ("value", "v"), ("n", "n")))
    coef = " ".join(f"when {m} then [" + ", ".join(repr(w[bin(m).count('1') - 1] if m >> f & 1 else -w[bin(m).count('1')]) for f in range(k)) + "]"
                    for m in range(1 << k))
    return ev_sql(
        body,
        *_boost_ctes(rounds),
        f"tt as materialized (select tree, {tree} from nodes group by tree)",
        "test as materialized (select event_key, f_retail, " + ", ".join(f"{x} as b{i}" for i, x in enumerate(bin_))
        + f" from (select *, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r) cross join lim where split = 'test')",
        f"two as (select *, {value(2, 'v4', 'v5')} as e2, {value(3, 'v6', 'v7')} as e3 from test cross join tt cross join (select unnest(range({1 << k})) as mask))",
        f"val as materialized (select event_key, mask, e, case mask {coef} end as coef from (select event_key, mask, sum({value(1, 'e2', 'e3')}) as e "
        "from two group by event_key, mask))",
        "phi as (select event_key, case f " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(FEATURES)) + " end as feature, "
        f"sum({rate!r} * e * coef[f + 1]) as attribution from val cross join (select unnest(range({k})) as f) group by event_key, f)")


@query("r7_tree_attributions", headline=True, oracle=_attribution_sql("select event_key, feature, round(attribution, 6) as attribution from phi"))
def r7_trees(spark, sf):
    """M3 → R7: exact Shapley values of three boosted trees (margin) for every test row."""
    _, _, p = _train_test(spark, sf, scaled=False)
    model = _boosted(spark, sf, 3)
    a = tree_attributions(model, p.where(F.col("split") == "test"), "event_key")
    return a.select("event_key", "feature", F.round("attribution", 6).alias("attribution"))


@query("r8_tree_importance", oracle=_attribution_sql(
    "select feature, round(avg(abs(attribution)), 6) as mean_abs, row_number() over (order by round(avg(abs(attribution)), 6) desc, feature) as rank "
    "from phi group by feature"))
def r8_trees(spark, sf):
    """M3 → R7 → R8: mean |exact attribution| of every feature over the test rows, ranked."""
    _, _, p = _train_test(spark, sf, scaled=False)
    a = tree_attributions(_boosted(spark, sf, 3), p.where(F.col("split") == "test"), "event_key")
    return R.rank_by(round_doubles(R.global_importance(a).drop("rank")), "mean_abs")


@query("r9_tree_dependence", oracle=_attribution_sql(
    "select f_retail as value, round(attribution, 6) as attribution from phi join test using (event_key) where feature = 'f_retail'"))
def r9_trees(spark, sf):
    """M3 → R7 → R9: (value, exact attribution) pairs of one feature over the test rows."""
    _, _, p = _train_test(spark, sf, scaled=False)
    a = tree_attributions(_boosted(spark, sf, 3), p.where(F.col("split") == "test"), "event_key")
    return R.dependence(a, "f_retail").select("value", F.round("attribution", 6).alias("attribution"))


@query("m3_gbt_grid_best_auc")
def m3_gbt_grid(spark, sf):
    """J6 → M3: boosted trees over a grid (boost loss × depth × rate), all on signed weights and grown in the same
    passes; test AUC per combination, best kept."""
    train, test, _ = _train_test(spark, sf)
    grid = W.grid_list({"loss": ["logistic", "exponential"], "depth": [2, 3], "rate": [0.1, 0.3]})
    model = TR.fit_trees(train, FEATURES, [TR.Member(rounds=10, seed=SEED, **g) for g in grid], n_bins=32)
    scored = model.score_columns(test).select("label", "weight", F.posexplode("scores").alias("comb_id", "score"))
    auc = M.roc_auc(scored, ["comb_id"])
    combs = W.param_grid(spark, {"loss": ["logistic", "exponential"], "depth": [2, 3], "rate": [0.1, 0.3]})
    # ties on the AUC go to the smallest combination id
    best = auc.join(F.broadcast(combs), "comb_id").agg(  # the grid's rows
        F.max_by(F.struct("comb_id", "loss", F.col("depth").alias("maxDepth"), F.col("rate").alias("stepSize")),
                 F.struct(F.col("auc"), -F.col("comb_id"))).alias("b"), F.max("auc").alias("auc"))
    return best.select("b.*", "auc")


@query("m4_gbt_early_stopping")
def m4_early(spark, sf):
    """M4: boosted trees on signed weights that stop on the validation rows; test evaluation."""
    _, test, p = _train_test(spark, sf)
    tv = p.where(F.col("split") != "test")
    m = MD.fit_gbt_early_stopping(tv, FEATURES, F.col("split") == "val", rounds=30, patience=3, rate=0.3, average_start=True)
    return M.evaluate(MD.score(m, test), 0.5)


@query("m5_forest_regression")
def m5_forest_reg(spark, sf):
    """M5: forest regression (depth 3, 100 trees) of the 0/1 label; RMSE on test."""
    train, test, _ = _train_test(spark, sf)
    m = MD.fit_forest_regressor(train, FEATURES, max_depth=3, num_trees=100)
    return m.transform(test).agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)).alias("rmse"),
                                 F.count(F.lit(1)).alias("n"))


@query("m6_batch_score")
def m6_score(spark, sf):
    """M1 → M6: every event of the table scored by the trained model (map-only)."""
    train, _, p = _train_test(spark, sf)
    m = MD.fit_classifier(train, FEATURES, "logistic", negative_weights="signed")
    return MD.score(m, p).select("event_key", "split", "label", F.col("score").alias("model_score"))


@query("s13_model_reload", oracle=ev_sql(
    "select count(*) as n_rows, cast(0 as bigint) as n_differ from sr", LABELLED_CTE, SR_CTE))
def s13_reload(spark, sf):
    """A fitted pipeline written and read back gives the same score for every row."""
    train, _, p = _train_test(spark, sf)
    m = MD.fit_classifier(train, FEATURES, "logistic", negative_weights="abs")
    path = IO.new_store(spark, "model")
    IO.save_model(m, MD.training_history(m), path)
    back, _ = IO.load_model(spark, path, PipelineModel)
    d = MD.score(back, MD.score(m, p, "first"), "second")
    return d.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("first").eqNullSafe(F.col("second"))).alias("n_differ"))


@query("s13_signed_trees_reload", oracle=ev_sql(
    "select count(*) as n_rows, cast(0 as bigint) as n_differ, cast(4 as bigint) as n_history from sr", LABELLED_CTE, SR_CTE))
def s13_trees(spark, sf):
    """Boosted trees on signed weights, written as tables and read back, score every row alike and keep their history."""
    _, _, p = _train_test(spark, sf, scaled=False)
    model = _boosted(spark, sf, 3)
    path = IO.new_store(spark, "trees")
    model.save(spark, path)
    back = TR.load_trees(spark, path)
    d = MD.score(back, MD.score(model, p, "first"), "second")
    return d.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("first").eqNullSafe(F.col("second"))).alias("n_differ")).withColumn(
        "n_history", F.lit(len(back.history[0])).cast("long"))


@query("m10_e17_class_weight_sweep")
def m10_class_weights(spark, sf):
    """M10 → E17: F1 per (background class weight, threshold): 11 models in one batch, 8 thresholds."""
    train, test, _ = _train_test(spark, sf)
    batch = B.fit_many(train, [B.Spec(str(b), FEATURES, class_weights=(float(b), 10.0)) for b in BG_WEIGHTS])
    f1 = M.f1_per_threshold(batch.score(test.select("label", "weight", *FEATURES)), CW_THRESHOLDS, ["model"])
    return f1.select("th", "f1_0", "f1_1", "f1_wavg", F.col("model").cast("double").alias("bg_weight"))


@query("m11_training_history")
def m11_history(spark, sf):
    """Training and validation loss per iteration of the weighted logistic fit."""
    _, _, p = _train_test(spark, sf)
    batch = B.fit_many(p, [B.Spec("logistic", FEATURES, rows="split = 'train'", validation="split = 'val'", max_iter=50)])
    return batch.history_table(spark).drop("model")


@query("m8_pca_reconstruction_anomaly")
def m8_pca(spark, sf):
    """M8 + L10 + L11 → E1: PCA(2) fitted on class 0 of the embeddings, error
    threshold at the class-0 mean error, evaluated."""
    e = embedding_table(spark, sf, positive_label=0)
    s = X.assign_split(e, 0.6, 0.2, 0.2, SEED, key_cols=["vec_id"])
    mean, pca = MD.fit_reconstruction(s.where((F.col("split") == "train") & (F.col("label") == 0)), "x", 2)
    d = MD.reconstruction_error(s, mean, pca, "x")
    th = d.where((F.col("split") == "train") & (F.col("label") == 0)).agg(F.avg("error").alias("_th"))
    d = with_scalars(d, th).withColumn("prediction", L.anomaly_class("error", F.col("_th"), 1))
    return M.confusion(d.where(F.col("split") == "test"), [], "label", "prediction", None)


@query("m9_focal_loss_training")
def m9_focal(spark, sf):
    """M9: linear model trained on the focal loss by distributed gradient steps; test AUC."""
    train, test, _ = _train_test(spark, sf)
    coefs, hist = MD.fit_focal_logistic(train, FEATURES, iterations=15)
    auc = M.roc_auc(MD.linear_score(test, FEATURES, coefs), weight=None)
    last = hist.agg(F.max_by("loss", "iteration").alias("final_loss"))
    return with_scalars(auc, last)


def _focal_sql(steps: int = 3, lr: float = 0.5, eps: float = 1e-7) -> list[str]:
    """CTEs of gradient steps on the focal loss (α 0.25, γ 2) of two features; ``h{i}`` holds the losses before step i."""
    out = [_ranked_cte("sr"), f"fr as materialized (select f_qty / 50.0 as x1, f_tax * 10.0 as x2, cast(label as double) as y, weight as w, "
           f"{_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r)",
           "b0 as (select cast(0 as double) as c0, cast(0 as double) as c1, cast(0 as double) as c2)"]
    for i in range(steps):
        out += [f"p{i} as materialized (select x1, x2, y, w, split, least(greatest(1 / (1 + exp(-(c0 + c1 * x1 + c2 * x2))), {eps!r}), 1.0 - {eps!r}) as p "
                f"from fr cross join b{i} where split <> 'test')",
                f"q{i} as materialized (select *, w * (-0.25 * y * (pow(1 - p, 2) * (1 - p) - 2 * pow(1 - p, 2) * p * ln(p)) "
                f"- 0.25 * (1 - y) * (2 * p * p * (1 - p) * ln(1 - p) - p * p * p)) as g, "
                f"w * -0.25 * (y * pow(1 - p, 2) * ln(p) + (1 - y) * p * p * ln(1 - p)) as l from p{i})",
                f"h{i} as (select cast({i} as int) as iteration, sum(l) filter (split = 'train') / sum(w) filter (split = 'train') as loss, "
                f"sum(l) filter (split = 'val') / sum(w) filter (split = 'val') as val_loss from q{i})",
                f"b{i + 1} as materialized (select c0 - {lr!r} * g0 / n as c0, c1 - {lr!r} * g1 / n as c1, c2 - {lr!r} * g2 / n as c2 from b{i} cross join "
                f"(select sum(g) as g0, sum(g * x1) as g1, sum(g * x2) as g2, sum(w) as n from q{i} where split = 'train'))"]
    return out


@query("m9_focal_history", oracle=ev_sql(
    "select h.iteration, round(h.loss, 9) as loss, round(h.val_loss, 9) as val_loss, round(c0, 6) as c0, round(c1, 6) as c1, round(c2, 6) as c2 "
    "from (" + " union all ".join(f"select * from h{i}" for i in range(3)) + ") h cross join b3", LABELLED_CTE, SR_CTE, *_focal_sql()))
def m9_history(spark, sf):
    """M9 + M11: training and validation focal loss of three gradient steps, and the coefficients after them."""
    _, _, p = _train_test(spark, sf, scaled=False)
    d = p.where("split <> 'test'").withColumns({"x1": F.col("f_qty") / 50.0, "x2": F.col("f_tax") * 10.0})
    coefs, hist = MD.fit_focal_logistic(d, ["x1", "x2"], weight="weight", iterations=3, validation=F.col("split") == "val")
    return hist.select("iteration", F.round("loss", 9).alias("loss"), F.round("val_loss", 9).alias("val_loss"),
                       *[F.round(F.lit(c), 6).alias(f"c{i}") for i, c in enumerate(coefs)])


# --- W1–W3 --------------------------------------------------------------------------

SPLITS = [(0.6, 0.2, 0.2), (0.5, 0.3, 0.2), (0.5, 0.2, 0.3), (0.4, 0.3, 0.3), (0.4, 0.2, 0.4), (0.3, 0.3, 0.4)]


def _ranked_rows(spark, sf):
    d = labelled_sr(spark, sf).select("event_key", "tag", "label", "weight", *FEATURES)
    return X.with_rank(d, SEED)


@query("w1_split_axis_sizes", oracle=ev_sql(
    "select * from (" + " union all ".join(
        f"select {i} as split_id, part, count(*) as n, round(sum(weight), 6) as w from "
        f"(select weight, {_split_case('rk', 'n', *sp)} as part from r) group by part" for i, sp in enumerate(SPLITS)) + ")",
    LABELLED_CTE, SR_CTE, _ranked_cte("sr")))
def w1_sizes(spark, sf):
    """Rows and weight of every part of six split shares, all read off one stored rank."""
    r = _ranked_rows(spark, sf)
    each = [F.struct(F.lit(i).alias("split_id"), F.when(F.expr(X.part_condition(*sp, "test")), "test").when(
        F.expr(X.part_condition(*sp, "val")), "val").otherwise("train").alias("part")) for i, sp in enumerate(SPLITS)]
    d = r.select("weight", F.explode(F.array(*each)).alias("p")).select("weight", "p.*")
    return d.groupBy("split_id", "part").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("w"))


@query("w1_split_axis_coefficients", oracle=ev_sql(
    "select grp as split_id, round(b0, 6) as constant, round(b1, 6) as f_qty from fit", LABELLED_CTE, SR_CTE, _ranked_cte("sr"),
    "ws as materialized (" + " union all ".join(
        f"select {i} as split_id, label, weight, f_qty from (select *, {_split_case('rk', 'n', *sp)} as part from r) where part = 'train'"
        for i, sp in enumerate(SPLITS)) + ")", *_newton_sql("ws", "split_id", {"m": ("f_qty", "weight")})))
def w1_coefficients(spark, sf):
    """One-feature fits on the training rows of six split shares, in one batch on one stored rank."""
    specs = [B.Spec(str(i), ["f_qty"], rows=X.part_condition(*sp, "train"), tol=1e-10) for i, sp in enumerate(SPLITS)]
    c = B.fit_many(_ranked_rows(spark, sf), specs).coefficients(spark)
    return c.groupBy(F.col("model").cast("int").alias("split_id")).agg(
        F.round(F.max(F.when(F.col("feature").isNull(), F.col("coefficient"))), 6).alias("constant"),
        F.round(F.max(F.when(F.col("feature") == "f_qty", F.col("coefficient"))), 6).alias("f_qty"))


@query("w1_grid_sweep_f1")
def w1_grid(spark, sf):
    """J6 → W1 → E15: the grid split shares × penalty × class weight × features, 192 models on signed weights fitted
    in one batch on one stored rank; F1 per (combination, threshold) on each split's own test rows."""
    r = _ranked_rows(spark, sf)
    grid = W.grid_list({"split_id": list(range(len(SPLITS))), "reg": [1e-6, 1e-3, 1e-2, 1e-1], "bg_weight": [5.0, 10.0, 15.0, 20.0],
                        "features": ["all", "qty_size"]})
    specs = [B.Spec(str(i), SETS[g["features"]], rows=X.part_condition(*SPLITS[g["split_id"]], "train"), reg=g["reg"],
                    class_weights=(g["bg_weight"], 10.0)) for i, g in enumerate(grid)]
    batch = B.fit_many(r, specs)
    asked = {str(i): X.part_condition(*SPLITS[g["split_id"]], "test") for i, g in enumerate(grid)}
    scored = batch.score(r.select("label", "weight", "rank", "rank_total", *FEATURES), asked, "comb_id").select(
        F.col("comb_id").cast("int").alias("comb_id"), "label", "weight", "score")
    return M.f1_per_threshold(scored, THRESHOLDS, ["comb_id"])


@query("w2_random_search")
def w2_random(spark, sf):
    """50 hash-sampled trials of a larger grid, two runs each from different starts, all on all training rows
    and fitted in one batch; the trial of lowest mean validation loss is kept."""
    _, _, p = _train_test(spark, sf)
    grid = W.param_grid(spark, {"reg": [0.0, 1e-4, 1e-3, 1e-2, 0.03, 0.1, 0.3, 1.0], "max_iter": [1, 2, 3, 5],
                                "bg_weight": [5.0, 10.0, 20.0]})
    trials = X.hash_sample(grid, 50, SEED, ["comb_id"]).collect()  # 50 parameter rows
    specs = [B.Spec(f"{t['comb_id']}|{run}", FEATURES, rows="split = 'train'", validation="split = 'val'", reg=t["reg"],
                    max_iter=t["max_iter"], class_weights=(t["bg_weight"], 10.0), start=run) for t in trials for run in (0, 1)]
    h = B.fit_many(p, specs).history_table(spark)
    last = h.groupBy("model").agg(F.max_by("val_loss", "iteration").alias("loss"))
    mean = last.groupBy(F.split("model", "[|]")[0].cast("int").alias("comb_id")).agg(F.avg("loss").alias("loss"))
    return mean.agg(F.min_by("comb_id", F.struct("loss", "comb_id")).alias("best_comb"), F.min("loss").alias("loss"))


@query("w3_resumable_sweep")
def w3_resume(spark, sf):
    """W3 + S12: sweep stored per combination; a second call skips stored combinations."""
    train, test, _ = _train_test(spark, sf)
    path = IO.new_store(spark, "sweep")
    grid = [dict(comb_id=i, regParam=r) for i, r in enumerate([0.0, 0.05])]

    def run(g):
        m = MD.fit_classifier(train, FEATURES, "logistic", negative_weights="signed", regParam=g["regParam"])
        return M.f1_per_threshold(MD.score(m, test), THRESHOLDS)
    W.run_sweep(spark, grid[:1], run, path)            # first call: comb 0 only
    return W.run_sweep(spark, grid, run, path)          # resume: comb 1 added


# --- Z1, Z4 -------------------------------------------------------------------------

def _partial_profile(pdf: pd.DataFrame) -> pd.DataFrame:
    w, y = pdf["weight"], pdf["label"]
    return pd.DataFrame({"region": [pdf["region"].iloc[0]], "tag": [int(pdf["tag"].iloc[0])], "sw": [float(w.sum())],
                         "swy": [float((y * w).sum())], "sy": [int(y.sum())], "n": [len(pdf)]})


def _merged_profile(pdf: pd.DataFrame) -> pd.DataFrame:
    sw, n = pdf["sw"].sum(), int(pdf["n"].sum())
    wd = pdf["swy"].sum() / sw if sw != 0 else pdf["sy"].sum() / n
    return pd.DataFrame({"region": [pdf["region"].iloc[0]], "tag": [int(pdf["tag"].iloc[0])],
                         "signal_w_density": [round(float(wd), 6)], "total_count": [n]})


@query("z1_group_function", oracle=ev_sql(
    "select region, tag, round(case when sum(weight) != 0 then sum(label * weight) / sum(weight) else avg(label) end, 6) "
    "as signal_w_density, count(*) as total_count from lab group by region, tag", LABELLED_CTE))
def z1_group_fn(spark, sf):
    """User pandas functions per (region, tag): partial rows per batch, then a merge."""
    d = labelled(spark, sf).select("region", "tag", "label", "weight")
    return MD.merge_per_group(d, ["region", "tag"], _partial_profile, _merged_profile,
                              "region string, tag int, sw double, swy double, sy long, n long",
                              "region string, tag int, signal_w_density double, total_count long")


def _clip(x: str) -> str:
    return f"least(greatest({x}, 1e-7), 1.0 - 1e-7)"


@query("z4_custom_loss", oracle=ev_sql(
    f"select tag, round(avg(-0.5 * (label * ln({_clip('score')} + 1e-7) * pow(1.0 - {_clip('score')}, 1.0) + "
    f"(1 - label) * ln(1.0 - {_clip('score')} + 1e-7) * pow({_clip('score')}, 1.0))), 6) as loss from sr group by tag",
    LABELLED_CTE, SR_CTE))
def z4_loss(spark, sf):
    """A user loss callable (focal, α 0.5, γ 1) averaged per tag."""
    return round_doubles(MD.mean_loss(labelled_sr(spark, sf), lambda y, p: L.focal_loss(y, p, 0.5, 1.0),
                                      keys=["tag"]))


_L17_W = [2.0, -0.5, 1.0, 0.5, -1.0]  # a stored linear model over the min-max-scaled features
_L17_B = -0.75


def _l17_sql() -> str:
    mm = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in FEATURES)
    sc = ", ".join(f"({c} - lo_{c}) / case when hi_{c} - lo_{c} = 0 then 1.0 else hi_{c} - lo_{c} end as {c}"
                   for c in FEATURES)
    means = ", ".join(f"avg({c}) as m_{c}" for c in FEATURES)
    base = f"cast({_L17_B!r} as double)" + "".join(
        f" + cast({w!r} as double) * m_{c}" for c, w in zip(FEATURES, _L17_W))
    cs = [f"cast({w!r} as double) * ({c} - m_{c})" for c, w in zip(FEATURES, _L17_W)]
    total = "(" + base + "".join(f" + {x}" for x in cs) + ")"
    return ev_sql(f"select event_key, round({base}, 6) as base_value, "
                  f"list_value({', '.join(f'round({x}, 6)' for x in cs)}) as contributions, "
                  f"cast({total} > 0 as int) as decision from s cross join (select {means} from s) mm",
                  LABELLED_CTE, SR_CTE, f"s as (select event_key, {sc} from sr cross join (select {mm} from sr) q)")


@query("l17_additive_decision", oracle=_l17_sql())
def l17_additive(spark, sf):
    """F2 → exact linear attributions → L17: base value + Σ attributions > 0."""
    d = S.minmax_scale(labelled_sr(spark, sf).select("event_key", *FEATURES), FEATURES)
    c = R.linear_contributions(d, FEATURES, _L17_W, _L17_B)
    c = c.withColumn("decision", L.additive_decision("base_value", "contributions"))
    return round_doubles(c.select("event_key", "base_value", "contributions", "decision"))
