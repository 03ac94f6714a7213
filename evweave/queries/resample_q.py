"""Oversampling queries (X9–X11, E18): totals and every synthetic row have SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.util import round_doubles
from ..operators import batch as B
from ..operators import metrics as M
from ..operators import resample as RS
from ..registry import ev_sql, query
from ..session import materialize
from .common import FEATURES
from .model_q import TRAIN_CTES, _train_test
from .split_q import _scaled_sql


def _summary(df):
    return df.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("w"))


@query("x9_x11_smote", headline=True, oracle=ev_sql(
    "select label, false as synthetic, count(*) as n, round(sum(weight), 6) as w from t group by label union all "
    "select 1, true, n_syn, round(n_syn * mean_w, 6) from (select cast(floor(0.5 * sum(1 - label) - sum(label)) as bigint) "
    "as n_syn, avg(weight) as mean_w from t) c where n_syn > 0", *TRAIN_CTES))
def x9_smote(spark, sf):
    """X9 + X11: SMOTE on the scaled training rows up to signal/background = 0.5;
    synthetic rows weighted by the mean training weight. Counts per class."""
    train, _, _ = _train_test(spark, sf)
    return _summary(RS.Oversampler(train, FEATURES, k=5, minority=1).smote(0.5))


def _synthetic_sql(method: str, ratio: float, k: int = 5, body: str | None = None) -> str:
    """The synthetic rows of SMOTE or ADASYN (or ``body`` over ``drawn``): neighbours by all pairs, draws by md5."""
    feats = ", ".join(FEATURES)
    scaled, _, _ = _scaled_sql("t", FEATURES, "true")
    unrounded = ", ".join(f"({c} - mu_{c}) / case when sd_{c} = 0 then 1.0 else sd_{c} end as {c}" for c in FEATURES)
    dist = "sqrt(" + " + ".join(f"(a.c[{i}] - b.c[{i}]) * (a.c[{i}] - b.c[{i}])" for i in range(1, len(FEATURES) + 1)) + ")"
    ctes = [*TRAIN_CTES, scaled, f"z as materialized (select event_key, label, [{feats}] as c from (select event_key, label, {unrounded} from t cross join st))",
            "mi as materialized (select * from z where label = 1)",
            "num as (select cast(greatest(0, floor({0} * sum(1 - label) - sum(label))) as bigint) as n_syn, sum(label) as n_min from z)".format(ratio),
            "pts as materialized (select c, count(*) as mult from mi group by c)",
            f"""pair as materialized (select a.c, b.c as nc, {dist} as d, case when a.c = b.c then b.mult - 1 else b.mult end as m from pts a, pts b
  where a.c <> b.c or b.mult > 1)""",
            f"""near as materialized (select c, list(nc order by d, nc, copy) as nbrs from (
  select c, nc, d, copy, row_number() over (partition by c order by d, nc, copy) as k
  from (select c, nc, d, unnest(range(1, least(m, {k}) + 1)) as copy from pair)) where k <= {k} group by c)"""]
    if method == "smote":
        ctes.append("grown as (select event_key, c, cast(n_syn // n_min + case when rk <= n_syn % n_min then 1 else 0 end as bigint) as g from "
                    "(select *, row_number() over (order by md5(concat_ws(':', '42', event_key))) as rk from mi) cross join num)")
    else:
        ctes += ["every as materialized (select c, count(*) as mult, sum(1 - label) as n_maj from z group by c)",
                 f"""far as (select a.c, {dist} as d, b.c as nc, case when a.c = b.c then b.mult - 1 else b.mult end as m, b.n_maj from pts a, every b
  where a.c <> b.c or b.mult > 1)""",
                 f"""took as (select c, n_maj, m, least(m, {k} - upto + m) as take from (
  select *, sum(m) over (partition by c order by d, nc rows unbounded preceding) as upto from far) where upto - m < {k})""",
                 f"share as materialized (select c, sum(take * (cast(n_maj as double) / m)) / {float(k)!r} as r from took group by c)",
                 "rs as (select event_key, c, coalesce(r, 0.0) as r from mi left join share using (c))",
                 "grown as (select event_key, rs.c, cast(round_even(r / rt * n_syn, 0) as bigint) as g from rs cross join num cross join (select sum(r) as rt from rs))"]
    draw = "cast('0x' || substr(md5(concat_ws(':', '{0}', event_key, cast(i as varchar))), 1, 8) as bigint)"
    ctes += ["made as (select event_key, c, coalesce(nbrs, [c]) as nbrs, unnest(range(g)) as i from grown left join near using (c) where g > 0)",
             f"drawn as (select event_key, i, c, nbrs[{draw.format(42)} % len(nbrs) + 1] as p, {draw.format(43)} / 4294967296.0 as u from made)"]
    return ev_sql(body or "select event_key || '#' || i as event_key, " + ", ".join(
        f"round(c[{j}] + u * (p[{j}] - c[{j}]), 6) as {f}" for j, f in enumerate(FEATURES, 1)) + " from drawn", *ctes)


@query("x10_adasyn", oracle=_synthetic_sql("adasyn", 0.5, body=(
    "select label, false as synthetic, count(*) as n, round(sum(weight), 6) as w from t group by label union all "
    "select 1, true, count(*), round(count(*) * (select avg(weight) from t), 6) from drawn having count(*) > 0")))
def x10_adasyn(spark, sf):
    """ADASYN on the same rows (more synthetic rows near the background)."""
    train, _, _ = _train_test(spark, sf)
    return _summary(RS.Oversampler(train, FEATURES, k=5, minority=1).adasyn(0.5))


def _synthetic_rows(spark, sf, method):
    train, _, _ = _train_test(spark, sf)
    ov = RS.Oversampler(train, FEATURES, k=5, minority=1)
    return round_doubles(getattr(ov, method)(0.5).where("synthetic").select("event_key", *FEATURES))


@query("x9_smote_rows", oracle=_synthetic_sql("smote", 0.5))
def x9_rows(spark, sf):
    """Every synthetic row that SMOTE adds to the scaled training rows."""
    return _synthetic_rows(spark, sf, "smote")


@query("x10_adasyn_rows", oracle=_synthetic_sql("adasyn", 0.5))
def x10_rows(spark, sf):
    """Every synthetic row that ADASYN adds."""
    return _synthetic_rows(spark, sf, "adasyn")


RATIOS = [0.1, 0.2, 0.3, 0.4, 0.5]
E18_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query("e18_f1_per_oversampler")
def e18_oversampling(spark, sf):
    """X9/X10 → M1 → E18: weighted F1 per (method, ratio, threshold) on the test rows: 2 methods × 5 ratios × 9
    thresholds. A method's synthetic rows of all ratios are made once and stored beside the training rows;
    the ten models are row conditions on that table, fitted in one batch."""
    train, test, _ = _train_test(spark, sf)
    ov = RS.Oversampler(train, FEATURES, k=5, minority=1)   # neighbours found once
    cols = ["label", "weight", *FEATURES]
    rows = train.select(*cols, F.lit("").alias("method"), F.lit(0).alias("level"))
    for method in ("smote", "adasyn"):
        rows = rows.unionByName(ov.synthetic_levels(method, RATIOS).select(*cols, F.lit(method).alias("method"), "level"))
    specs = [B.Spec(f"{m}|{r}", FEATURES, rows=f"method = '' or (method = '{m}' and level <= {i})")
             for m in ("smote", "adasyn") for i, r in enumerate(RATIOS)]
    batch = B.fit_many(materialize(rows), specs)
    f1 = M.f1_per_threshold(batch.score(test.select(*cols)), E18_THRESHOLDS, ["model"])
    part = F.split("model", "[|]")
    return f1.select(part[0].alias("method"), part[1].cast("double").alias("ratio"), "th", "f1_0", "f1_1", "f1_wavg")
