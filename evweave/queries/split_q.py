"""Split, sampling, scaling and product queries (X*, F*, J1, A11, P15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.util import round_doubles
from ..operators import profile as P
from ..operators import scale as S
from ..operators import split as X
from ..operators.select import mass_parameterised, test_slice
from ..registry import ev_sql, query
from .common import FEATURES, LABELLED_CTE, MASSES, labelled

SEED = 42


def _split_case(rk: str, n: str, train: float, val: float, test: float, compat: bool = True) -> str:
    vf = X.val_fraction(train, val, test, compat)
    nt = f"ceil(cast({test!r} as double) * {n})"
    nv = f"ceil(cast({vf!r} as double) * ({n} - {nt}))"
    return f"case when {rk} <= {nt} then 'test' when {rk} <= {nt} + {nv} then 'val' else 'train' end"


def _ranked_cte(src: str, part: str = "", key: str = "event_key") -> str:
    p = f"partition by {part}" if part else ""
    return (f"r as (select *, row_number() over ({p} order by md5(concat_ws(':', '{SEED}', {key}))) as rk, "
            f"count(*) over ({p}) as n from {src})")


# --- splits ---------------------------------------------------------------

@query("x1_split_pooled", headline=True, oracle=ev_sql(
    f"select event_key, event_number, label, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r",
    LABELLED_CTE, _ranked_cte("lab")))
def x1_split_pooled(spark, sf):
    """X1 + X7: exact seeded 0.6/0.2/0.2 split of all rows; event ids carried."""
    d = labelled(spark, sf).select("event_key", "event_number", "label")
    return X.assign_split(d, 0.6, 0.2, 0.2, SEED)


@query("x1_split_sizes_q1", oracle=ev_sql(
    "select split, count(*) as n from (select "
    f"{_split_case('rk', 'n', 0.5, 0.3, 0.2)} as split from r) t group by split",
    LABELLED_CTE, _ranked_cte("lab")))
def x1_split_sizes_q1(spark, sf):
    """X1 with (0.5, 0.3, 0.2) in compatibility mode (quirk Q1): sizes per part."""
    d = labelled(spark, sf).select("event_key")
    return X.assign_split(d, 0.5, 0.3, 0.2, SEED).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("x2_two_way_split", oracle=ev_sql(
    f"select event_key, {_split_case('rk', 'n', 0.75, 0.0, 0.25)} as split from r",
    LABELLED_CTE, _ranked_cte("lab")))
def x2_two_way(spark, sf):
    """Seeded train/test split, 25 % test."""
    return X.two_way_split(labelled(spark, sf).select("event_key"), 0.25, SEED)


@query("x3_split_by_tag", oracle=ev_sql(
    f"select event_key, tag, label, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r",
    LABELLED_CTE, _ranked_cte("lab", "tag")))
def x3_split_by_tag(spark, sf):
    """Split stratified by tag (exact sizes inside every tag), pooled."""
    d = labelled(spark, sf).select("event_key", "tag", "label")
    return X.assign_split(d, 0.6, 0.2, 0.2, SEED, strata=["tag"])


_MP_CTE = ("mp as (select event_key, tag, weight, f_qty, f_price, f_tax, f_retail, f_size, "
           "cast(regexp_extract(sample, '([0-9]+)', 1) as int) as mass, 1 as label from lab "
           "where sample like 'sig%' and cast(regexp_extract(sample, '([0-9]+)', 1) as int) in (1000, 1500, 2000) "
           "union all select event_key, tag, weight, f_qty, f_price, f_tax, f_retail, f_size, m.mass, 0 as label "
           "from lab cross join (select unnest([1000, 1500, 2000]) as mass) m where not (sample like 'sig%'))")


def _mp(spark, sf):
    d = labelled(spark, sf).select("event_key", "tag", "sample", "weight", *FEATURES)
    return mass_parameterised(d, MASSES).drop("sample")


@query("j1_mass_parameterised", oracle=ev_sql(
    "select mass, label, count(*) as n, round(sum(weight), 6) as w from mp group by mass, label",
    LABELLED_CTE, _MP_CTE))
def j1_mass_parameterised(spark, sf):
    """Signal rows keep their mass, background rows repeat once per mass."""
    return round_doubles(_mp(spark, sf).groupBy("mass", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")))


@query("x4_split_by_mass", oracle=ev_sql(
    f"select event_key, mass, label, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r",
    LABELLED_CTE, _MP_CTE, _ranked_cte("mp", "mass", "event_key, cast(mass as varchar)")))
def x4_split_by_mass(spark, sf):
    """J1 → X4: split stratified by mass; the key includes the mass."""
    d = _mp(spark, sf).select("event_key", "mass", "label")
    return X.assign_split(d, 0.6, 0.2, 0.2, SEED, key_cols=["event_key", "mass"], strata=["mass"])


@query("x5_split_by_mass_tag", oracle=ev_sql(
    f"select event_key, mass, tag, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r",
    LABELLED_CTE, _MP_CTE, _ranked_cte("mp", "mass, tag", "event_key, cast(mass as varchar)")))
def x5_split_by_mass_tag(spark, sf):
    """J1 → X5: split stratified by mass × tag."""
    d = _mp(spark, sf).select("event_key", "mass", "tag")
    return X.assign_split(d, 0.6, 0.2, 0.2, SEED, key_cols=["event_key", "mass"], strata=["mass", "tag"])


@query("p15_test_slice_tag2", oracle=ev_sql(
    "select event_key, tag, label from (select event_key, tag, label, "
    f"{_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r) t where split = 'test' and tag = 2",
    LABELLED_CTE, _ranked_cte("lab", "tag")))
def p15_test_slice(spark, sf):
    """X3 → P15: test rows of tag 2."""
    d = labelled(spark, sf).select("event_key", "tag", "label")
    s = X.assign_split(d, 0.6, 0.2, 0.2, SEED, strata=["tag"])
    return test_slice(s, tag=2).drop("split")


@query("a11_class_counts_per_split", oracle=ev_sql(
    "select split, label, count(*) as n, round(count(*) / sum(count(*)) over (partition by split), 6) as fraction "
    f"from (select label, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r) t group by split, label",
    LABELLED_CTE, _ranked_cte("lab")))
def a11_class_counts(spark, sf):
    """X1 → A11: class counts and shares per split."""
    s = X.assign_split(labelled(spark, sf).select("event_key", "label"), 0.6, 0.2, 0.2, SEED)
    return round_doubles(P.class_counts_per_split(s))


@query("x6_deterministic_shuffle", oracle=ev_sql(
    "select event_key, md5(concat_ws(':', '7', event_key)) as shuffle_key from ev order by shuffle_key"))
def x6_shuffle(spark, sf):
    """Rows in a seeded hash order (sorted only at the output)."""
    from ..sources.tables import event_view
    return X.shuffle_key(event_view(spark, sf).select("event_key"), 7, ["event_key"]).orderBy("shuffle_key")


@query("x8_per_class_sample", oracle=ev_sql(
    "select event_key, label from (select event_key, label, row_number() over (partition by label "
    f"order by md5(concat_ws(':', '{SEED}', event_key))) as rk from lab) t where rk <= 500", LABELLED_CTE))
def x8_per_class(spark, sf):
    """500 rows per class in hash order (sampling operator)."""
    return X.per_class_sample(labelled(spark, sf).select("event_key", "label"), 500, SEED)


@query("x12_hash_sample", oracle=ev_sql(
    f"select event_key from lab order by md5(concat_ws(':', '{SEED}', event_key)) limit 100", LABELLED_CTE))
def x12_hash_sample(spark, sf):
    """A 100-row background sample for attribution (sampling operator)."""
    return X.hash_sample(labelled(spark, sf).select("event_key"), 100, SEED)


# --- scaling ----------------------------------------------------------------

def _scaled_sql(src: str, feats, fit_where: str, part: str = "") -> str:
    g = f"group by {part}" if part else ""
    stats = ", ".join(f"avg({c}) as mu_{c}, stddev_pop({c}) as sd_{c}" for c in feats)
    keys = f"{part}, " if part else ""
    cols = ", ".join(
        f"round(({c} - mu_{c}) / case when sd_{c} = 0 then 1.0 else sd_{c} end, 6) as {c}" for c in feats)
    join = f"join st using ({part})" if part else "cross join st"
    return (f"st as (select {keys}{stats} from {src} where {fit_where} {g})", cols, join)


def _f1_sql():
    st, cols, join = _scaled_sql("s", FEATURES, "split = 'train'")
    return ev_sql(f"select event_key, split, {cols} from s {join}", LABELLED_CTE, _ranked_cte("lab"),
                  f"s as (select event_key, {', '.join(FEATURES)}, "
                  f"{_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r)", st)


@query("f1_standard_scale_train_fit", oracle=_f1_sql())
def f1_standard_scale(spark, sf):
    """X1 → F1: standardise with mean/population std fitted on train, applied to all."""
    d = labelled(spark, sf).select("event_key", *FEATURES)
    s = X.assign_split(d, 0.6, 0.2, 0.2, SEED)
    return round_doubles(S.standard_scale(s, FEATURES, F.col("split") == "train"))


def _x13_sql():
    st, cols, join = _scaled_sql("s", FEATURES, "split = 'train'", "tag")
    return ev_sql(f"select event_key, tag, split, {cols} from s {join}", LABELLED_CTE, _ranked_cte("lab", "tag"),
                  f"s as (select event_key, tag, {', '.join(FEATURES)}, "
                  f"{_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r)", st)


@query("x13_tag_balanced_scaled", oracle=_x13_sql())
def x13_tag_balanced(spark, sf):
    """Split per tag and scale per tag (one scaler per tag), then pooled."""
    d = labelled(spark, sf).select("event_key", "tag", *FEATURES)
    s = X.assign_split(d, 0.6, 0.2, 0.2, SEED, strata=["tag"])
    return round_doubles(S.standard_scale(s, FEATURES, F.col("split") == "train", group_cols=["tag"]))


def _minmax_sql(extra: str):
    stats = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in FEATURES)
    cols = ", ".join(f"round(({c} - lo_{c}) / case when hi_{c} - lo_{c} = 0 then 1.0 else hi_{c} - lo_{c} end, 6) "
                     f"as {c}" for c in FEATURES)
    return ev_sql(f"select event_key, {extra}{cols} from ev cross join (select {stats} from ev) st")


@query("f2_minmax_scale", oracle=_minmax_sql(""))
def f2_minmax(spark, sf):
    """min-max scaling of the features to [0, 1] over all rows."""
    from ..sources.tables import event_view
    return round_doubles(S.minmax_scale(event_view(spark, sf).select("event_key", *FEATURES), FEATURES))


@query("f3_minmax_with_weights", oracle=_minmax_sql("weight, "))
def f3_minmax_weights(spark, sf):
    """min-max of the features with the weight carried unscaled."""
    from ..sources.tables import event_view
    return round_doubles(S.minmax_scale(event_view(spark, sf).select("event_key", "weight", *FEATURES), FEATURES))


def _f4_sql(out: list[str] | None = None):
    """The scaled rows; the one-row statistics come as scalar subqueries."""
    feats = FEATURES + ["mass"]
    stats = ", ".join(f"avg({c}) as mu_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) as sd_{c}" for c in feats)
    cols = ", ".join(f"round(({c} - (select mu_{c} from st)) / (select sd_{c} from st), 6) as {c}" for c in out or feats)
    return ev_sql(f"select event_key, {'' if out else 'label, '}split, {cols} from s", LABELLED_CTE,
                  _MP_CTE.replace("mp as (", "mp as materialized ("),
                  _ranked_cte("mp", "mass", "event_key, cast(mass as varchar)"),
                  f"s as materialized (select event_key, label, {', '.join(FEATURES)}, mass, "
                  f"{_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split from r)",
                  f"st as materialized (select {stats} from s where split = 'train')")


@query("f4_mass_parameterised_scaled", headline=True, oracle=_f4_sql())
def f4_parameterised(spark, sf):
    """J1 → X4 → F4: mass appended as a model input and standardised with the features."""
    feats = S.parameterised_features(FEATURES, with_mass=True)
    d = _mp(spark, sf).select("event_key", "label", *feats)
    s = X.assign_split(d, 0.6, 0.2, 0.2, SEED, key_cols=["event_key", "mass"], strata=["mass"])
    out = S.standard_scale(s.withColumn("mass", F.col("mass").cast("double")), feats, F.col("split") == "train")
    return round_doubles(out)


@query("f4_mass_as_input", oracle=_f4_sql(["mass", "f_qty"]))
def f4_mass_input(spark, sf):
    """the appended mass beside one feature, both standardised on the training rows (the columns of
    f4_mass_parameterised_scaled that differ from F1)."""
    return f4_parameterised(spark, sf).select("event_key", "split", "mass", "f_qty")


@query("f5_assembled_matrix", oracle=ev_sql(
    f"select event_key, list_value({', '.join(FEATURES)}) as features from lab", LABELLED_CTE))
def f5_assemble(spark, sf):
    """the model matrix as one vector per row (shown as an array)."""
    from pyspark.ml.functions import vector_to_array
    d = S.assemble(labelled(spark, sf).select("event_key", *FEATURES), FEATURES, "vec")
    return d.select("event_key", vector_to_array("vec").alias("features"))
