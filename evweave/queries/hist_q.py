"""Histogram queries (H1–H7, H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.util import round_doubles
from ..operators import hist as H
from ..operators.select import category
from ..registry import ev_sql, query
from ..sources.tables import event_view
from .common import FEATURES, LABELLED_CTE, labelled

SIGNALS = ["sig1000", "sig1500", "sig2000"]
BACKGROUNDS = ["WW", "Zbb", "fakes", "ttbar"]


def bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    return (f"case when {hi} = {lo} then 1 else "
            f"cast(least(floor(({x} - {lo}) / ({hi} - {lo}) * {n}) + 1, {n}) as int) end")


def _hist_out(keys: str, n: int) -> str:
    k = f"{keys}, " if keys else ""
    return (f"select {k}bin, round(lo, 6) as lo, round(hi, 6) as hi, "
            f"round(lo + (bin - 0.5) * (hi - lo) / {float(n)}, 6) as center, count(*) as entries, "
            f"round(sum(w), 6) as sum_w, round(sum(w * w), 6) as sum_w2 from b "
            f"group by {k}bin, lo, hi")


_CAT_SQL = ("case when sample = 'data' then 'data' when sample in ('sig1000', 'sig1500', 'sig2000') "
            "then 'signal' else 'background' end")


@query("h1_weighted_hist_sample", headline=True, oracle=ev_sql(
    _hist_out("sample", 30),
    "lim as (select min(f_price) as lo, max(f_price) as hi from ev)",
    f"b as (select sample, weight as w, lo, hi, {bin_sql('f_price', 'lo', 'hi', 30)} as bin from ev, lim)"))
def h1_weighted_hist(spark, sf):
    """H1: 30-bin weighted histogram of one feature per sample (global limits)."""
    return round_doubles(H.histogram(event_view(spark, sf), "f_price", 30, by=["sample"]))


@query("h2_background_stack", oracle=ev_sql(
    "select bin, sample, round(sum_w, 6) as sum_w, "
    "round(sum(sum_w) over (partition by bin order by sample rows between unbounded preceding and current row), 6) "
    "as stacked_w, round(sum(sum_w) over (partition by bin), 6) as total_w from "
    "(select sample, bin, sum(w) as sum_w from b group by sample, bin) h",
    "sr as (select * from ev where region = 'SR' and sample in ('WW', 'Zbb', 'fakes', 'ttbar'))",
    "lim as (select min(f_qty) as lo, max(f_qty) as hi from sr)",
    f"b as (select sample, weight as w, {bin_sql('f_qty', 'lo', 'hi', 30)} as bin from sr, lim)"))
def h2_background_stack(spark, sf):
    """H2: background samples stacked per bin in the signal region."""
    ev = event_view(spark, sf)
    sr = ev.where((F.col("region") == "SR") & F.col("sample").isin(BACKGROUNDS))
    h = H.histogram(sr, "f_qty", 30, by=["sample"])
    return round_doubles(H.background_stack(h))


@query("h4_data_over_background", oracle=ev_sql(
    "select bin, round(center, 6) as center, round(data, 6) as data, round(background, 6) as background, "
    "round(signal, 6) as signal, "
    "round(case when data != 0 then (data - background) / background end, 6) as residual from ("
    "select bin, center, sum(case when category = 'data' then cast(entries as double) else 0.0 end) as data, "
    "sum(case when category = 'background' then sum_w else 0.0 end) as background, "
    "sum(case when category = 'signal' then sum_w else 0.0 end) as signal from ("
    "select category, bin, lo + (bin - 0.5) * (hi - lo) / 30.0 as center, count(*) as entries, sum(w) as sum_w "
    "from b group by category, bin, lo, hi) h group by bin, center) g",
    f"sr as (select *, {_CAT_SQL} as category from ev where region = 'SR')",
    "lim as (select min(f_qty) as lo, max(f_qty) as hi from sr)",
    f"b as (select category, weight as w, lo, hi, {bin_sql('f_qty', 'lo', 'hi', 30)} as bin from sr, lim)"))
def h4_data_over_background(spark, sf):
    """P12 → H1 by category → H3/H4: data counts, background Σw, residual per bin."""
    ev = category(event_view(spark, sf).where(F.col("region") == "SR"), SIGNALS)
    h = H.histogram(ev, "f_qty", 30, by=["category"])
    return round_doubles(H.data_over_background(h))


@query("h5_scaled_signal_with_flow", oracle=ev_sql(
    "select sample, bin, count(*) as entries, round(sum(w), 6) as sum_w, round(sum(w * w), 6) as sum_w2 from ("
    "select sample, weight * case when sample = 'data' then 1.0 else 50.0 end as w, case when f_qty < 5.0 then 0 when f_qty > 45.0 then 31 else "
    f"{bin_sql('f_qty', '5.0', '45.0', 30)} end as bin from ev where sample in ('sig2000', 'data')) b "
    "group by sample, bin"))
def h5_scaled_signal(spark, sf):
    """H5: signal weights × 50, data weights as they are, on fixed limits, with under/overflow bins 0 and 31."""
    ev = event_view(spark, sf).where(F.col("sample").isin(["sig2000", "data"]))
    h = H.histogram(ev, "f_qty", 30, by=["sample"], lo=5.0, hi=45.0, 
                    scale=H.signal_scale(["sig2000"], 50.0), keep_flow=True)
    return round_doubles(h.select("sample", "bin", "entries", "sum_w", "sum_w2"))


def _long_sql(src: str, keys: str) -> str:
    return " union all ".join(f"select {keys}, weight, '{c}' as feature, cast({c} as double) as value from {src}"
                              for c in FEATURES)


@query("h6_sweep_region_tag_feature", headline=True, oracle=ev_sql(
    "select region, tag, feature, category, bin, round(lo, 6) as lo, round(hi, 6) as hi, "
    "round(lo + (bin - 0.5) * (hi - lo) / 30.0, 6) as center, count(*) as entries, "
    "round(sum(weight), 6) as sum_w, round(sum(weight * weight), 6) as sum_w2 from b "
    "group by region, tag, feature, category, bin, lo, hi",
    LABELLED_CTE,
    f"c as (select *, {_CAT_SQL} as category from lab)",
    f"lng as ({_long_sql('c', 'region, tag, category')})",
    "lim as (select region, tag, feature, min(value) as lo, max(value) as hi from lng group by region, tag, feature)",
    "b as (select l.*, lim.lo, lim.hi, " + bin_sql('value', 'lim.lo', 'lim.hi', 30) + " as bin from lng l "
    "join lim using (region, tag, feature))"))
def h6_sweep(spark, sf):
    """H6: every feature × region × tag × category, limits per (region, tag, feature), one pass."""
    ev = category(labelled(spark, sf), SIGNALS)
    return round_doubles(H.sweep_histograms(ev, FEATURES, ["region", "tag"], ["category"], 30))


@query("h7_unweighted_all_columns", oracle=ev_sql(
    "select feature, bin, round(lo, 6) as lo, round(hi, 6) as hi, "
    "round(lo + (bin - 0.5) * (hi - lo) / 10.0, 6) as center, count(*) as entries, "
    "cast(count(*) as double) as sum_w, cast(count(*) as double) as sum_w2 from b group by feature, bin, lo, hi",
    f"lng as ({_long_sql('ev', 'sample')})",
    "lim as (select feature, min(value) as lo, max(value) as hi from lng group by feature)",
    "b as (select l.*, lim.lo, lim.hi, " + bin_sql('value', 'lim.lo', 'lim.hi', 10) + " as bin from lng l "
    "join lim using (feature))"))
def h7_unweighted(spark, sf):
    """H7: 10-bin unweighted histogram of every feature column."""
    return round_doubles(H.sweep_histograms(event_view(spark, sf), FEATURES, [], [], 10, weight=None))


@query("h9_density_2d", oracle=ev_sql(
    "select label, " + bin_sql('f_qty', 'xlo', 'xhi', 20) + " as bx, " + bin_sql('f_retail', 'ylo', 'yhi', 20)
    + " as by, count(*) as entries from lab, (select min(f_qty) as xlo, max(f_qty) as xhi, "
    "min(f_retail) as ylo, max(f_retail) as yhi from lab) l group by all", LABELLED_CTE))
def h9_density_2d(spark, sf):
    """H9: 20×20 density of two features per class."""
    return H.histogram_2d(labelled(spark, sf), "f_qty", "f_retail", 20, ["label"])


_HEX_SQL = """
u as (select label, (f_qty - xlo) / (xhi - xlo) * 20.0 as x, (f_retail - ylo) / (yhi - ylo) * 20.0 as y, xlo, xhi, ylo, yhi
  from lab, (select min(f_qty) as xlo, max(f_qty) as xhi, min(f_retail) as ylo, max(f_retail) as yhi from lab) l),
c as (select *, x - y / {r3} as q, y * 2.0 / {r3} as r from u),
f as (select *, floor(q + 0.5) as rq, floor(r + 0.5) as rr, floor(-q - r + 0.5) as rs from c),
d as (select *, abs(rq - q) as dq, abs(rr - r) as dr, abs(rs - (-q - r)) as ds from f),
h as (select label, cast(case when dq > dr and dq > ds then -rr - rs else rq end as bigint) as q,
  cast(case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end as bigint) as r, xlo, xhi, ylo, yhi from d)""".format(r3=repr(3.0 ** 0.5))


@query("h9_hexagon_density", oracle=ev_sql(
    "select label, q, r, round(any_value(xlo) + (q + r / 2.0) / 20.0 * (any_value(xhi) - any_value(xlo)), 6) as center_x, "
    f"round(any_value(ylo) + r * {3.0 ** 0.5!r} / 2.0 / 20.0 * (any_value(yhi) - any_value(ylo)), 6) as center_y, count(*) as entries "
    "from h group by label, q, r", LABELLED_CTE, _HEX_SQL.strip()))
def h9_hexagons(spark, sf):
    """H9: hexagonal density of two features per class, 20 hexagons across."""
    return round_doubles(H.hexagon_density(labelled(spark, sf), "f_qty", "f_retail", 20, ["label"]))


def _h8_sql():
    from .split_q import _ranked_cte, _split_case
    return ev_sql(
        "select split, prediction, bin, count(*) as entries from (select "
        f"{_split_case('rk', 'n', 0.6, 0.2, 0.2)} as split, case when score > 0.5 then 1 else 0 end as prediction, "
        f"{bin_sql('score', '0.0', '1.0', 20)} as bin from r) t group by split, prediction, bin",
        LABELLED_CTE, _ranked_cte("lab"))


@query("h8_score_hist_by_split_prediction", oracle=_h8_sql())
def h8_score_hist(spark, sf):
    """X1 → L7 → H8: 20-bin score histogram per split and predicted class."""
    from ..operators import split as X
    from ..operators.metrics import with_prediction
    d = X.assign_split(labelled(spark, sf).select("event_key", "label", "score"), 0.6, 0.2, 0.2, 42)
    return H.score_histogram(with_prediction(d, 0.5), n_bins=20)
