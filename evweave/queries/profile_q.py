"""Queries for weighted yields and class-distribution profiles (A*, J2, J5, L16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.util import round_doubles
from ..operators import profile as P
from ..registry import ev_sql, query
from ..sources.tables import event_view, table
from .common import FEATURES, LABELLED_CTE, labelled

_DIST = ("round(case when sum(weight) != 0 then sum(label * weight) / sum(weight) "
         "else avg(label) end, 6) as signal_w_density, "
         "round(sum(label) / count(label), 6) as signal_density, "
         "cast(sum(label) as bigint) as signal_count, count(*) as total_count")


@query("a6_distribution_region_tag", headline=True, oracle=ev_sql(
    f"select region, tag, {_DIST} from lab group by region, tag", LABELLED_CTE))
def a6_distribution_region_tag(spark, sf):
    """P5 → L1 → A6: class distribution per (region, tag)."""
    return round_doubles(P.signal_distribution_per(labelled(spark, sf), ["region", "tag"]))


@query("a5_distribution_global", oracle=ev_sql(f"select {_DIST} from lab", LABELLED_CTE))
def a5_distribution_global(spark, sf):
    """A5 / A6 with an empty key list: one global row."""
    return round_doubles(P.signal_distribution_per(labelled(spark, sf), []))


@query("a6_distribution_levels", oracle=ev_sql(
    "select region, sample, tag, concat_ws(',', case when grouping(region) = 0 then 'region' end, "
    "case when grouping(sample) = 0 then 'sample' end, case when grouping(tag) = 0 then 'tag' end) as level, "
    f"{_DIST} from lab group by grouping sets ((sample), (region, tag), ())", LABELLED_CTE))
def a6_distribution_levels(spark, sf):
    """A6 at three levels (per sample, per region×tag, global) in one pass."""
    return round_doubles(P.signal_distribution_levels(
        labelled(spark, sf), [["sample"], ["region", "tag"], []]))


@query("a7_entries_region_tag_sample", headline=True, oracle=ev_sql(
    "select region, tag, sample, count(*) as entries from ev group by region, tag, sample"))
def a7_entries(spark, sf):
    """Entries per region × tag × sample over the whole table in one pass."""
    return P.entries(event_view(spark, sf), ["region", "tag", "sample"])


@query("a8_weighted_yield_sample", oracle=ev_sql(
    "select sample, count(*) as entries, round(sum(weight), 6) as yield from ev group by sample"))
def a8_weighted_yield(spark, sf):
    return round_doubles(P.weighted_yield(event_view(spark, sf), ["sample"]))


@query("a9_signal_vs_background", oracle=ev_sql(
    "select s.sample, s.n_signal, round(s.w_signal, 6) as w_signal, b.n_background, "
    "round(b.w_background, 6) as w_background, "
    "round(s.n_signal / (s.n_signal + b.n_background), 6) as density, "
    "round(s.w_signal / (s.w_signal + b.w_background), 6) as w_density from "
    "(select sample, count(*) as n_signal, sum(weight) as w_signal from ev "
    " where sample in ('sig1000', 'sig1500', 'sig2000') group by sample) s cross join "
    "(select count(*) as n_background, sum(weight) as w_background from ev where sample in ('ttbar')) b"))
def a9_signal_vs_background(spark, sf):
    return round_doubles(P.signal_vs_background(
        event_view(spark, sf), ["sig1000", "sig1500", "sig2000"], ["ttbar"]))


@query("a10_table_info_by_tag", oracle=ev_sql(
    "select tag, count(*) as n_rows, list_sort(list(distinct sample)) as samples, "
    "list_sort(list(distinct region)) as regions from ev group by tag"))
def a10_table_info(spark, sf):
    return P.table_info(event_view(spark, sf), "tag")


@query("a12_weight_shares_region", oracle=ev_sql(
    "select region, round(w_signal, 6) as w_signal, round(w_background, 6) as w_background, "
    "round(w_total, 6) as w_total, round(w_signal / w_total, 6) as signal_share, "
    "round(w_background / w_total, 6) as background_share, round(sqrt(w2_signal), 6) as err_signal, "
    "round(sqrt(w2_background), 6) as err_background from (select region, "
    "sum(case when label = 1 then weight else 0.0 end) as w_signal, "
    "sum(case when label = 0 then weight else 0.0 end) as w_background, sum(weight) as w_total, "
    "sum(case when label = 1 then weight * weight else 0.0 end) as w2_signal, "
    "sum(case when label = 0 then weight * weight else 0.0 end) as w2_background "
    "from lab group by region) g", LABELLED_CTE))
def a12_weight_shares(spark, sf):
    """A12 + A21: class weight shares and √Σw² errors per region."""
    return round_doubles(P.weight_shares(labelled(spark, sf), ["region"]))


@query("a13_class_counts_region", oracle=ev_sql(
    "select region, cast(sum(case when label = 1 then 1 else 0 end) as bigint) as n_signal, "
    "cast(sum(case when label = 0 then 1 else 0 end) as bigint) as n_background, count(*) as n_total "
    "from lab group by region", LABELLED_CTE))
def a13_class_counts(spark, sf):
    """Signal and background counts per region, aligned in one pass."""
    return P.class_counts_by(labelled(spark, sf), "region")


@query("a14_class_ratio_tag", oracle=ev_sql(
    "select tag, round(cast(sum(case when label = 1 then 1 else 0 end) as double) / "
    "cast(sum(case when label = 0 then 1 else 0 end) as double), 6) as class_ratio "
    "from lab group by tag", LABELLED_CTE))
def a14_class_ratio(spark, sf):
    return round_doubles(P.class_ratio(labelled(spark, sf), ["tag"]))


def _corr_sql():
    sel = []
    for a in FEATURES:
        for b in FEATURES:
            sel.append(f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) as corr from ev")
    return ev_sql(" union all ".join(sel))


@query("a15_correlation_matrix", oracle=_corr_sql())
def a15_correlation(spark, sf):
    """Pearson matrix of the five features from one aggregation pass."""
    return round_doubles(P.correlation_matrix(event_view(spark, sf), FEATURES))


@query("a15_correlation_components", oracle=(
    "with e as (select vec_id, unnest(embedding) as x, unnest(range(64)) as j from embeddings where len(embedding) = 64), "
    "a as (select vec_id, j, cast(x as double) as x from e) "
    "select cast(a.j as int) as feature_a, cast(b.j as int) as feature_b, round(corr(a.x, b.x), 6) as corr "
    "from a join a b using (vec_id) group by a.j, b.j"))
def a15_components(spark, sf):
    """A15 on a wide table: the 64 × 64 correlations of the vectors' components in one pass."""
    d = table(spark, sf, "embeddings").where(F.size("embedding") == 64)
    return round_doubles(P.correlation_matrix(d, "embedding", 64))


def _ranges_sql():
    sel = [f"select '{c}' as feature, min({c}) as mn, max({c}) as mx from ev" for c in FEATURES]
    return ev_sql("select feature, round(mn, 6) as min, round(mx, 6) as max, "
                  "round(round_even(mn, 0) - 1, 6) as lim_lo, round(round_even(mx, 0) + 1, 6) as lim_hi "
                  f"from ({' union all '.join(sel)}) t")


@query("a16_feature_ranges", oracle=_ranges_sql())
def a16_feature_ranges(spark, sf):
    """A16 + A17: min/max and half-even axis limits of every feature."""
    return round_doubles(P.feature_ranges(event_view(spark, sf), FEATURES))


@query("a18_weighted_score_std_sample", oracle=ev_sql(
    "select sample, round(m.wmean, 6) as wmean, "
    "round(sqrt(sum(weight * (score - m.wmean) * (score - m.wmean)) / sum(weight)), 6) as wstd "
    "from ev join (select sample as s2, sum(score * weight) / sum(weight) as wmean from ev group by sample) m "
    "on sample = m.s2 group by sample, m.wmean"))
def a18_weighted_std(spark, sf):
    """Weighted mean and population std of a per-row value, per sample."""
    return round_doubles(P.weighted_mean_std(event_view(spark, sf), "score", ["sample"]))


@query("a19_feature_means", oracle=ev_sql(" union all ".join(
    f"select '{c}' as feature, round(avg({c}), 6) as mean from ev" for c in FEATURES)))
def a19_feature_means(spark, sf):
    return round_doubles(P.feature_means(event_view(spark, sf), FEATURES))


@query("a20_entries_integral_names", oracle=ev_sql(
    "select n.sample, coalesce(g.entries, 0) as entries, round(coalesce(g.integral, 0.0), 6) as integral "
    "from (select unnest(['Zbb', 'ttbar', 'WW', 'Wjets', 'sig2000']) as sample) n left join "
    "(select sample, count(*) as entries, "
    "sum(case when f_qty >= 10.0 and f_qty <= 40.0 then weight else 0.0 end) as integral "
    "from ev group by sample) g on n.sample = g.sample"))
def a20_entries_integral(spark, sf):
    """A20 + J5: entries and in-range integral for a fixed sample list (zero when absent)."""
    return round_doubles(P.entries_and_integral(
        event_view(spark, sf), "f_qty", 10.0, 40.0, ["Zbb", "ttbar", "WW", "Wjets", "sig2000"]))


@query("a22_value_counts_sample", oracle=ev_sql(
    "select sample, count(*) as count from ev group by sample order by count desc, sample"))
def a22_value_counts(spark, sf):
    return P.value_counts(event_view(spark, sf), "sample")


@query("a23_distinct_regions", oracle=ev_sql("select distinct region from ev order by region"))
def a23_distinct(spark, sf):
    return P.distinct_sorted(event_view(spark, sf), "region")


@query("l16_log_prior_odds", oracle=ev_sql(
    "select round(ln(cast(sum(label) as double) / cast(sum(1 - label) as double)), 6) as log_odds from lab",
    LABELLED_CTE))
def l16_log_prior_odds(spark, sf):
    return round_doubles(P.log_prior_odds(labelled(spark, sf)))


@query("a21_negative_weight_profile", oracle=ev_sql(
    "select tag, count(*) as n, round(sum(weight), 6) as w, round(sum(weight * weight), 6) as w2 "
    "from ev where weight < 0 group by tag"))
def negative_weight_profile(spark, sf):
    """Negative-weight rows per tag: count, Σw and Σw² (signed-weight check)."""
    ev = event_view(spark, sf).where(F.col("weight") < 0)
    return round_doubles(ev.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"),
                                                 F.sum(F.col("weight") * F.col("weight")).alias("w2")))
