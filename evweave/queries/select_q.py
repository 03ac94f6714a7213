"""Selection, labelling, set-operation and source/sink queries
(P*, L1–L6, L10, L11, L18, U1, U2, U4, J9, S1–S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.util import round_doubles
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import select as Sel
from ..operators import split as X
from ..plans.small import with_scalars
from ..registry import ev_sql, query
from ..schema import EVENT_VIEW_SCHEMA
from ..sources import io as IO
from ..sources.tables import embedding_table, event_view
from .common import FEATURES, LABELLED_CTE, MASSES, labelled
from .metrics_q import _report_sql, _cm_sql

_ALL = ("event_key, event_number, region, tag, sample, weight, f_qty, f_price, f_tax, f_retail, f_size, score")


# --- P1–P16 ---------------------------------------------------------------------

@query("p1_region_filter", oracle=ev_sql("select event_key, sample, weight from ev where region = 'SR'"))
def p1(spark, sf):
    return Sel.filter_region(event_view(spark, sf), "SR").select("event_key", "sample", "weight")


@query("p2_tag_filter", oracle=ev_sql("select event_key, tag from ev where tag = 2"))
def p2(spark, sf):
    return Sel.filter_tag(event_view(spark, sf), 2).select("event_key", "tag")


@query("p3_sample_filter", oracle=ev_sql("select event_key, weight from ev where sample = 'ttbar'"))
def p3(spark, sf):
    return Sel.filter_sample(event_view(spark, sf), "ttbar").select("event_key", "weight")


@query("p4_drop_fakes", oracle=ev_sql("select event_key, sample from ev where sample <> 'fakes'"))
def p4(spark, sf):
    return Sel.drop_fakes(event_view(spark, sf)).select("event_key", "sample")


@query("p5_drop_twodim", oracle=ev_sql("select event_key, region from ev where region <> 'TwoDimMassWindow'"))
def p5(spark, sf):
    return Sel.drop_twodim(event_view(spark, sf)).select("event_key", "region")


@query("p6_optional_filters", oracle=ev_sql("select event_key, tag from ev where region = 'QCDCR'"))
def p6(spark, sf):
    """Region given, tag None (no tag filter)."""
    return Sel.preprocess(event_view(spark, sf), region="QCDCR", tag=None).select("event_key", "tag")


@query("p7_v1_pipeline", oracle=ev_sql(
    "select event_key, sample, cast(regexp_matches(sample, '.*sig1000[^0-9]*') as int) as label from ev "
    "where region <> 'TwoDimMassWindow' and region = 'SR' and tag = 1"))
def p7(spark, sf):
    """Drop 2-D region, region SR, tag 1, regex label for sig1000."""
    return Sel.preprocess_v1(event_view(spark, sf), "sig1000", "SR", 1).select("event_key", "sample", "label")


@query("p8_training_projection", oracle=ev_sql(
    "select weight, label, event_number, tag, f_qty, f_price, f_tax, f_retail, f_size from lab", LABELLED_CTE))
def p8(spark, sf):
    """Weight, label, event id, tag and the chosen features."""
    return Sel.project_training(labelled(spark, sf), FEATURES, include_event=True, keep_tag=True)


@query("p9_projection_with_region", oracle=ev_sql(
    "select weight, label, region, f_qty, f_price from lab", LABELLED_CTE))
def p9(spark, sf):
    """The v1 projection keeping the region (no tag)."""
    return Sel.project_training(labelled(spark, sf), ["f_qty", "f_price"], keep_tag=False, keep_region=True)


@query("p10_drop_blacklist", oracle=ev_sql(
    "select event_key, region, tag, sample, weight, f_qty, f_price, f_retail, f_size from ev"))
def p10(spark, sf):
    """P10: drop a blacklist (one name absent from the table)."""
    return Sel.drop_columns(event_view(spark, sf), ["event_number", "f_tax", "score", "EventWeightNoXSec"])


@query("p11_sample_membership", oracle=ev_sql(
    "select event_key, sample from ev where sample in ('data', 'ttbar', 'Zbb')"))
def p11(spark, sf):
    return Sel.filter_samples(event_view(spark, sf), ["data", "ttbar", "Zbb"]).select("event_key", "sample")


@query("p12_three_way_category", oracle=ev_sql(
    "select category, count(*) as n, round(sum(weight), 6) as w from (select weight, case when sample = 'data' "
    "then 'data' when sample in ('sig1000', 'sig1500', 'sig2000') then 'signal' else 'background' end as category "
    "from ev) t group by category"))
def p12(spark, sf):
    """Data / signal / background-by-exclusion, summarised."""
    c = Sel.category(event_view(spark, sf), ["sig1000", "sig1500", "sig2000"])
    return round_doubles(c.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")))


@query("p13_non_negative_weights", oracle=ev_sql("select event_key, weight from ev where weight >= 0"))
def p13(spark, sf):
    return Sel.non_negative_weights(event_view(spark, sf)).select("event_key", "weight")


@query("p14_keep_one_class", oracle=ev_sql("select event_key, sample from lab where label = 0", LABELLED_CTE))
def p14(spark, sf):
    return Sel.keep_class(labelled(spark, sf), 0).select("event_key", "sample")


@query("p16_misclassified", oracle=ev_sql(
    "select event_key, label, case when score > 0.5 then 1 else 0 end as prediction from lab "
    "where case when score > 0.5 then 1 else 0 end <> label", LABELLED_CTE))
def p16(spark, sf):
    d = M.with_prediction(labelled(spark, sf), 0.5)
    return Sel.misclassified(d).select("event_key", "label", "prediction")


# --- labels ------------------------------------------------------------------------

@query("l1_regex_label_prefix_quirk", oracle=ev_sql(
    "select sample, cast(regexp_matches(sample, '.*sig1[^0-9]*') as int) as label, count(*) as n "
    "from ev group by all"))
def l1(spark, sf):
    """L1 with signal 'sig1': the unanchored rule also matches every sig1xxx (quirk Q7)."""
    d = event_view(spark, sf).withColumn("label", L.label_regex("sample", "sig1"))
    return d.groupBy("sample", "label").agg(F.count(F.lit(1)).alias("n"))


@query("l2_label_by_source", oracle=ev_sql(
    "select label, count(*) as n from (select 1 as label from ev where sample like 'sig%' union all "
    "select 0 from ev where sample not like 'sig%' and sample <> 'data') t group by label"))
def l2(spark, sf):
    """L2 + U1: signal tables labelled 1, background 0, then a by-name union."""
    ev = event_view(spark, sf)
    s = ev.where(F.col("sample").startswith("sig"))
    b = ev.where(~F.col("sample").startswith("sig") & (F.col("sample") != "data"))
    return Sel.label_sources([s], b).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("l3_exact_label", oracle=ev_sql(
    "select sample, cast(sample = 'sig1500' as int) as label, count(*) as n from ev where sample <> 'data' "
    "group by all"))
def l3(spark, sf):
    """L3: exact-name label with the data sample removed."""
    d = Sel.label_by_sample(event_view(spark, sf), "sig1500")
    return d.groupBy("sample", "label").agg(F.count(F.lit(1)).alias("n"))


@query("l5_contains_label", oracle=ev_sql(
    "select sample, cast(contains(sample, 'sig') as int) as label, count(*) as n from ev group by all"))
def l5(spark, sf):
    d = event_view(spark, sf).withColumn("label", L.label_contains("sample", "sig"))
    return d.groupBy("sample", "label").agg(F.count(F.lit(1)).alias("n"))


@query("l18_string_to_bytes", oracle=ev_sql(
    "select sample, hex(cast(sample as blob)) as sample_hex, count(*) as n from ev group by all"))
def l18(spark, sf):
    d = event_view(spark, sf).withColumn("sample_hex", F.hex(L.to_bytes("sample")))
    return d.groupBy("sample", "sample_hex").agg(F.count(F.lit(1)).alias("n"))


def _mean_vector(df, fit_filter):
    """Per-position mean of the ``x`` arrays of the fitting rows, as ONE row
    holding an array as long as the embedding (bounded by the dimension)."""
    pe = df.where(fit_filter).select(F.posexplode("x").alias("pos", "v"))
    m = pe.groupBy("pos").agg(F.avg("v").alias("m"))
    return m.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(
        F.transform("s", lambda e: e["m"]).alias("xhat"))


@query("l10_l11_reconstruction_error", oracle=(
    "with e as (select vec_id, cast(label = 0 as int) as label, embedding from embeddings), "
    "p as (select vec_id, label, generate_subscripts(embedding, 1) as pos, cast(unnest(embedding) as double) as v "
    "from e), m as (select pos, avg(v) as m from p where label = 0 group by pos), "
    "err as (select vec_id, label, sum((v - m) * (v - m)) / count(*) as error from p join m using (pos) "
    "group by vec_id, label) "
    "select vec_id, label, round(error, 6) as error, cast(error > 1.1 * (select avg(error) from err where label = 0) "
    "as int) as prediction from err"))
def l10_l11(spark, sf):
    """L10 + L11: reconstruction error against the class-0 mean vector (rank-0
    reconstruction), anomaly class 1 above 1.1 × the class-0 mean error."""
    e = embedding_table(spark, sf, positive_label=0)
    mv = _mean_vector(e, F.col("label") == 0)
    d = with_scalars(e, mv).withColumn("error", L.reconstruction_error("x", "xhat"))
    th = d.where(F.col("label") == 0).agg((F.avg("error") * 1.1).alias("_th"))
    d = with_scalars(d, th).withColumn("prediction", L.anomaly_class("error", F.col("_th"), 1))
    return round_doubles(d.select("vec_id", "label", "error", "prediction"))


@query("j8_error_by_class", oracle=(
    "with e as (select vec_id, cast(label = 0 as int) as label, embedding from embeddings), "
    "p as (select vec_id, label, generate_subscripts(embedding, 1) as pos, cast(unnest(embedding) as double) as v "
    "from e), m as (select pos, avg(v) as m from p where label = 0 group by pos), "
    "err as (select vec_id, label, sum((v - m) * (v - m)) / count(*) as error from p join m using (pos) "
    "group by vec_id, label) "
    "select label, count(*) as n, round(avg(error), 6) as mean_error, round(min(error), 6) as min_error, "
    "round(max(error), 6) as max_error from err group by label"))
def j8(spark, sf):
    """L10 → J8: the error beside the true class, summarised per class."""
    e = embedding_table(spark, sf, positive_label=0)
    mv = _mean_vector(e, F.col("label") == 0)
    d = with_scalars(e, mv).withColumn("error", L.reconstruction_error("x", "xhat"))
    return round_doubles(M.error_by_class(d))


# --- set operations ------------------------------------------------------------------

@query("u1_union_regions", oracle=ev_sql(
    "select region, count(*) as n from (select region from ev where region = 'SR' union all "
    "select region from ev where region = 'QCDCR' union all select region from ev where region = 'SR') t "
    "group by region"))
def u1(spark, sf):
    """Bag union (duplicates kept) of three selections."""
    ev = event_view(spark, sf).select("region")
    sr, cr = ev.where(F.col("region") == "SR"), ev.where(F.col("region") == "QCDCR")
    return Sel.concat([sr, cr, sr]).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("u2_keyed_concat", oracle=ev_sql(
    "select dataset, label, count(*) as n from (select 'sr' as dataset, label from lab where region = 'SR' "
    "union all select 'cr', label from lab where region = 'QCDCR') t group by dataset, label", LABELLED_CTE))
def u2(spark, sf):
    """A mapping of tables concatenated with its key as a column."""
    lab = labelled(spark, sf).select("region", "label")
    d = Sel.concat_keyed({"sr": lab.where(F.col("region") == "SR").drop("region"),
                          "cr": lab.where(F.col("region") == "QCDCR").drop("region")})
    return d.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))


@query("u4_difference", oracle=ev_sql(
    "select event_key from ev where event_key not in (select event_key from ev where region = 'SR')"))
def u4(spark, sf):
    """U4: events not in the signal region, as an anti join on the key."""
    ev = event_view(spark, sf).select("event_key", "region")
    return Sel.difference(ev, ev.where(F.col("region") == "SR"), ["event_key"]).select("event_key")


# --- sources and sinks -------------------------------------------------------------------

@query("s1_event_table", oracle=ev_sql(f"select {_ALL} from ev"))
def s1(spark, sf):
    """The event table with its declared schema."""
    return event_view(spark, sf)


@query("s14_parquet_round_trip", oracle=ev_sql(f"select {_ALL} from ev"))
def s14(spark, sf):
    """Write the event table, read it back with the same schema."""
    return IO.round_trip(event_view(spark, sf), IO.new_store(spark, "roundtrip"))


@query("s2_csv_signal_background", oracle=ev_sql(
    "select label, sample, count(*) as n, round(sum(weight), 6) as w from (select 1 as label, sample, weight from ev "
    "where sample = 'sig2000' union all select 0, sample, weight from ev where sample not like 'sig%' "
    "and sample <> 'data') t group by label, sample"))
def s2(spark, sf):
    """Signal and background CSV files read with a declared schema, labelled by source."""
    ev = event_view(spark, sf)
    sp, bp = IO.new_store(spark, "sig-csv"), IO.new_store(spark, "bkg-csv")
    ev.where(F.col("sample") == "sig2000").write.option("header", True).csv(sp)
    ev.where(~F.col("sample").startswith("sig") & (F.col("sample") != "data")).write.option("header", True).csv(bp)
    d = IO.read_dataset(spark, sp, bp, EVENT_VIEW_SCHEMA)
    return round_doubles(d.groupBy("label", "sample").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")))


def _dataset_store(spark, sf):
    """The event table laid out one folder per dataset (dataset = sample)."""
    path = IO.new_store(spark, "datasets")
    event_view(spark, sf).withColumn("dataset", F.col("sample")).write.partitionBy("dataset").parquet(path)
    return path


def _dataset_files(spark, sf):
    """One small file per dataset, named as in :func:`_dataset_store`: a listing reads no contents."""
    path = IO.new_store(spark, "dataset-files")
    names = event_view(spark, sf).select("sample").distinct()
    names.withColumn("dataset", F.col("sample")).write.partitionBy("dataset").parquet(path)
    return path


def _dataset_of_path():
    return F.regexp_extract(F.col("path"), r"dataset=([^/]+)/", 1)


@query("s3_file_roles", oracle=ev_sql(
    "select distinct sample as dataset, case when contains(sample, 'sig2000') then 'signal' "
    "when sample = 'data' then 'data' else 'background' end as role from ev"))
def s3(spark, sf):
    """S3: list the dataset files (contents never read) and give each a role by name."""
    files = IO.list_files(spark, _dataset_files(spark, sf), "*.parquet")
    ds = files.select(_dataset_of_path().alias("dataset")).distinct()
    return ds.withColumn("role", IO.role_of("dataset", "sig2000"))


@query("j9_background_file_set", oracle=ev_sql(
    "select distinct sample as dataset from ev where not contains(sample, 'sig2000') and sample <> 'data'"))
def j9(spark, sf):
    """Background files = all files − signal files − data files (anti joins)."""
    files = IO.list_files(spark, _dataset_files(spark, sf), "*.parquet").select(_dataset_of_path().alias("dataset"))
    sig = files.where(F.col("dataset").contains("sig2000"))
    dat = files.where(F.col("dataset") == "data")
    return Sel.difference(Sel.difference(files, sig, ["dataset"]), dat, ["dataset"]).distinct()


_S6_SQL = ("s6 as (select *, case when contains(sample, 'sig2000') then 'signal' else 'background' end as role "
           "from ev where region <> 'TwoDimMassWindow' and ((contains(sample, 'sig2000') and sample <> 'fakes') "
           "or (not contains(sample, 'sig2000') and sample <> 'data') or (sample = 'data' and sample = 'fakes')))")


@query("s6_signal_background_stores", oracle=ev_sql(
    "select role, sample as dataset, region, count(*) as n, round(sum(weight), 6) as w from s6 group by all", _S6_SQL))
def s6(spark, sf):
    """Stores built by the role rule, written partitioned by (role, dataset), read back."""
    ev = event_view(spark, sf).withColumn("dataset", F.col("sample"))
    path = IO.new_store(spark, "stores")
    IO.write_stores(IO.signal_background_rows(ev, "sig2000"), path)
    back = spark.read.parquet(path)
    return round_doubles(back.groupBy("role", "dataset", "region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")))


@query("s7_build_or_read_merged", oracle=ev_sql(
    "select role, sample as dataset, count(*) as n from (select *, case when contains(sample, 'sig1500') then 'signal' "
    "when sample = 'data' then 'data' else 'background' end as role from ev) t where role <> 'data' group by all"))
def s7(spark, sf):
    """S5 built once by S7 (second call reads the stored result)."""
    ev = event_view(spark, sf).withColumn("dataset", F.col("sample"))
    path = IO.new_store(spark, "merged")

    def build():
        return IO.merged_signal_dataset(ev, "sig1500", drop_fakes=False)
    IO.build_or_read(spark, path, build)
    back = IO.build_or_read(spark, path, build)  # present now: read, not rebuilt
    return back.groupBy("role", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query("s4_merged_signal_v1", oracle=ev_sql(
    "select role, count(*) as n from (select *, case when contains(sample, 'sig1000') then 'signal' "
    "when sample = 'data' then 'data' else 'background' end as role from ev) t "
    "where role <> 'data' and sample <> 'fakes' group by role"))
def s4(spark, sf):
    """One signal plus every background dataset, fakes dropped (v1)."""
    ev = event_view(spark, sf).withColumn("dataset", F.col("sample"))
    return IO.merged_signal_dataset(ev, "sig1000").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("s8_route_rows", oracle=ev_sql(
    "select region, tag, route, count(*) as n from (select region, tag, case when sample = 'data' then 'data' "
    "when contains(sample, 'sig2000') then 'signal' else 'background' end as route from ev "
    "where region = 'SR' and tag = 2) t group by all"))
def s8(spark, sf):
    """One (region, tag) routed to signal / background / data folders, read back."""
    path = IO.new_store(spark, "routes")
    IO.write_routes(IO.route(event_view(spark, sf), "SR", 2, "sig2000"), path)
    return spark.read.parquet(path).groupBy("region", "tag", "route").agg(F.count(F.lit(1)).alias("n"))


def _s9_sql():
    from .split_q import _MP_CTE, _ranked_cte, _split_case
    return ev_sql(f"select split, mass, count(*) as n from (select mass, {_split_case('rk', 'n', 0.6, 0.2, 0.2)} "
                  "as split from r) t group by split, mass",
                  LABELLED_CTE, _MP_CTE, _ranked_cte("mp", "mass", "event_key, cast(mass as varchar)"))


@query("s9_split_event_ids", oracle=_s9_sql())
def s9(spark, sf):
    """X4 → S9: event ids written per (split, mass), read back and counted."""
    d = labelled(spark, sf).select("event_key", "tag", "sample", "weight")
    mp = Sel.mass_parameterised(d, MASSES)
    s = X.assign_split(mp, 0.6, 0.2, 0.2, 42, key_cols=["event_key", "mass"], strata=["mass"])
    path = IO.new_store(spark, "split-ids")
    IO.write_split_ids(s, path)
    return spark.read.parquet(path).groupBy("split", "mass").agg(F.count(F.lit(1)).alias("n"))


@query("s10_yield_tables_csv", oracle=ev_sql(
    "select sample, count(*) as entries, region, tag from ev group by region, tag, sample"))
def s10(spark, sf):
    """A7 → S10: yield tables per (region, tag) as CSV, read back with a declared schema."""
    path = IO.new_store(spark, "yields")
    IO.write_yields(P.entries(event_view(spark, sf), ["region", "tag", "sample"]), path)
    return IO.read_yields(spark, path)


@query("s11_evaluation_json", oracle=ev_sql(
    "select tag, weighted, class, precision, recall, f1, support from (" + _report_sql("tag") + ") t",
    LABELLED_CTE, "sr as (select * from lab where region = 'SR' and sample <> 'data')",
    f"cm as ({_cm_sql('sr', 'tag')})"))
def s11(spark, sf):
    """E5 per tag → S11: nested JSON report written, read back with a schema, flattened."""
    from pyspark.sql import types as T
    from .common import labelled_sr
    path = IO.new_store(spark, "eval-json")
    IO.write_evaluation_json(M.evaluation_json(labelled_sr(spark, sf), 0.4, ["tag"]), path)
    back = IO.read_evaluation_json(spark, path, [T.StructField("tag", T.IntegerType())])
    return round_doubles(back)


@query("l4_label_by_file", oracle=ev_sql(
    "select sample, cast(sample = 'sig2000' and sample <> 'fakes' as int) as label, count(*) as n "
    "from ev group by all"))
def l4(spark, sf):
    """L4: rows labelled by the name of the file they were read from (signal
    file's fake rows excluded), using the ``_metadata.file_path`` column."""
    d = spark.read.parquet(_dataset_store(spark, sf)).select("sample", "_metadata.file_path")
    d = d.withColumn("label", L.label_by_file("file_path", "dataset=sig2000/", sample="sample"))
    return d.groupBy("sample", "label").agg(F.count(F.lit(1)).alias("n"))


@query("l6_file_stem", oracle=ev_sql(
    "select regexp_extract(p, '([^/]+)\\.[^./]+$', 1) as dataset, count(*) as n from "
    "(select concat('/store/v2/', sample, '.root') as p from ev) t group by all"))
def l6(spark, sf):
    """The file stem of a path as the dataset name."""
    d = event_view(spark, sf).select(F.concat(F.lit("/store/v2/"), F.col("sample"), F.lit(".root")).alias("p"))
    return d.select(L.file_stem("p").alias("dataset")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("s5_merge_signal_file_with_backgrounds", oracle=ev_sql(
    "select dataset, count(*) as n, round(sum(weight), 6) as w from (select sample as dataset, weight from ev "
    "where sample = 'sig1500' or (sample not like 'sig%' and sample <> 'data')) t group by dataset"))
def s5(spark, sf):
    """One signal file merged with every non-signal, non-data file — read
    from the per-dataset store with a filter on the partition column (the
    other datasets' folders are pruned, never opened)."""
    path = _dataset_store(spark, sf)
    d = spark.read.parquet(path)
    ds = F.col("dataset")
    merged = d.where((ds == "sig1500") | (~ds.startswith("sig") & (ds != "data")))
    return round_doubles(merged.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")))


@query("a10_table_info_per_dataset_file", oracle=ev_sql(
    "select sample as dataset, count(*) as n_rows, list_sort(list(distinct sample)) as samples, "
    "list_sort(list(distinct region)) as regions from ev group by sample"))
def a10_per_file(spark, sf):
    """S3 layout → A10: per dataset file (from ``_metadata.file_path``): rows,
    sorted distinct samples and regions."""
    d = spark.read.parquet(_dataset_store(spark, sf)).select("sample", "region", "_metadata.file_path")
    d = d.withColumn("dataset", F.regexp_extract("file_path", r"dataset=([^/]+)/", 1))
    return P.table_info(d, "dataset")


@query("a22_event_type_counts", oracle=(
    "select event_type, count(*) as count from events group by event_type order by count desc, event_type"))
def a22_events(spark, sf):
    """A22 on the second source (``events``): value counts of the event type."""
    from ..sources.tables import table
    return P.value_counts(table(spark, sf, "events", ["event_type"]), "event_type")


@query("s3_events_files_per_type", oracle=(
    "select event_type, count(*) as n_rows, count(distinct user_id) as n_users, "
    "round(sum(value), 6) as total_value from events group by event_type"))
def s3_events(spark, sf):
    """S3/S10 on ``events``: one folder per event type written, then each
    type's files read back by a partition filter and profiled."""
    from ..sources.tables import table
    path = IO.new_store(spark, "events-by-type")
    table(spark, sf, "events", ["event_type", "user_id", "value"]).write.partitionBy("event_type").parquet(path)
    back = spark.read.parquet(path)
    return round_doubles(back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users"),
        F.sum("value").alias("total_value")))


@query("st_label_stream_counts", oracle=ev_sql(
    "select sample, label, prediction, count(*) as n from (select sample, "
    "cast(regexp_matches(sample, '.*sig[^0-9]*') as int) as label, "
    "cast(score > 0.5 as int) as prediction from ev where region <> 'TwoDimMassWindow') t group by all"))
def st_stream(spark, sf):
    """Streaming path: the event table written as files is read as a stream
    (declared schema, a few files per trigger), the stateless operators (P5 →
    L1 → L7) run incrementally into a Parquet sink with its progress in the
    checkpoint folder (exactly once), and the sink is read back and counted."""
    from ..streaming import events as ST
    src, sink = IO.new_store(spark, "stream-src"), IO.new_store(spark, "stream-sink")
    event_view(spark, sf).write.parquet(src)
    stream = ST.label_stream(ST.read_event_stream(spark, src, EVENT_VIEW_SCHEMA, max_files_per_trigger=2),
                             "sig", th=0.5)
    q = ST.write_stream(stream, sink, "labels")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink).groupBy("sample", "label", "prediction").agg(
        F.count(F.lit(1)).alias("n"))
