"""Sources and sinks.

Files are read with a declared schema (no inference) and written
partitioned by the columns later queries filter on (role, dataset, region,
tag, split, mass), so those filters become partition pruning. Intermediate
stores go under the session's shared checkpoint folder, never a local temp dir.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import file_stem
from ..schema import DATA_SAMPLE, DEFAULT_ROLES, FAKES_SAMPLE, TWO_DIM_REGION, Roles
from ..session import scratch_path


def new_store(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# --- S1, S2, S14: reading and round trips ---------------------------------------

def read_events(spark: SparkSession, path: str, schema: T.StructType | None = None,
                fmt: str = "parquet", header: bool = True) -> DataFrame:
    """An event file or folder with a declared schema."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", header)
    return r.load(path)


def read_dataset(spark: SparkSession, signal_path: str, background_path: str, schema: T.StructType,
                 fmt: str = "csv", roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """S2 + L2: signal file(s) labelled 1, background file(s) labelled 0."""
    s = read_events(spark, signal_path, schema, fmt).withColumn(roles.label, F.lit(1))
    b = read_events(spark, background_path, schema, fmt).withColumn(roles.label, F.lit(0))
    return s.unionByName(b)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Write and read back; the schema must survive unchanged."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError("schema changed in the round trip")
    return back


# --- S3, J9: roles from file names ---------------------------------------------------

def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A file listing as a DataFrame (path, length, stem) — file contents are
    pruned away and never read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
          .option("recursiveFileLookup", "true").load(folder))
    return df.select("path", "length", file_stem(F.col("path")).alias("stem"))


def role_of(name_col, signal: str, data_name: str = DATA_SAMPLE):
    """S3: signal if the name contains the signal, data if it is the data
    name, background otherwise (the set difference)."""
    n = F.col(name_col) if isinstance(name_col, str) else name_col
    return (F.when(n.contains(signal), "signal").when(n == data_name, "data").otherwise("background"))


def is_finished(spark: SparkSession, path: str) -> bool:
    """True for a folder with the writers' ``_SUCCESS`` marker."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _by_folder(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.hint("rebalance", *[F.col(c) for c in cols])


# --- S4–S7: building stores -----------------------------------------------------------

def signal_background_rows(df: DataFrame, signal: str, dataset: str = "dataset",
                           roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """S6 rule on one table: drop the 2-D region everywhere; signal datasets
    lose their fake rows; background datasets keep everything; data datasets
    contribute only their fake rows, to the background."""
    role = role_of(dataset, signal)
    d = df.where(F.col(roles.region) != TWO_DIM_REGION).withColumn("_src", role)
    s = F.col(roles.sample)
    keep = (((F.col("_src") == "signal") & (s != FAKES_SAMPLE))
            | (F.col("_src") == "background")
            | ((F.col("_src") == "data") & (s == FAKES_SAMPLE)))
    return (d.where(keep).withColumn("role", F.when(F.col("_src") == "signal", "signal").otherwise("background"))
            .drop("_src"))


def merged_signal_dataset(df: DataFrame, signal: str, dataset: str = "dataset", drop_fakes: bool = True,
                          roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """One signal plus every non-signal, non-data dataset (S5 keeps fakes)."""
    role = role_of(dataset, signal)
    d = df.withColumn("role", role).where(F.col("role") != "data")
    if drop_fakes:
        d = d.where(F.col(roles.sample) != FAKES_SAMPLE)
    return d


def write_stores(df: DataFrame, path: str, partition_cols: Sequence[str] = ("role", "dataset"),
                 mode: str = "overwrite") -> None:
    """S6 sink: one folder per (role, dataset). Rows are rebalanced by folder first:
    large folders are split, small ones are not scattered over all tasks' files."""
    _by_folder(df, partition_cols).write.mode(mode).partitionBy(*partition_cols).parquet(path)


def build_or_read(spark: SparkSession, path: str, build, force: bool = False,
                  partition_cols: Sequence[str] = ("role", "dataset")) -> DataFrame:
    """Build the store only when absent (or forced), then read it. A store
    counts as present only with its ``_SUCCESS`` marker: one whose writer died
    is built again."""
    if force or not is_finished(spark, path):
        write_stores(build(), path, partition_cols)
    return spark.read.parquet(path)


def route(df: DataFrame, region: str, tag: int, signal: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Rows of one (region, tag) routed to signal / background / data."""
    s = F.col(roles.sample)
    d = df.where((F.col(roles.region) == region) & (F.col(roles.tag) == tag))
    return d.withColumn("route", F.when(s == DATA_SAMPLE, "data").when(s.contains(signal), "signal")
                        .otherwise("background"))


def write_routes(df: DataFrame, path: str, roles: Roles = DEFAULT_ROLES) -> None:
    """S8 sink: partitioned by region, tag and route."""
    parts = [roles.region, roles.tag, "route"]
    _by_folder(df, parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


# --- S9–S13: result sinks ---------------------------------------------------------------

def write_split_ids(split_df: DataFrame, path: str, id_col: str = "event_key",
                    roles: Roles = DEFAULT_ROLES) -> None:
    """Event ids per split (and mass when present)."""
    parts = [roles.split] + ([roles.mass] if roles.mass in split_df.columns else [])
    _by_folder(split_df.select(id_col, *parts), parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def write_yields(yields: DataFrame, path: str, roles: Roles = DEFAULT_ROLES) -> None:
    """Yield tables per (region, tag) as CSV with header."""
    yields.write.mode("overwrite").option("header", True).partitionBy(roles.region, roles.tag).csv(path)


def read_yields(spark: SparkSession, path: str, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    schema = T.StructType([T.StructField(roles.sample, T.StringType()), T.StructField("entries", T.LongType()),
                           T.StructField(roles.region, T.StringType()), T.StructField(roles.tag, T.IntegerType())])
    return spark.read.schema(schema).option("header", True).csv(path)


EVAL_METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1", "support")])
EVAL_JSON_SCHEMA = T.StructType([
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("weighted_accuracy", T.DoubleType()),
    T.StructField("cm", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("weighted_cm", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("class_report", T.MapType(T.StringType(), EVAL_METRICS)),
    T.StructField("weighted_class_report", T.MapType(T.StringType(), EVAL_METRICS)),
])


def write_evaluation_json(eval_df: DataFrame, path: str) -> None:
    """The nested evaluation report as JSON lines."""
    eval_df.write.mode("overwrite").json(path)


def read_evaluation_json(spark: SparkSession, path: str, keys: Sequence[T.StructField] = ()) -> DataFrame:
    """Read the report back (declared schema) as long rows
    (keys, weighted, class, precision, recall, f1, support)."""
    schema = T.StructType(list(keys) + list(EVAL_JSON_SCHEMA.fields))
    d = spark.read.schema(schema).json(path)
    k = [f.name for f in keys]
    u = d.select(*k, F.lit(False).alias("weighted"), F.explode("class_report").alias("class", "m"))
    w = d.select(*k, F.lit(True).alias("weighted"), F.explode("weighted_class_report").alias("class", "m"))
    return u.unionByName(w).select(*k, "weighted", "class", "m.*")


def write_scores(scores: DataFrame, path: str, key: str, value) -> None:
    """The scores of one combination, in a folder of their own."""
    scores.write.mode("overwrite").parquet(f"{path.rstrip('/')}/part-{key}={value}")


def finished_parts(spark: SparkSession, path: str, key: str) -> list[str]:
    """The folders of a score store whose writes were committed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    found = [str(s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith(f"part-{key}=")]
    return sorted(f for f in found if is_finished(spark, f))


def save_model(model, history: DataFrame | None, path: str) -> None:
    """A fitted Spark ML model and its training history."""
    model.write().overwrite().save(f"{path}/model")
    if history is not None:
        history.write.mode("overwrite").parquet(f"{path}/history")


def load_model(spark: SparkSession, path: str, model_cls):
    """``model_cls`` is the fitted model class, e.g. ``PipelineModel``."""
    model = model_cls.load(f"{path}/model")
    try:
        hist = spark.read.parquet(f"{path}/history")
    except Exception:  # noqa: BLE001 — history is optional
        hist = None
    return model, hist
