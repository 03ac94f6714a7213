"""The row-wise operators on a file stream.

The reference only reads closed files, so no stateful streaming operator is
claimed. The selection and labelling operators are plain Catalyst
expressions, so the same code runs incrementally on new event files: a
``readStream`` with a declared schema, the stateless transformations, and a
Parquet sink whose progress lives in the shared checkpoint folder (so a
restarted query resumes where it stopped, exactly once). Yields can be kept
up to date with a streaming aggregation (state per key, update mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import label_regex, predict_class
from ..operators.select import drop_twodim
from ..schema import DEFAULT_ROLES, Roles
from ..session import scratch_path


def read_event_stream(spark: SparkSession, folder: str, schema: T.StructType,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def label_stream(stream: DataFrame, signal: str, th: float | None = None, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """P5 → L1 (→ L7): the same expressions as the batch operators."""
    d = drop_twodim(stream, roles).withColumn(roles.label, label_regex(roles.sample, signal))
    if th is not None:
        d = d.withColumn("prediction", predict_class(roles.score, th))
    return d


def write_stream(df: DataFrame, sink: str, name: str, available_now: bool = True):
    """Parquet sink; progress in the shared checkpoint folder."""
    ckpt = scratch_path(df.sparkSession, f"stream-{name}")
    w = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def running_yields(stream: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """A7/A8 kept current: entries and Σweight per (region, tag, sample)
    (streaming aggregation, state bounded by the number of keys)."""
    return stream.groupBy(roles.region, roles.tag, roles.sample).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(roles.weight).alias("yield"))


def write_yields_stream(df: DataFrame, name: str, table: str):
    """Update-mode sink into an in-process table (for inspection in tests)."""
    ckpt = scratch_path(df.sparkSession, f"stream-{name}")
    return (df.writeStream.outputMode("complete").format("memory").queryName(table)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
