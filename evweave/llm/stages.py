"""Stages of the corpus pipeline: each calls one operator and acts on its decision.

All but the last return the columns of the documents they get, in that order.
Other columns than ``doc_id`` and ``text`` are carried along under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.small import join_checked
from ..session import materialize
from . import nbsvm, near_dup, packing, secrets
from .queries import byte_bpe


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labels' learning fold) rejects go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return nbsvm.keep_quality(docs, nbsvm.fit_quality(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Rows with a null id or without words are in no group and stay. Of rows that
    repeat the kept id with texts of the group one stays (equal or near copies alike:
    one with the smallest class); a kept id's row with a text outside the group is a
    document of its own."""
    found = near_dup.near_duplicates(docs.select("doc_id", "text")).where(
        F.col("component_id").isNotNull() & F.col("class_key").isNotNull())
    by_id = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("any_kept")))
    once = materialize(by_id.where((F.col("n") == 1) & F.col("any_kept")).select("doc_id"))
    more = materialize(by_id.where((F.col("n") > 1) & F.col("any_kept")).select("doc_id"))
    grouped = docs.where(F.col("doc_id").isNotNull() & _has_words())
    out = docs.where(F.col("doc_id").isNull() | ~_has_words()).unionByName(
        join_checked(grouped, once, ["doc_id"], "left_semi"))
    if more.isEmpty():
        return out
    # rows that repeat an id are told apart by their text's class
    key = _free(docs, "class_key")
    kept = materialize(found.where("kept").join(more, "doc_id", "left_semi").groupBy("doc_id", "group_key").agg(
        F.min("class_key").alias(key)).select("doc_id", key))
    rows = join_checked(grouped, more, ["doc_id"], "left_semi").withColumn(key, near_dup.class_key(F.col("text")))
    rows = join_checked(rows, kept, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return out.unionByName(rows.select(*docs.columns))


def _has_words():
    return F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every base and entropy span is replaced by a mask; all documents stay."""
    base, spans = _free(docs, "base_spans"), _free(docs, "secret_spans")
    d = secrets.with_spans(docs, "text", base, spans)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col(spans)))
    d = d.withColumn("text", text)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, byte_bpe())
