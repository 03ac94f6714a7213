"""Corpus pipeline over ``documents``: quality classifier, near-duplicate removal,
secret redaction, best-fit packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), where
``docs`` is what the stage before it kept, and returns a DataFrame with the
columns of documents (the last one: the packed pieces). ``run`` writes each
stage's result as Parquet in the shared checkpoint folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evweave.llm import stages
from evweave.session import materialize, release, scratch

STAGES = [
    ("quality_classifier", stages.quality),
    ("minhash_near_dedup", stages.near_dedup),
    ("secret_scans", stages.redact_secrets),
    ("best_fit_packing", stages.pack),
]

#: Trained weights, MinHash and tokenizer ids have no SQL form; the tests hold
#: every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages. A stage's own tables go
    when its result is stored, that result when the next stage's is."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        with scratch(spark) as tables:
            kept = tables.keep(materialize(stage(spark, docs, sf_dir)))
        release(docs)
        docs = kept
    return docs
