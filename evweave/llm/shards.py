"""Sharding by extendible hashing.

Every row gets a 60-bit hash. A bucket is a hash prefix; a bucket over the byte
limit splits on its next bit, all others stay as they are, so each row lands in
the shortest prefix whose rows fit the limit together. The directory maps
prefixes to buckets.

Spark form: rows are reduced once to (id, hash, bytes). Splitting goes on in
strides of ``STRIDE`` bits: one map-side combined sum per fine prefix of the
still oversized buckets, the depths inside the stride follow from that small
directory table, and rows join it on the fine prefix. Text never moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.small import join_checked
from ..session import materialize

BITS = 60
STRIDE = 12
MAX_DIRECTORY_BROADCAST = 500_000  # directory rows of four longs: 16 MB


def row_hash(key_cols: Sequence[str], text_col: str) -> Column:
    """60 bits of md5 over the key columns and the text's digest. The digest
    keeps rows that share a key from sharing a hash, so a hot key still splits."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    h = F.md5(F.concat_ws("\x1f", *parts, F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.conv(F.substring(h, 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright("h", BITS - depth)


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text",
                  key_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, shard, depth, shard_bytes, fits``.

    ``shard`` is the bucket's prefix as a bit string of ``depth`` bits (empty:
    the only bucket). Null ids and null texts are hashed as empty strings; a null
    text has no bytes. An empty table gives no rows. Repeated rows share a hash
    and so a shard. A bucket whose rows all have one hash cannot split further:
    it stays at the first depth that isolates it, and ``fits`` is false if it is
    over the limit (a single text longer than the limit, or that many repeats of
    one row). Other columns of ``docs`` are ignored."""
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    rows = materialize(docs.select(F.col(id_col), row_hash(key_cols, text_col).alias("h"),
                                   F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")))
    done, left, depth = [], rows, 0
    while True:
        fine = min(depth + STRIDE, BITS)
        # one row per fine prefix of the oversized buckets: sums only
        cells = left.groupBy(_prefix(fine).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        first = depth + 1 if depth else 0
        by_depth = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(fine)))) \
            .withColumn("bucket", F.expr(f"shiftright(cell, {fine} - depth)"))
        fits = by_depth.groupBy("depth", "bucket").agg(
            F.sum("b").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ).where((F.col("shard_bytes") <= limit_bytes) | (F.col("lo") == F.col("hi"))).select(
            "depth", "bucket", "shard_bytes")
        directory = materialize(by_depth.join(fits, ["depth", "bucket"]).groupBy("cell").agg(
            F.min_by(F.struct("depth", "bucket", "shard_bytes"), F.col("depth")).alias("at")))
        keyed = left.withColumn("cell", _prefix(fine))
        j = join_checked(keyed, directory, ["cell"], "left", MAX_DIRECTORY_BROADCAST)
        done.append(j.where(F.col("at").isNotNull()).select(
            F.col(id_col), "n_bytes",
            F.when(F.col("at.depth") == 0, F.lit("")).otherwise(
                F.lpad(F.conv(F.col("at.bucket").cast("string"), 10, 2), F.col("at.depth"), F.lit("0"))).alias("shard"),
            F.col("at.depth").alias("depth"), F.col("at.shard_bytes").alias("shard_bytes"),
            (F.col("at.shard_bytes") <= limit_bytes).alias("fits")))
        rest = j.where(F.col("at").isNull()).select(F.col(id_col), "h", "n_bytes")
        if fine == BITS or rest.isEmpty():
            break
        left, depth = materialize(rest), fine
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows as Parquet under ``path/shard=<bits>``, one writing task
    per shard (each within the byte limit). Ids must be unique."""
    (docs.join(shards.select(id_col, "shard"), id_col)
     .withColumn("shard", F.concat(F.lit("b"), F.col("shard")))
     .repartition("shard").write.partitionBy("shard").parquet(path))
