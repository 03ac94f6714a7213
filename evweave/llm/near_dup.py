"""MinHash near-duplicates with odd sketches.

1. One scan turns every text into its set of 5-word shingles (64-bit hashes):
   size, a 128-bit digest of the set, and the hashes of 32 bands of 4 MinHash
   values. Documents with equal digests are one class; all later work is on
   classes.
2. Classes that share a band bucket are candidates. For those only, a second
   scan keeps the set and an odd sketch: 2048 MinHash samples folded into a
   parity bitmap, so that the bits in which two sketches differ estimate the
   similarity with a deviation of 0.0098 at 0.75.
3. Each bucket's members are first compared with the bucket's smallest class:
   sketch, then exact intersection of the full sets. The verified links give
   components.
4. What can still join components are pairs of one bucket in different
   components. Large buckets are cut into blocks of about ``BLOCK`` members, those
   of the bucket's largest component apart from the others; blocks of others meet
   all blocks. Pairs are compared by sketch inside a task in the first band they
   share, only the few that pass leave it and are confirmed on the full sets.

A pair at the threshold misses all bands with probability 5e-6 and the sketch
test with 4e-6; more similar pairs far less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.small import join_checked
from ..session import materialize, release
from . import textops
from .components import connected_components

WORDS = 5
BANDS, ROWS = 32, 4
SAMPLES, BITS = 2048, 8192
SKETCH_LEAST = 0.707  # 0.75 less 4.4 deviations of the estimate
NUM, DEN = 75, 100   # similarity threshold as a fraction
BLOCK = 512
SEED = 20240


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(hasher: textops.Hasher, col: pa.Array, width: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first row, sorted distinct shingle hashes of each row)`` per slice."""
    # unrelated odd factors: two orders of the same words must not add up alike
    mult = list(textops.mix64(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1))
    for i, _, raw, off in textops.text_slices(col):
        h, first = hasher.word_hashes(raw, off)
        if len(h) >= width:
            sh = h[:len(h) - width + 1] * mult[0]
            for m in range(1, width):
                sh = sh + h[m:len(h) - width + 1 + m] * mult[m]
            sh = textops.mix64(sh)
        out = []
        for a, b in zip(first.tolist(), first[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(sh[a:b - width + 1]))
            elif b > a:  # fewer words: the whole sequence is the one shingle
                one = (h[a:b] * np.array(mult[:b - a], np.uint64)).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(textops.mix64(np.array([one], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield i, out


def min_hashes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values (samples x sets) of non-empty sets."""
    x = np.concatenate(sets)
    x = (x >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out, buf = np.empty((len(a), len(sets)), np.uint32), np.empty_like(x)
    for i in range(len(a)):
        np.multiply(x, a[i], out=buf)
        buf += b[i]
        np.minimum.reduceat(buf, at, out=out[i])
    return out


def band_hashes(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per set and band (sets x bands)."""
    v = np.ascontiguousarray(values.T).reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        h = textops.mix64(h + v[:, :, r])
    return h.view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Parity bitmaps (sets x BITS/64 words): each sample flips the bit it hashes to."""
    n = values.shape[1]
    place = textops.mix64(values.astype(np.uint64) + (np.arange(1, len(values) + 1, dtype=np.uint64) << np.uint64(32))[:, None])
    place = (place % np.uint64(BITS)).astype(np.int64) + (np.arange(n) * BITS)[None, :]
    odd = (np.bincount(place.ravel(), minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, BITS), axis=1).view(np.uint64)


def max_differing() -> int:
    """Differing bits of two sketches whose estimated similarity is SKETCH_LEAST."""
    flips = 2 * SAMPLES * (1 - SKETCH_LEAST)
    return int(BITS / 2 * (1 - np.exp(-2 * flips / BITS)))


def _binary(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in m], pa.binary())


def signatures(docs: DataFrame) -> DataFrame:
    """``id, n, key, bands`` per row of (id, text); no key or bands without words."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()),
                           T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    a, b = _permutations(BANDS * ROWS, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        hasher = textops.Hasher()
        for batch in batches:
            for i, sets in shingle_sets(hasher, batch.column(1)):
                full = [s for s in sets if len(s)]
                bands = band_hashes(min_hashes(full, a, b)) if full else np.zeros((0, BANDS), np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                ends = np.cumsum(np.where(n > 0, BANDS, 0))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, len(sets)), pa.array(n),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(bands.ravel()))],
                    names=["id", "n", "key", "bands"])

    return docs.mapInArrow(textops.returning_memory(run), schema)


def class_key(text: Column) -> Column:
    """The digest of a text's shingle set; null without words."""
    @F.pandas_udf("binary")
    def key(col: pd.Series) -> pd.Series:
        import hashlib
        hasher, out = textops.Hasher(), []
        for _, sets in shingle_sets(hasher, pa.array(col, pa.string())):
            out += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pd.Series(out, dtype=object)

    return key(text)


def candidate_sets(docs: DataFrame) -> DataFrame:
    """``key, n, sketch, shingles`` per row of (id, text) with words."""
    a, b = _permutations(SAMPLES, SEED + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        hasher = textops.Hasher()
        for batch in batches:
            for _, sets in shingle_sets(hasher, batch.column(1)):
                sets = [s for s in sets if len(s)]
                for k in range(0, len(sets), 256):
                    some = sets[k:k + 256]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in some], pa.binary()),
                        pa.array([len(s) for s in some], pa.int64()), _binary(odd_sketches(min_hashes(some, a, b))),
                        pa.array([s.tobytes() for s in some], pa.binary())], names=["key", "n", "sketch", "shingles"])

    return docs.mapInArrow(textops.returning_memory(run), "key binary, n long, sketch binary, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of class keys whose full sets reach the threshold."""
    one = join_checked(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), pairs, ["a"])
    two = join_checked(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), pairs, ["b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(DEN * common >= NUM * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(t.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return one.join(two, ["a", "b"]).select("a", "b", "sa", "sb").mapInArrow(textops.returning_memory(run), "a binary, b binary")


def _sketch_pairs(most: int):
    """Pairs of one bucket block pair in different components that may be similar."""
    def near(t: pa.Table) -> pa.Table:
        n = t.num_rows
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
        bands = t.column("bands").combine_chunks().values.to_numpy().reshape(n, BANDS)
        size, band = t.column("n").to_numpy(), t.column("band").to_numpy()
        bh, blk = t.column("bh").to_numpy(), t.column("block").to_numpy()
        i_blk, j_blk = t.column("i").to_numpy(), t.column("j").to_numpy()
        comp = np.unique(np.array(t.column("root").to_pylist(), object), return_inverse=True)[1]
        order = np.argsort(bh, kind="stable")
        cuts = np.flatnonzero(np.diff(bh[order])) + 1
        out_a, out_b = [], []
        for rows in np.split(order, cuts) if n else []:
            left = rows[blk[rows] == i_blk[rows]]
            right = rows[blk[rows] == j_blk[rows]]
            for k in range(0, len(left), BLOCK):
                x = left[k:k + BLOCK]
                ok = comp[x][:, None] != comp[right][None, :]
                lo = np.minimum(size[x][:, None], size[right][None, :])
                ok &= DEN * lo >= NUM * np.maximum(size[x][:, None], size[right][None, :])
                p, q = np.nonzero(ok)
                p, q = x[p], right[q]
                if i_blk[rows[0]] == j_blk[rows[0]]:
                    p, q = p[p < q], q[p < q]
                for m in range(0, len(p), 1 << 12):
                    a, b = p[m:m + (1 << 12)], q[m:m + (1 << 12)]
                    diff = np.bitwise_count(sk[a] ^ sk[b]).sum(1, dtype=np.int64)
                    a, b = a[diff <= most], b[diff <= most]
                    first = (bands[a] == bands[b]).argmax(1) == band[a]  # each pair once
                    out_a.append(a[first])
                    out_b.append(b[first])
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        keys = t.column("key")
        return pa.table({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b))})

    return near


def block_pairs(rooted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, bh, root, block, i, j, g, small``: every row of (key, bh, root) whose
    bucket holds several roots, once per block pair (i, j), i <= j, that holds the
    row's block. Pairs within the bucket's largest root are not needed: its blocks
    0 .. nm - 1 meet only the blocks nm .. nm + no - 1 of all other members. A bucket
    of one block is not parted (nm = 0). Second: the stored table of the buckets."""
    parts = rooted.groupBy("bh", "root").agg(F.count("*").alias("c")).groupBy("bh").agg(
        F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.count("*").alias("roots")).where("roots > 1")
    one = F.col("c") <= BLOCK
    open_ = materialize(parts.select(
        "bh", F.col("top.root").alias("main"),
        F.when(one, 0).otherwise(F.ceil(F.col("top.c") / BLOCK)).cast("int").alias("nm"),
        F.when(one, 1).otherwise(F.ceil((F.col("c") - F.col("top.c")) / BLOCK)).cast("int").alias("no")))
    total = open_.agg(F.sum((F.col("nm") + F.col("no")).cast("long"))).first()[0] or 0
    groups = int(max(16, total // 256))
    h, inner = F.xxhash64("key"), (F.col("nm") > 0) & (F.col("root") == F.col("main"))
    wide = join_checked(rooted, open_, ["bh"]).withColumn("block", F.when(
        inner, F.pmod(h, F.greatest("nm", F.lit(1)))).otherwise(F.col("nm") + F.pmod(h, F.col("no"))).cast("int"))
    meets = F.sequence(F.when(inner, F.col("nm")).otherwise(0), F.col("nm") + F.col("no") - 1)
    wide = wide.withColumn("ij", F.explode(F.transform(meets, lambda k: F.struct(
        F.least(k, F.col("block")).cast("int").alias("i"), F.greatest(k, F.col("block")).cast("int").alias("j")))))
    small = F.col("nm") == 0
    return wide.select(
        "key", "bh", "root", "block", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"),
        F.when(small, F.pmod("bh", F.lit(groups))).otherwise(F.xxhash64("bh", "ij.i", "ij.j")).alias("g"), small.alias("small")), open_


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept, class_key, group_key``.

    Texts are near-duplicates if their shingle sets have a similarity of at least
    0.75; a component is what such links connect, its id the smallest document id
    in it. Null, empty and blank texts have no shingles and are linked with
    nothing. A row with a null id is linked with nothing and has a null component
    and ``kept``. Rows repeating an id are rows like others: the same text is the
    same class, another text of that id is linked only by its own similarity. So
    two components can have one smallest id; ``group_key`` (a class of the component)
    tells them apart. An empty table gives no rows; other columns are ignored."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = materialize(signatures(src))
    usable = sig.where(F.col("key").isNotNull() & F.col("id").isNotNull())
    classes = materialize(usable.groupBy("key").agg(F.min("id").alias("rep")))
    # band buckets of one row per class; a bucket's hash also tells its band
    reps = join_checked(usable.select("id", "key", "n", "bands"), classes, ["key"]).where(F.col("id") == F.col("rep"))
    spread = reps.select("key", F.explode("bands").alias("bh"))
    shared = materialize(spread.groupBy("bh").agg(F.count("*").alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi"))
                         .where(F.col("lo") < F.col("hi")).select("bh", F.col("lo").alias("leader")))
    members = materialize(join_checked(spread, shared, ["bh"]).distinct())
    nodes = materialize(members.select("key").distinct())
    # sets and sketches of the candidate classes, one row per class
    wanted = materialize(join_checked(classes, nodes, ["key"]).select(F.col("rep").alias("id")).distinct())
    found = candidate_sets(join_checked(src, wanted, ["id"]))
    sets = materialize(join_checked(found, nodes, ["key"]).groupBy("key").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("shingles").alias("shingles")))

    # links with each bucket's smallest class
    sketch = sets.select("key", "sketch")
    star = members.where(F.col("key") != F.col("leader")).select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    most = max_differing()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64).reshape(t.num_rows, -1) for c in (2, 3))
                ok = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most
                yield pa.RecordBatch.from_arrays(t.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    star = star.join(sketch.select(F.col("key").alias("a"), F.col("sketch").alias("x")), "a").join(
        sketch.select(F.col("key").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")
    star = materialize(star.mapInArrow(textops.returning_memory(close), "a binary, b binary"))
    first = connected_components(confirm(star, sets))

    # pairs of one bucket across components
    rooted = members.join(first.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "bh", F.coalesce("root", "key").alias("root"))
    rooted = materialize(rooted)
    wide, open_ = block_pairs(rooted)
    info = reps.select("key", "bands").dropDuplicates(["key"]).join(sets.select("key", "n", "sketch"), "key")
    wide = wide.join(info, "key").withColumn("band", (F.array_position("bands", F.col("bh")) - 1).cast("int"))
    cross = materialize(wide.groupBy("small", "g").applyInArrow(_sketch_pairs(most), "a binary, b binary"))
    links = confirm(cross, sets)

    # both rounds' links together
    root_of = first.select(F.col("node").alias("x"), "root")
    up = links.join(root_of.withColumnsRenamed({"x": "a", "root": "ra"}), "a", "left").join(
        root_of.withColumnsRenamed({"x": "b", "root": "rb"}), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    second = connected_components(up).select(F.col("node").alias("root"), F.col("root").alias("top"))
    tops = materialize(nodes.join(first.withColumnRenamed("node", "key"), "key", "left").select(
        "key", F.coalesce("root", "key").alias("root")).join(second, "root", "left").select(
        "key", F.coalesce("top", "root").alias("top")))
    # stored, so that the join below has a shuffle of its own, which is split where one group is large
    smallest = materialize(classes.join(tops, "key").groupBy("top").agg(F.min("rep").alias("component")))
    linked = tops.join(smallest, "top").select("key", "component", "top")
    labels = materialize(classes.join(linked, "key", "left").select(
        "key", F.coalesce("component", "rep").alias("component"), F.coalesce("top", "key").alias("top")))
    release(star, cross, rooted, open_, sets, members, tops, smallest)
    out = sig.join(labels, "key", "left").select("id", "n", "key", F.when(
        F.col("id").isNull(), F.lit(None)).when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"),
        F.when(F.col("id").isNotNull(), F.col("top")).alias("top"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      (F.col("id") == F.col("component")).alias("kept"), F.col("key").alias("class_key"),
                      F.col("top").alias("group_key"))
