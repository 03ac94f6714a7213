"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces of at most ``cap`` tokens. Only the histogram of piece
lengths (at most ``cap`` counts) reaches the driver. There a configuration linear
program is solved: a configuration is a multiset of lengths that fits a
sequence, each length's pieces must be covered, and the number of sequences is
least. Multiplicative weights keep a price per length; a knapsack dynamic
program over the capacity finds the configuration of most value at these
prices; covered lengths get cheaper. The fractional solution is rounded to whole
copies, and what is left is placed best fit, longest first, on counts.

Copies of a configuration take intervals of piece ranks, so every piece finds its
sequence and offset from its rank among pieces of its length. Ranks are counted
per input partition and offset by running totals: no window holds the pieces of
one length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.small import join_checked
from ..session import materialize
from . import bpe, textops

CAP = 1024
END_ID = 2
ROUNDS = 600    # pricing rounds of the linear program
PER_ROUND = 32  # configurations read from one pricing table
STEP = 0.1      # share of a length's uncovered pieces that one configuration may take
RATE = 1.0      # how fast covered lengths get cheaper
SHARES = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)  # of the fractional solution that rounding tries to keep (0: best fit alone)


# --- the program on the length histogram (driver, bounded by cap) -----------------------

def price_table(lengths: np.ndarray, price: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the highest total price within every
    capacity up to ``cap`` and the length (its index) put in last; -1: none."""
    value = np.zeros(cap + 1)
    last = np.full(cap + 1, -1)
    fits = np.searchsorted(lengths, np.arange(cap + 1), "right")
    for c in range(1, cap + 1):
        n = fits[c]
        value[c] = value[c - 1]
        if n:
            v = price[:n] + value[c - lengths[:n]]
            j = int(v.argmax())
            if v[j] > value[c]:
                value[c], last[c] = v[j], j
    return value, last


def read_configuration(lengths: np.ndarray, last: np.ndarray, first: int, cap: int) -> dict[int, int]:
    """The best configuration that holds length ``first``, as index -> copies."""
    out = {first: 1}
    c = cap - int(lengths[first])
    while c > 0:
        j = int(last[c])
        if j < 0:
            c -= 1
        else:
            out[j] = out.get(j, 0) + 1
            c -= int(lengths[j])
    return out


def solve_program(lengths: np.ndarray, counts: np.ndarray, cap: int,
                  rounds: int = ROUNDS) -> list[tuple[float, dict[int, int]]]:
    """``(amount, configuration)`` pairs whose amounts cover the counts, but for
    what the last rounds leave.

    A length's price is its share of the sequence times a weight that falls
    exponentially with the share of its pieces covered so far. Each round prices
    once and takes the best configuration around each of the lengths that lag
    most, in amounts that cover no length twice."""
    left = counts.astype(np.float64)
    amount: dict[tuple, float] = {}
    for _ in range(rounds):
        share = left / counts
        if left @ lengths < 1e-3 * (counts @ lengths) or share.max() < 1e-3:
            break
        price = np.where(share > 1e-6, lengths / cap * np.exp(RATE * (share - 1)), 0.0)
        _, last = price_table(lengths, price, cap)
        for first in np.argsort(-share, kind="stable")[:PER_ROUND].tolist():
            a = read_configuration(lengths, last, first, cap)
            step = STEP * min(left[j] / n for j, n in a.items())
            if step <= 0:
                continue
            key = tuple(sorted(a.items()))
            amount[key] = amount.get(key, 0.0) + step
            for j, n in a.items():
                left[j] = max(0.0, left[j] - n * step)
    return sorted(((x, dict(k)) for k, x in amount.items()), key=lambda t: -t[0])


def round_program(lengths: np.ndarray, counts: np.ndarray, cap: int,
                  program: list[tuple[float, dict[int, int]]], share: float = 1.0) -> list[tuple[int, list[int]]]:
    """``(copies, lengths of a sequence)``: whole copies of the configurations
    (``share`` of their amounts), then best fit, longest first, for the rest. Only
    configurations that fill the sequence are rounded: others waste room that
    best fit can use."""
    left = counts.astype(np.int64).copy()
    out = []
    for x, a in program:
        if sum(int(lengths[j]) * n for j, n in a.items()) < cap:
            continue
        n = min(int(x * share), *(int(left[j]) // k for j, k in a.items()))
        if n > 0:
            for j, k in a.items():
                left[j] -= n * k
            out.append((n, [int(lengths[j]) for j, k in sorted(a.items(), reverse=True) for _ in range(k)]))
    bins: dict[int, list[list]] = {}  # free space -> groups [copies, lengths]
    for j in range(len(lengths) - 1, -1, -1):
        size, todo = int(lengths[j]), int(left[j])
        while todo:
            free = min((f for f in bins if f >= size), default=None)
            if free is None:  # open sequences for the rest, each as full of this length as it gets
                per = cap // size
                whole, rest = divmod(todo, per)
                for n, k in ((whole, per), (1 if rest else 0, rest)):
                    if n:
                        bins.setdefault(cap - k * size, []).append([n, [size] * k])
                break
            group = bins[free][-1]
            n = min(group[0], todo)
            todo -= n
            if n == group[0]:
                bins[free].pop()
                if not bins[free]:
                    del bins[free]
            else:
                group[0] -= n
            bins.setdefault(free - size, []).append([n, group[1] + [size]])
    for groups in bins.values():
        out += [(n, sizes) for n, sizes in groups]
    return out


def plan_sequences(hist: dict[int, int], cap: int) -> dict[int, np.ndarray]:
    """Per length the rows ``(first rank, sequence of that rank, offset)``, ranks
    ascending: the rank's sequence is ``sequence + rank - first rank``."""
    seq = hist.get(cap, 0)
    out: dict[int, list] = {cap: [(0, 0, 0)]}
    lengths = np.array(sorted(x for x in hist if x < cap), np.int64)
    counts = np.array([hist[int(x)] for x in lengths], np.int64)
    if len(lengths):
        taken = dict.fromkeys(lengths.tolist(), 0)
        program = solve_program(lengths, counts, cap)
        tried = [round_program(lengths, counts, cap, program, share) for share in SHARES]
        for n, sizes in min(tried, key=lambda t: sum(n for n, _ in t)):
            at = 0
            for size in sizes:
                out.setdefault(size, []).append((taken[size], seq, at))
                taken[size] += n
                at += size
            seq += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


# --- the Spark job ----------------------------------------------------------------------------

def cut_pieces(n: int, cap: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document of n tokens: full pieces from its end, so
    only the first may be shorter."""
    head = n % cap
    return ([(0, head)] if head else []) + [(a, cap) for a in range(head, n, cap)]


def pack_documents(docs: DataFrame, path: str, cap: int = CAP, end_id: int = END_ID, with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id,
    offset`` (and ``ids`` with ``with_ids``).

    A document is its ids and ``end_id``; null and empty texts have the end only.
    Repeated rows and repeated or null ids are packed like any other rows; an
    empty table gives none; other columns are ignored. Offsets are gapless from 0
    in each sequence; sequences are numbered from 0."""
    vocab = bpe.Vocabulary(path)
    id_type = docs.schema[id_col].dataType
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    fields = [T.StructField("id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())] + extra

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.WordCoder(vocab)
        part, seen = TaskContext.get().partitionId(), np.zeros(cap + 1, np.int64)
        end = np.array([end_id], np.uint32)
        names = [f.name for f in fields] + ["part", "place"]

        def batch(col: pa.Array, rows: list) -> pa.RecordBatch:
            r, piece, start, length, crc, place, ids = zip(*rows)
            cols = [col.take(pa.array(r, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols + [pa.array([part] * len(r), pa.int32()), pa.array(place, pa.int64())],
                                              names=names)

        for b in batches:
            rows = []
            for i, ids in coder.rows(b.column(0), b.column(1)):
                ids = np.concatenate([ids, end]).astype("<u4")
                for k, (a, n) in enumerate(cut_pieces(len(ids), cap)):
                    own = ids[a:a + n]
                    rows.append((i, k, a, n, zlib.crc32(own.tobytes()), int(seen[n]), own if with_ids else None))
                    seen[n] += 1
                if len(rows) > 20000:
                    yield batch(b.column(0), rows)
                    rows = []
            if rows:
                yield batch(b.column(0), rows)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = materialize(src.mapInArrow(textops.returning_memory(pieces), T.StructType(
        fields + [T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])))
    counts = materialize(cut.groupBy("part", "length").count())
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(counts.select("part", "length", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before")))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_sequences(hist, cap)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(fields)
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(at).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                m, p = length == n, plan[int(n)]
                j = np.searchsorted(p[:, 0], rank[m], "right") - 1
                seq[m], off[m] = p[j, 1] + rank[m] - p[j, 0], p[j, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(seq), pa.array(off)],
                                             names=[f.name for f in fields] + ["sequence_id", "offset"])

    ranked = join_checked(cut, before, ["part", "length"]).select(
        *[f.name for f in fields], (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(textops.returning_memory(place), T.StructType(fields + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])).withColumnRenamed("id", id_col)
