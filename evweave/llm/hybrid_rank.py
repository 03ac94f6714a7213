"""Ranked lexical search, hybrid of term-at-a-time and document-at-a-time.

Statistics first: one scan counts the documents and terms of the whole table and the
documents that hold each query term. A second scan ranks. A task cuts its texts
into segments and builds each segment's posting lists of the query terms. For a
query, the short lists are read term at a time into summed accumulators; the
accumulators, in document order, are then one more iterator with a bound (their
largest sum) beside the long lists, each with the bound of its largest entry. Document
at a time, in chunks, only documents of essential iterators are looked at: those
whose bounds can still reach the k-th score known so far; the other lists are
skipped to these documents. The k-th score lives on from segment to segment of a task.

Per task and query at most k rows leave; Spark keeps the k best of them. Queries come
in blocks of counted terms, so what a task holds of them is bounded whatever
their number. No posting list is shuffled: a term that every document holds costs
one count per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import textops

BLOCK_TERMS = 1 << 18    # distinct (query, term) entries of a block of queries
SEGMENT_BYTES = 1 << 23  # text of a segment
SHORT_SHARE = 0.25       # accumulators are made from the shortest lists with this share of a query's postings
CHUNK = 512              # documents looked at between two updates of the bounds
GAIN, K1, LENGTH_SHARE = 1_000_000_000, 1000, 75


def term_hasher() -> textops.Hasher:
    """Hashes of terms: runs of ASCII letters and digits and all characters beyond ASCII, only A-Z lower-cased."""
    h = textops.Hasher()
    h.sep = np.ones(256, bool)
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        h.sep[a:b] = False
    return h


def terms_of(hasher: textops.Hasher, col: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, term hashes, first term of each row)`` for slices of a text column."""
    for i, j, raw, off in textops.text_slices(col):
        h, first = hasher.word_hashes(raw, off)
        yield i, j, len(raw), h, first


# --- one segment -----------------------------------------------------------------------------

class Segment:
    """Posting lists of some documents, restricted to a sorted vocabulary."""

    def __init__(self, vocab: np.ndarray, hashes: np.ndarray, first: np.ndarray, m: np.ndarray):
        """Documents d hold the terms ``hashes[first[d]:first[d + 1]]``; ``m``: their length factors."""
        n_docs = len(first) - 1
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        at = np.searchsorted(vocab, hashes)
        hit = vocab[np.minimum(at, len(vocab) - 1)] == hashes if len(vocab) else np.zeros(len(hashes), bool)
        pair, tf = np.unique(at[hit] * np.int64(n_docs) + doc[hit], return_counts=True)
        term, self.doc = np.divmod(pair, n_docs) if n_docs else (pair, pair)
        self.impact = (GAIN * tf) // (K1 * tf + 8 * m[self.doc]) if n_docs else tf
        self.start = np.searchsorted(term, np.arange(len(vocab) + 1))
        self.n_docs = n_docs

    def lists(self, terms: np.ndarray, factor: np.ndarray):
        """``(documents, scores)`` of each term that occurs, shortest list first."""
        out = [(self.doc[a:b], f * self.impact[a:b]) for a, b, f in
               zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), factor.tolist()) if b > a and f > 0]
        return sorted(out, key=lambda x: len(x[0]))


def accumulate(lists: list, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the documents of the lists, ascending, and their summed scores."""
    total = np.zeros(n_docs, np.int64)
    for doc, score in lists:
        total[doc] += score
    doc = np.flatnonzero(total)
    return doc, total[doc]


def best_of(lists: list, n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(documents, scores, documents looked at)``: every document of the segment whose score is among
    its k highest and at least ``floor`` (ties at the k-th score all stay), by hybrid search."""
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    sizes = np.cumsum([len(d) for d, _ in lists])
    n_short = max(1, int(np.searchsorted(sizes, SHORT_SHARE * sizes[-1], "right")))
    acc = accumulate(lists[:n_short], n_docs)
    its = [acc, *lists[n_short:]]
    if len(acc[1]) >= k:  # a sum of some terms bounds the whole score from below
        floor = max(floor, int(np.partition(acc[1], len(acc[1]) - k)[len(acc[1]) - k]))
    its.sort(key=lambda x: int(x[1].max()))
    bound = np.cumsum([int(s.max()) for _, s in its])  # of the documents only in iterators up to here
    got_d, got_s = np.zeros(0, np.int64), np.zeros(0, np.int64)
    looked, at = 0, 0
    while at < n_docs:
        skip = int(np.searchsorted(bound, floor, "left"))  # these iterators alone stay below the floor
        if skip == len(its):
            break
        # the next documents of the essential iterators, in order
        ahead = []
        for d, _ in its[skip:]:
            a = int(np.searchsorted(d, at))
            ahead.append(d[a:a + CHUNK])
        full = [x[-1] for x in ahead if len(x) == CHUNK]
        stop = int(min(full)) + 1 if full else n_docs
        doc = np.unique(np.concatenate(ahead))
        doc = doc[doc < stop]
        score = np.zeros(len(doc), np.int64)
        looked += len(doc)
        for i in range(len(its) - 1, -1, -1):
            if i < skip:  # drop those that the rest cannot lift to the floor
                able = score + bound[i] >= floor
                doc, score = doc[able], score[able]
            if not len(doc):
                break
            d, s = its[i]
            p = np.minimum(np.searchsorted(d, doc), len(d) - 1)
            score += np.where(d[p] == doc, s[p], 0)
        keep = score >= floor
        got_d, got_s = np.concatenate([got_d, doc[keep]]), np.concatenate([got_s, score[keep]])
        if len(got_s) >= k:
            floor = max(floor, int(np.partition(got_s, len(got_s) - k)[len(got_s) - k]))
            keep = got_s >= floor
            got_d, got_s = got_d[keep], got_s[keep]
        at = stop
    return got_d, got_s, looked


# --- the Spark job ------------------------------------------------------------------------------

def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored rows ``q, id, term, times`` of every item with a term; ``q`` numbers the items' rows."""
    id_type = items.schema[id_col].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = term_hasher()
        for b in batches:
            for i, j, _, h, first in terms_of(hasher, b.column(2)):
                for r in range(i, j):
                    u, n = np.unique(h[first[r - i]:first[r - i + 1]].view(np.int64), return_counts=True)
                    if len(u):
                        at = pa.array(np.full(len(u), r))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(u), pa.array(n)],
                                                         names=["q", "id", "term", "times"])

    return materialize(items.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("id"),
                                    F.col(text_col).cast("string").alias("text")).mapInArrow(split, T.StructType([
        T.StructField("q", T.LongType()), T.StructField("id", id_type), T.StructField("term", T.LongType()),
        T.StructField("times", T.LongType())])))


def corpus_counts(src: DataFrame, vocab: np.ndarray) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all terms, and the documents that hold each query term (by hash)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, n, total, df = term_hasher(), 0, 0, np.zeros(len(vocab), np.int64)
        for b in batches:
            for _, _, _, h, first in terms_of(hasher, b.column(0)):
                n += int((np.diff(first) > 0).sum())
                total += len(h)
                one = Segment(vocab, h, first, np.zeros(len(first) - 1, np.int64)) if len(vocab) else None
                if one is not None:
                    df += np.diff(one.start)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(vocab[held].view(np.int64), 0)), pa.array(np.append(df[held], 0)),
                                          pa.array([False] * len(held) + [True]), pa.array([0] * len(held) + [n]),
                                          pa.array([0] * len(held) + [total])], names=["term", "df", "all", "n", "total"])

    got = src.select("text").mapInArrow(textops.returning_memory(count), "term long, df long, all boolean, n long, total long")
    rows = got.groupBy("all", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    every, term, held, n, total = (rows.column(c).to_numpy() for c in ("all", "term", "df", "n", "total"))
    return int(n[every].sum()), int(total[every].sum()), dict(zip(term[~every].tolist(), held[~every].tolist()))


def term_weight(n: int, df: int) -> int:
    """floor(1000 ln((2N+2)/(2df+1))), in doubles."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows ``item_col, rank, id_col, score``: the k documents of highest score for each item, equal scores by
    ascending id (null ids last), whatever its score above 0 (fewer documents: all of them).

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document's m is 25 + (75 n N) div L; it scores the
    sum over the item's terms, repeats included, of weight * ((10^9 tf) div (1000 tf + 8 m)). Null and empty
    texts have no terms: such items get no rows, such documents are not counted. Items and documents that
    repeat are items and documents each; columns of other names are ignored; empty tables give no rows. Texts
    are whole however long. Terms are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    out_type = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = query_terms(items, item_col, item_text)
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "term", "times").toArrow()
        if not rows.num_rows and block:
            continue
        q, term, times = (rows.column(c).to_numpy() for c in ("q", "term", "times"))
        vocab = np.unique(term.view(np.uint64))
        n, total, df = corpus_counts(src, vocab)
        if not total:
            break
        of = np.array([term_weight(n, df[t]) if t in df else 0 for t in vocab.view(np.int64).tolist()], np.int64)
        order = np.lexsort((term, q))
        q, at, factor = q[order], np.searchsorted(vocab, term[order].view(np.uint64)), times[order]
        factor = factor * of[at]
        found.append(materialize(src.mapInArrow(textops.returning_memory(
            _ranker(vocab, q, at, factor, n, total, k)), out_type)))
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField(item_col, item_type), T.StructField("rank", T.IntegerType()),
                                                       T.StructField(id_col, id_type), T.StructField("score", T.LongType())]))
    best = found[0]
    for f in found[1:]:
        best = best.unionByName(f)
    # a task sent at most k rows of a query and its ties; the row number keeps k of them before and after the shuffle
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = asked.select("q", F.col("id").alias("item")).distinct()
    return top.join(names, "q").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"),
                                       F.col("id").alias(id_col), "score")


def _ranker(vocab: np.ndarray, q: np.ndarray, term: np.ndarray, factor: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The batch function of the ranking scan."""
    numbers, starts = np.unique(q, return_index=True)
    ends = np.append(starts[1:], len(q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = term_hasher()
        kept: list = [None] * len(numbers)   # per query: ids (Arrow), scores
        floor = np.ones(len(numbers), np.int64)

        def search(ids: list, hashes: list, sizes: list) -> None:
            size = np.concatenate(sizes)
            first = np.concatenate([[0], np.cumsum(size)])
            m = 100 - LENGTH_SHARE + np.array([LENGTH_SHARE * s * n_docs // n_terms for s in size.tolist()], np.int64)
            seg = Segment(vocab, np.concatenate(hashes), first, m)
            every = pa.concat_arrays(ids)
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                doc, score, _ = best_of(seg.lists(term[a:b], factor[a:b]), seg.n_docs, k, int(floor[i]))
                if not len(doc):
                    continue
                own = every.take(pa.array(doc))
                if kept[i] is not None:
                    own, score = pa.concat_arrays([kept[i][0], own]), np.concatenate([kept[i][1], score])
                if len(score) > k:  # ties at the end go by id
                    order = pc.sort_indices(pa.table({"s": score, "id": own}), sort_keys=[("s", "descending"), ("id", "ascending")])
                    order = order.slice(0, k)
                    own, score = own.take(order), score[order.to_numpy()]
                    floor[i] = score[-1]
                kept[i] = own, score

        ids, hashes, sizes, held = [], [], [], 0
        for b in batches:
            for i, j, size, h, first in terms_of(hasher, b.column(1)):
                ids.append(b.column(0).slice(i, j - i))
                hashes.append(h)
                sizes.append(np.diff(first))
                held += size
                if held >= SEGMENT_BYTES:
                    search(ids, hashes, sizes)
                    ids, hashes, sizes, held = [], [], [], 0
        if ids:
            search(ids, hashes, sizes)
        for i in range(0, len(numbers), 1024):
            part = [(int(numbers[i + x]), *v) for x, v in enumerate(kept[i:i + 1024]) if v is not None]
            if part:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([p[0] for p in part], [len(p[2]) for p in part])),
                    pa.concat_arrays([p[1] for p in part]), pa.array(np.concatenate([p[2] for p in part]))],
                    names=["q", "id", "score"])

    return run
