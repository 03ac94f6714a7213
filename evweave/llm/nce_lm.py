"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Outputs are the end token, the ``CORE`` most frequent words and ``CLASSES`` ending
classes for all other words; inside a class a word has its smoothed share of the
class's training tokens (and the unseen words of the class have one). A context
is the last output and, of the one before it, whether it is one of the most
frequent. The model predicts output w after context (u, v) with

    P(w | u, v) = exp(q_w . (r_u + t_v) + b_w) / Z(u, v).

Training runs over all training texts, not over a sample: each task makes
stochastic steps on its own texts from the common parameters (targets against
noise words drawn from the unigram distribution, whole batches as matrix
products), and the tasks' parameters are averaged, ``ROUNDS`` times over disjoint
parts of the texts. Z of every context is then computed exactly by batched matrix
products over all outputs, so token probabilities are normalised.

Counts of words are exact. The most frequent ``HEAD`` words travel to tasks as
sorted arrays (8 MB); rarer words join the count table, once per text and word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, release
from . import textops

CORE = 3584
CLASSES = 511
OUT = 1 + CORE + CLASSES   # output 0 is the end token
START = OUT                # context before a text's first token
FAR = 64                   # the second context: most frequent outputs, other, start
DIM = 32
HEAD = 1 << 19
NOISE = 64    # noise words of a batch; each meets all of its contexts, so batches are short
BATCH = 1024
ROUNDS = 2
RATE = 0.1
FAN = 64       # models averaged by one task
SEED = 11


# --- words ------------------------------------------------------------------------

def word_classes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Ending class of each word: hash of its last two (lower-cased) bytes."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    last = low[e - 1] if len(e) else np.zeros(0, np.uint64)
    prev = np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0) if len(e) else last
    return (textops.mix64(last * np.uint64(256) + prev + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int32)


def texts_words(hasher: textops.Hasher, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """``(first row, end row, word hashes, classes, first word per text, last part)``;
    a long text comes in parts, cut at separators; a part before the last has words."""
    for i, j, raw, off in textops.text_slices(col):
        if j == i + 1 and len(raw) > 2 * textops.SLICE:
            at = 0
            while at < len(raw):
                end = min(len(raw), at + textops.SLICE)
                while end < len(raw) and not hasher.sep[raw[end]]:
                    end += 1
                s, e, h, _ = hasher.words(raw[at:end], np.array([0, end - at]))
                if len(h) or end == len(raw):
                    yield i, j, h, word_classes(raw[at:end], s, e), np.array([0, len(h)]), end == len(raw)
                at = end
        else:
            s, e, h, first = hasher.words(raw, off)
            yield i, j, h, word_classes(raw, s, e), first, True


def fold(id_col: str) -> Column:
    """crc32 of the id as text, by 5; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def word_counts(texts: DataFrame) -> DataFrame:
    """``h, cls, c`` of every distinct word of a text column: tasks add up their own
    words before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = textops.Hasher(), [], 0

        def flush():
            h, cls, c = (np.concatenate([x[k] for x in held]) for k in range(3))
            u, one, inv = np.unique(h, return_index=True, return_inverse=True)
            return u, cls[one], np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64)

        def send(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])],
                                              names=["h", "cls", "c"])

        for b in batches:
            for _, _, h, cls, _, _ in texts_words(hasher, b.column(0)):
                u, one, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, cls[one], c))
                size += len(u)
                if size > 1 << 21:
                    held = [flush()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield send(held[0])
                        held, size = [], 0
        if held:
            yield send(flush())

    return texts.mapInArrow(textops.returning_memory(run), "h long, cls int, c long").groupBy("h").agg(
        F.max("cls").alias("cls"), F.sum("c").alias("c"))


class Lexicon:
    """What tasks need to know about words (bounded by HEAD)."""

    def __init__(self, head_h: np.ndarray, head_c: np.ndarray, class_n: np.ndarray, class_v: np.ndarray,
                 texts: int, n: int, v: int):
        o = np.argsort(head_h)
        self.h, self.c = head_h[o], head_c[o]
        order = np.lexsort((self.h, -self.c))[:CORE]
        self.out = np.full(len(self.h), -1, np.int32)  # output of core words
        self.out[order] = 1 + np.arange(len(order))
        self.texts, self.n, self.v = texts, n, v
        core = self.out >= 0
        # class totals come with the core words in them: they are taken out by the caller
        self.class_n, self.class_v = class_n, class_v
        count = np.zeros(OUT)
        count[0] = texts
        count[self.out[core]] = self.c[core]
        count[1 + CORE:] = class_n
        self.count = count

    def unigram(self) -> np.ndarray:
        """Smoothed probability of every output."""
        p = self.count + 0.5
        return p / p.sum()

    def far(self) -> np.ndarray:
        """Second-context symbol of every output and the start."""
        out = np.full(OUT + 1, FAR, np.int32)
        out[np.argsort(-self.count, kind="stable")[:FAR]] = np.arange(FAR)
        out[START] = FAR + 1
        return out


class Lookup:
    """Head places of word hashes (made inside a task)."""

    def __init__(self, lex: Lexicon, bits: int = 20):
        self.lex, self.shift = lex, np.uint64(64 - bits)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[(lex.h >> self.shift).astype(np.int64)] = np.arange(len(lex.h), dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place in the head, or -1."""
        lex = self.lex
        if not len(lex.h):
            return np.full(len(h), -1, np.int64)
        at = self.slot[(h >> self.shift).astype(np.int64)].astype(np.int64)
        miss = np.flatnonzero(lex.h[at] != h)
        if len(miss):
            p = np.minimum(np.searchsorted(lex.h, h[miss]), len(lex.h) - 1)
            at[miss] = np.where(lex.h[p] == h[miss], p, -1)
        return at


def outputs(lex: Lexicon, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    out = 1 + CORE + cls.astype(np.int64)
    if len(lex.out):
        core = np.where(at >= 0, lex.out[at], -1)
        out = np.where(core >= 0, core, out)
    return out


def with_ends(out: np.ndarray, first: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(outputs with an end after every text, first place of each text)."""
    if not last:
        return out, first
    seq = np.insert(out, first[1:], 0)
    return seq, first + np.arange(len(first))


def contexts(seq: np.ndarray, first: np.ndarray, far: np.ndarray, before: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Last output and second-context symbol of every place. ``before`` are the two
    outputs before the first place (START inside no text)."""
    u = np.concatenate([[before[0]], seq[:-1]])
    v = np.concatenate([[before[1], before[0]], seq[:-2]])[:len(seq)]
    if len(first) > 2 or before[0] == START:
        begin = first[:-1]
        u[begin] = START
        v[begin] = START
        second = begin + 1
        second = second[second < len(seq)]
        v[second[second < np.repeat(first[1:], 1)[:len(second)]]] = START
    return u, far[v]


# --- the model ---------------------------------------------------------------------

def new_parameters(lex: Lexicon) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    p = lex.unigram()
    return {"r": (rng.standard_normal((OUT + 1, DIM)) * 0.1).astype(np.float32),
            "t": (rng.standard_normal((FAR + 2, DIM)) * 0.1).astype(np.float32),
            "q": (rng.standard_normal((OUT, DIM)) * 0.1).astype(np.float32),
            "b": np.log(p).astype(np.float32)}


class Trainer:
    """Stochastic steps on one task's texts, with row-wise adaptive rates."""

    def __init__(self, params: dict[str, np.ndarray], unigram: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in params.items()}
        self.sq = {k: np.ones(len(v), np.float32) for k, v in params.items()}
        self.rng = np.random.default_rng(seed)
        self.cdf = np.cumsum(unigram)
        self.shift = np.log(NOISE * unigram).astype(np.float32)

    def _move(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        """Add up the gradients of equal rows, then one adaptive step per row."""
        o = np.argsort(rows, kind="stable")
        r = rows[o]
        at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        g = np.add.reduceat(grad[o], at, axis=0)
        r = r[at]
        self.sq[name][r] += g * g if g.ndim == 1 else (g * g).mean(1)
        step = RATE / np.sqrt(self.sq[name][r])
        self.p[name][r] += g * step if g.ndim == 1 else g * step[:, None]

    def step(self, w: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        p = self.p
        ctx = p["r"][u] + p["t"][v]
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), OUT - 1)
        qw, qn = p["q"][w], p["q"][noise]
        with np.errstate(over="ignore"):
            st = np.einsum("ij,ij->i", ctx, qw) + p["b"][w] - self.shift[w]
            gt = 1 / (1 + np.exp(st))                                    # 1 - P(from the text)
            sn = ctx @ qn.T + (p["b"][noise] - self.shift[noise])[None, :]
            gn = -1 / (1 + np.exp(-sn))                                  # - P(from the text) of noise
        gctx = gt[:, None] * qw + gn @ qn
        self._move("q", np.concatenate([w, noise]), np.concatenate([gt[:, None] * ctx, gn.T @ ctx]))
        self._move("b", np.concatenate([w, noise]), np.concatenate([gt, gn.sum(0)]))
        self._move("r", u, gctx)
        self._move("t", v, gctx)


NAMES = ("r", "t", "q", "b")


def train(texts: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` averaged passes, each over its share of
    (part, text); the parameters (1.1 MB) are all that comes to the driver."""
    params = new_parameters(lex)
    unigram, far = lex.unigram(), lex.far()
    sizes = {k: params[k].size for k in NAMES}
    total = sum(sizes.values())
    block = -(-total // 16)

    for turn in range(rounds):
        now = params

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, look = textops.Hasher(), Lookup(lex)
            tr = Trainer(now, unigram, SEED + 1000 * turn + TaskContext.get().partitionId())
            held, size, seen = [], 0, 0
            tail = (START, START)
            for b in batches:
                for _, _, h, cls, first, last in texts_words(hasher, b.column(0)):
                    seq, first = with_ends(outputs(lex, look.find(h), cls), first, last)
                    u, v = contexts(seq, first, far, tail)
                    tail = (START, START) if last else (int(seq[-1]), int(seq[-2]) if len(seq) > 1 else tail[0])
                    held.append((seq, u, v))
                    size += len(seq)
                    if size >= 64 * BATCH:
                        w, u, v = (np.concatenate([x[k] for x in held]) for k in range(3))
                        held, size = [], 0
                        mix = tr.rng.permutation(len(w))
                        for a in range(0, len(w), BATCH):
                            tr.step(w[mix[a:a + BATCH]], u[mix[a:a + BATCH]], v[mix[a:a + BATCH]])
                        seen += len(w)
            if size:
                w, u, v = (np.concatenate([x[k] for x in held]) for k in range(3))
                for a in range(0, len(w), BATCH):
                    tr.step(w[a:a + BATCH], u[a:a + BATCH], v[a:a + BATCH])
                seen += len(w)
            if seen:
                flat = np.concatenate([tr.p[k].ravel() for k in NAMES])
                cut = [flat[a:a + block] for a in range(0, total, block)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cut)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(cut), pa.int32()),
                     pa.array([float(seen)] * len(cut)), pa.array([x.tobytes() for x in cut], pa.binary())],
                    names=["block", "grp", "n", "x"])

        def average(t: pa.Table) -> pa.Table:
            n = t.column("n").to_numpy()
            acc = 0.0
            for w, x in zip(n, t.column("x")):
                acc = acc + w * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
            return pa.table({"block": t.column("block").slice(0, 1), "grp": t.column("grp").slice(0, 1), "n": [float(n.sum())],
                             "x": pa.array([(acc / n.sum()).astype(np.float32).tobytes()], pa.binary())})

        part = texts.where(F.pmod("part", F.lit(rounds)) == turn).select("text")
        schema = "block int, grp int, n double, x binary"
        level, groups = part.mapInArrow(textops.returning_memory(run), schema), part.rdd.getNumPartitions()
        while True:  # a tree: no task averages more than FAN parts
            groups = -(-groups // FAN)
            level = level.withColumn("grp", F.floor(F.col("grp") / FAN).cast("int")).groupBy("block", "grp").applyInArrow(
                average, schema)
            if groups <= 1:
                break
        got = level.collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["x"], np.float32) for r in sorted(got, key=lambda r: r["block"])])
            at, params = 0, {}
            for k in NAMES:
                params[k] = flat[at:at + sizes[k]].reshape(now[k].shape)
                at += sizes[k]
    return params


def normalisers(params: dict[str, np.ndarray], v: int) -> np.ndarray:
    """log Z of every last output after the second-context symbol v: one matrix
    product of all contexts with all outputs, in blocks."""
    out = np.empty(OUT + 1)
    for a in range(0, OUT + 1, 512):
        s = (params["r"][a:a + 512] + params["t"][v]) @ params["q"].T + params["b"]
        top = s.max(1, keepdims=True)
        out[a:a + 512] = (np.log(np.exp(s - top).sum(1, dtype=np.float64)) + top[:, 0])
    return out


def all_normalisers(spark, params: dict[str, np.ndarray]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normalisers(params, x).tobytes() for x in v], pa.binary())],
                                             names=["v", "z"])

    rows = spark.range(0, FAR + 2, 1, min(FAR + 2, spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "v")
    got = {r["v"]: np.frombuffer(r["z"], np.float64) for r in rows.mapInArrow(textops.returning_memory(run), "v long, z binary").collect()}
    return np.stack([got[v] for v in range(FAR + 2)])


# --- the job ------------------------------------------------------------------------------

def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    """Head, class totals and sums of a stored count table."""
    spark = counts.sparkSession
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    by_count = counts.groupBy("c").count().where(F.col("c") > 0)
    # the smallest count that keeps the head within HEAD words
    least, words = 1, 0
    for r in by_count.orderBy(F.col("c").desc()).toLocalIterator():
        if words + r["count"] > HEAD:
            least = r["c"] + 1
            break
        words += r["count"]
    head = counts.where(F.col("c") >= least).select("h", "cls", "c").toArrow()
    h, c = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
    cls = head.column("cls").to_numpy()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["cls"]], class_v[r["cls"]] = r["n"], r["v"]
    o = np.argsort(h)
    core = np.lexsort((h[o], -c[o]))[:CORE]
    class_n -= np.bincount(cls[o][core], weights=c[o][core], minlength=CLASSES)
    class_v -= np.bincount(cls[o][core], minlength=CLASSES)
    return Lexicon(h, c, class_n, class_v, texts, int(total["n"] or 0) + texts, int(total["v"]) + (texts > 0))


def score_texts(docs: DataFrame, held_out_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    A text is its words and an end token; null and empty texts have the end only.
    The fold ``held_out_fold`` is scored but neither counted nor trained on.
    Repeated rows and repeated or null ids are rows like others; an empty table
    gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), (fold(id_col) == held_out_fold).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    learn = src.where(~F.col("held_out"))
    counts = materialize(word_counts(learn.select("text")))
    texts = learn.count()
    lex = lexicon(counts, texts)
    params = train(learn.select(F.xxhash64("id", F.length("text")).alias("part"), "text"), lex)
    logz = all_normalisers(spark, params)
    far = lex.far()
    base_z = np.log10(lex.n + 0.5 * (lex.v + 1))
    class_z = np.log10(lex.class_n + 0.5 * (lex.class_v + 1))
    r, t, q, b = (params[k] for k in NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, look = textops.Hasher(), Lookup(lex)
        log_c = np.log10(lex.c + 0.5)
        row = TaskContext.get().partitionId() << 40
        names = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "rare_n"]
        for batch in batches:
            n_rows = batch.num_rows
            tokens, known = np.ones(n_rows, np.int64), np.full(n_rows, 1 if texts else 0, np.int64)
            base = np.full(n_rows, np.log10(texts + 0.5) - base_z)
            score = np.zeros(n_rows)
            rare: list = [[] for _ in range(n_rows)]
            tail = (START, START)
            for i, j, h, cls, first, last in texts_words(hasher, batch.column(2)):
                at = look.find(h)
                text_of = np.repeat(np.arange(i, j), np.diff(first))
                head = at >= 0
                got = np.bincount(text_of, minlength=n_rows)
                tokens += got
                known += np.bincount(text_of[head], minlength=n_rows)
                base += np.bincount(text_of[head], weights=log_c[at[head]], minlength=n_rows) - got * base_z
                out = outputs(lex, at, cls)
                inner = out > CORE  # the word's share of its class
                share = -class_z[cls]
                share[head] += log_c[at[head]]
                score += np.bincount(text_of[inner], weights=share[inner], minlength=n_rows)
                miss = np.flatnonzero(~head)
                cut = np.searchsorted(text_of[miss], np.arange(i, j + 1))
                for k in range(i, j):
                    if cut[k - i + 1] > cut[k - i]:
                        rare[k].append(h[miss[cut[k - i]:cut[k - i + 1]]])
                seq, place = with_ends(out, first, last)
                u, v = contexts(seq, place, far, tail)
                tail = (START, START) if last else (int(seq[-1]), int(seq[-2]) if len(seq) > 1 else tail[0])
                for a in range(0, len(seq), 1 << 16):
                    w1, u1, v1 = seq[a:a + (1 << 16)], u[a:a + (1 << 16)], v[a:a + (1 << 16)]
                    s = np.einsum("ij,ij->i", r[u1] + t[v1], q[w1]) + b[w1] - logz[v1, u1]
                    owner = np.searchsorted(place, np.arange(a, a + len(s)), "right") - 1 + i
                    score += np.bincount(np.minimum(owner, j - 1), weights=s / np.log(10.0), minlength=n_rows)
            hs, ns, ends = [], [], [0]
            for x in rare:
                x, c = np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                hs.append(x)
                ns.append(c)
                ends.append(ends[-1] + len(x))
            off = pa.array(ends, pa.int32())
            hs = np.concatenate(hs).view(np.int64) if hs else np.zeros(0, np.int64)
            ns = np.concatenate(ns).astype(np.int32) if ns else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n_rows)), batch.column(0), batch.column(1), pa.array(tokens), pa.array(known),
                 pa.array(base), pa.array(score), pa.ListArray.from_arrays(off, pa.array(hs)),
                 pa.ListArray.from_arrays(off, pa.array(ns))], names=names)
            row += n_rows

    long, dbl = T.LongType(), T.DoubleType()
    first = materialize(src.mapInArrow(textops.returning_memory(run), T.StructType([
        T.StructField("row", long), T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", long), T.StructField("n_known", long), T.StructField("base", dbl), T.StructField("score", dbl),
        T.StructField("rare", T.ArrayType(long)), T.StructField("rare_n", T.ArrayType(T.IntegerType()))])))
    # words outside the head: one row per text and word meets the count table
    words = first.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("z")).select(
        "row", F.col("z.rare").alias("h"), F.col("z.rare_n").alias("n"))
    met = words.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    j = first.drop("rare", "rare_n").join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return j.select(F.col("id").alias(id_col), "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
                    F.lit(lex.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
                    (F.col("score") + more).alias("score"))
