"""Byte-level BPE encoding and decoding with a public tokenizer's file.

``encode_documents`` keeps a distinct-word table: texts are split into
pre-tokens (the "words" of the tokenizer) in Spark tasks; per block of texts the
distinct words are dealt by hash to buckets; a bucket gathers its words from all
blocks, encodes each distinct word once with the tokenizers library, and sends
the ids back; a block puts them back by position. ``decode_ids`` joins ids to
their pieces. Words of a block cross the network once, so a word that makes up a
third of all text is sent once per block.

``WordCoder`` encodes texts inside one task with a bounded word cache.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops

BLOCK_BYTES = 16 << 20   # text of a block of documents
BUCKET_BYTES = 64 << 20  # input text per bucket of the word table
MAX_BUCKETS = 1 << 16
CACHE_BITS = 19          # slots of a task's word cache
CACHE_IDS = 1 << 22      # ids the cache keeps before it starts anew


# --- the tokenizer file ---------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + i)] = b
    return out


class Vocabulary:
    """Pieces, merge ranks and special strings of a byte-level BPE file (a bounded
    table: it is sent to tasks)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        spec = json.loads(self.json)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("special tokens that take neighbouring text are not handled")
        letter = byte_letters()
        self.ranks = {bytes(letter[c] for c in w): i for w, i in model["vocab"].items()
                      if all(c in letter for c in w)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        #: ids in merge order: merging by smallest id is merging by rule order
        self.ordered = made == sorted(set(made)) and len(made) + 256 >= len(self.ranks) - len(self.special)
        self.classes = zlib.compress(char_classes().tobytes())

    def pieces(self) -> list[bytes]:
        size = max([*self.ranks.values(), *self.special.values()]) + 1
        out = [b""] * size
        for w, i in self.ranks.items():
            out[i] = w
        for w, i in self.special.items():
            out[i] = w.encode()
        return out


OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def char_classes() -> np.ndarray:
    """Class of every code point, as the split pattern's \\p{L}, \\p{N} and \\s see it."""
    import regex
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    out = np.zeros(0x110000, np.uint8)
    place = np.array(points)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[place[m.start():m.end()]] = cls
    return out


# --- splitting --------------------------------------------------------------------

class Splitter:
    """Pre-tokens of texts: contractions, letters, numbers or other characters
    with one leading space, and white space (the GPT-2 split), on code points."""

    def __init__(self, vocab: Vocabulary):
        self.cls = np.frombuffer(zlib.decompress(vocab.classes), np.uint8)
        self.special = list(vocab.special)
        self.hasher = textops.Hasher()

    def starts(self, codes: np.ndarray, text: str, seg: np.ndarray) -> np.ndarray:
        """Token starts of ``text`` (its code points ``codes``) whose texts start
        at the places ``seg``."""
        n = len(codes)
        k = self.cls[codes]
        cut = np.zeros(n + 1, bool)
        cut[seg] = True
        cut[n] = True
        whole = []  # special strings: their own token, and the end of the text around it
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                if not cut[at + 1:at + len(s)].any():
                    cut[at] = cut[at + len(s)] = True
                    whole.append((at, at + len(s)))
                at = text.find(s, at + len(s))
        new = cut[:n].copy()
        new[1:] |= k[1:] != k[:-1]
        # the last character of white space before other text leaves its run; a
        # plain space joins what follows
        last = np.flatnonzero((k[:-1] == SPACE) & (k[1:] != SPACE) & ~cut[1:n]) if n > 1 else np.zeros(0, np.int64)
        new[last] = True
        new[last[codes[last] == 0x20] + 1] = False
        # contractions: a lone apostrophe at a token start, before a letter
        a = np.flatnonzero((codes == 0x27) & new)
        a = a[a + 1 < n]
        a = a[(k[a + 1] == LETTER) & ~cut[a + 1]]
        if len(a):
            c1 = codes[a + 1]
            c2 = np.where((a + 2 < n) & ~cut[np.minimum(a + 2, n)], codes[np.minimum(a + 2, n - 1)], 0)
            two = np.isin(c1, [ord(c) for c in "stmd"])
            three = (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            for hit, size in ((a[two], 2), (a[three & ~two], 3)):
                new[hit + 1] = False
                after = hit + size
                after = after[after < n]
                new[after[k[after] == LETTER]] = True
        for b, e in whole:
            new[b + 1:e] = False
        return np.flatnonzero(new)

    def slices(self, ids: pa.Array, col: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(text, start, end, hash, row of each token)`` for slices of a text
        column; a long text comes in several slices, cut before a single space."""
        for i, j, raw, off in textops.text_slices(col):
            text = bytes(raw).decode("utf-8")
            ends = np.zeros(len(off), np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=(points := np.empty(len(raw), np.int64))) if len(raw) else None
            ends[1:] = np.where(off[1:] > 0, points[np.maximum(off[1:] - 1, 0)], 0) if len(raw) else 0
            if j == i + 1 and len(text) > textops.SLICE:
                for part in cut_text(text):
                    yield (part, *self.tokens(part, np.zeros(1, np.int64), np.array([i])))
            else:
                yield (text, *self.tokens(text, ends[:-1], np.arange(i, j)))

    def tokens(self, text: str, first: np.ndarray, rows: np.ndarray):
        codes = np.frombuffer(text.encode("utf-32-le"), np.int32)
        if not len(codes):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0, np.uint64), z
        s = self.starts(codes, text, first[first < len(codes)])
        e = np.append(s[1:], len(codes))
        v = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h = self.hasher.runs(v ^ (v >> np.uint64(32)), s, e)
        # an empty text shares its start with the next one: the last of them owns the tokens
        return s, e, h, rows[np.searchsorted(first, s, "right") - 1]


def cut_text(text: str, size: int = textops.SLICE) -> Iterator[str]:
    """Parts of about ``size`` characters, cut before single spaces between other
    characters, where a token starts whatever stands around."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = len(text)
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace() and text[cut - 1] > "\x1f" and text[cut + 1] > "\x1f":
                break
            cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


# --- one task's own coder -----------------------------------------------------------

class WordCoder:
    """Ids of texts in one task; words are kept in a direct-mapped cache by hash."""

    def __init__(self, vocab: Vocabulary):
        self.split = Splitter(vocab)
        self.special = vocab.special
        if vocab.ordered:  # the same merges through the faster of the two public libraries
            import tiktoken
            ranks = {w: i for w, i in vocab.ranks.items() if w.decode("latin-1") not in vocab.special}
            self.encode = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks,
                                            special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer
            tok = Tokenizer.from_str(vocab.json)
            self.encode = lambda w: tok.encode(w, add_special_tokens=False).ids
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(1 << CACHE_BITS, np.uint64)
        self.val = np.zeros(1 << CACHE_BITS, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used, self.off, self.len, self.n = 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _add(self, words: list[str]) -> int:
        first = self.n
        coded = [[self.special[w]] if w in self.special else self.encode(w) for w in words]
        size = np.fromiter(map(len, coded), np.int32, len(coded))
        flat = np.fromiter((i for c in coded for i in c), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(words) > len(self.off):
            self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len))
        self.flat[self.used:self.used + len(flat)] = flat
        self.off[first:first + len(words)] = self.used + np.cumsum(size) - size
        self.len[first:first + len(words)] = size
        self.used += len(flat)
        self.n += len(words)
        return first

    def ids(self, text: str, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all tokens, number of ids of each token)."""
        if self.used > CACHE_IDS:
            self.reset()
        slot = (h >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        at = self.val[slot].astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != h) | (h == 0))
        if len(miss):
            u, one, inv = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            first = self._add([text[a:b] for a, b in zip(s[one].tolist(), e[one].tolist())])
            at[miss] = first + inv
            self.key[slot[one]] = u
            self.val[slot[one]] = first + np.arange(len(u))
        size = self.len[at]
        gap = np.repeat(self.off[at] - (np.cumsum(size) - size), size)
        return self.flat[gap + np.arange(len(gap))], size

    def rows(self, ids: pa.Array, col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """``(row, ids)`` for every row of a text column, in order."""
        nxt, parts = 0, []
        for text, s, e, h, row in self.split.slices(ids, col):
            flat, size = self.ids(text, s, e, h)
            if not len(row):
                continue
            new = np.flatnonzero(np.diff(row)) + 1
            ends = np.cumsum(size)
            cuts = [0, *ends[new - 1].tolist(), len(flat)]
            for r, a, b in zip(row[[0, *new]].tolist(), cuts, cuts[1:]):
                if r > nxt:
                    yield nxt, _join(parts)
                    for empty in range(nxt + 1, r):
                        yield empty, np.zeros(0, np.uint32)
                    nxt, parts = r, []
                parts.append(flat[a:b])
        if len(col):
            yield nxt, _join(parts)
            for empty in range(nxt + 1, len(col)):
                yield empty, np.zeros(0, np.uint32)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# --- ids to text ------------------------------------------------------------------------

class PieceTable:
    """The id-to-piece table of a vocabulary, made inside a task."""

    def __init__(self, vocab: Vocabulary):
        pieces = vocab.pieces()
        self.n = len(pieces)
        self.size = np.array([*map(len, pieces), 0], np.int64)  # the last entry: an unknown id
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.off = np.cumsum(self.size) - self.size

    def text(self, ids: np.ndarray) -> str:
        """The pieces of ``ids`` joined and read as UTF-8 with replacement characters."""
        at = ids.astype(np.int64)
        at = np.where((at >= 0) & (at < self.n), at, self.n)
        n = self.size[at]
        gap = np.repeat(self.off[at] - (np.cumsum(n) - n), n)
        return self.flat[gap + np.arange(len(gap))].tobytes().decode("utf-8", "replace")


# --- the distributed word table ---------------------------------------------------------

def _shrink(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    import zstandard
    return zstandard.ZstdCompressor(level=3).compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _grow(b: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows with about ``BLOCK_BYTES`` of text."""
    held, size = [], 0
    for b in batches:
        i = 0
        for r, j, raw, _ in textops.text_slices(b.column(1)):
            if size and size + len(raw) > BLOCK_BYTES:
                if r > i:
                    held.append(b.slice(i, r - i))
                yield pa.Table.from_batches(held)
                held, size, i = [], 0, r
            size += len(raw)
        if b.num_rows > i:
            held.append(b.slice(i))
    if held:
        yield pa.Table.from_batches(held)


def _block_words(split: Splitter, block: pa.Table, spell: bool):
    """(block key, hashes of the distinct words, with ``spell`` the words, place of every token among them, tokens
    per row)."""
    import hashlib
    key = hashlib.blake2b(digest_size=16)
    slices, base, per_row = [], 0, np.zeros(block.num_rows, np.int64)
    for c in block.to_batches():
        key.update(repr(c.column(0).to_pylist()).encode())
        for text, s, e, h, row in split.slices(c.column(0), c.column(1)):
            key.update(text.encode())
            u = np.unique(h)
            own = np.searchsorted(u, h).astype(np.int32)
            first = np.zeros(len(u), np.int64)
            first[own[::-1]] = np.arange(len(h) - 1, -1, -1)
            slices.append((u, own, *((text, s[first], e[first]) if spell else ())))
            if len(row):
                per_row[base:base + c.num_rows] += np.bincount(row, minlength=c.num_rows)
        base += c.num_rows
    seen = np.unique(np.concatenate([x[0] for x in slices])) if slices else np.zeros(0, np.uint64)
    at, words = [], [""] * len(seen) if spell else []
    told = np.zeros(len(seen), bool)
    for u, own, *spelt in slices:
        place = np.searchsorted(seen, u)
        if spell:
            text, s, e = spelt
            new = ~told[place]
            told[place] = True
            for i, a, b in zip(place[new].tolist(), s[new].tolist(), e[new].tolist()):
                words[i] = text[a:b]
        else:
            at.append(place.astype(np.int32)[own])
    return key.digest(), seen, words, np.concatenate(at) if at else np.zeros(0, np.int32), per_row


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     decode: bool = False) -> DataFrame:
    """``id_col, ids`` (array of int; with ``decode`` also ``decoded``, the text that
    the ids' pieces give, see :func:`decode_ids`) per row, as the tokenizers library encodes
    each whole text with the file at ``path`` and ``add_special_tokens=False``.

    Null and empty texts have no ids; repeated rows and repeated or null
    ``id_col`` values keep one result row each; an empty table gives none; other
    columns are ignored."""
    vocab = Vocabulary(path)
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_BYTES))))

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        split, pack = Splitter(vocab), zstandard.ZstdCompressor(level=3).compress
        for block in _blocks(batches):
            key, seen, words, _, _ = _block_words(split, block, spell=True)
            b = bucket_of(seen)
            order = np.argsort(b, kind="stable")  # within a bucket by hash
            groups = np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(seen) else []
            blobs = []
            for g in groups:
                raw = [words[x].encode() for x in g.tolist()]
                size = np.fromiter(map(len, raw), np.uint32, len(raw)).tobytes()
                blobs.append(pack(np.uint32(len(raw)).tobytes() + size + b"".join(raw)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(blobs), pa.binary()), pa.array([int(b[g[0]]) for g in groups], pa.int32()),
                 pa.array(blobs, pa.binary())], names=["block", "bucket", "words"])

    def answer(t: pa.Table) -> pa.Table:
        import zstandard
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        grow = zstandard.ZstdDecompressor().decompress
        tok = Tokenizer.from_str(vocab.json)
        tok.no_truncation()
        tok.no_padding()
        asked = []
        coded: dict[bytes, int] = {}
        for blob in t.column("words").to_pylist():
            raw = grow(blob)
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
            cuts = [4 + 4 * n, *ends.tolist()]
            asked.append(np.fromiter((coded.setdefault(raw[a:b], len(coded)) for a, b in zip(cuts, cuts[1:])), np.int64, n))
        words = list(coded)
        size, flat = [], []
        for i in range(0, len(words), 8192):
            for e in tok.encode_batch_fast([w.decode() for w in words[i:i + 8192]], add_special_tokens=False):
                ids = e.ids
                size.append(len(ids))
                flat += ids
        size, flat = np.array(size, np.int64), np.array(flat, np.uint32)
        off = np.cumsum(size) - size
        out = []
        for at in asked:
            n = size[at]
            gap = np.repeat(off[at] - (np.cumsum(n) - n), n)
            out.append((_shrink(n), _shrink(flat[gap + np.arange(len(gap))])))
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"),
                         "sizes": pa.array([o[0] for o in out], pa.binary()), "ids": pa.array([o[1] for o in out], pa.binary())})

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(vocab)
        for block in _blocks(batches):
            key, seen, _, token, per_row = _block_words(split, block, spell=False)
            b = bucket_of(seen)
            rank = np.empty(len(seen), np.int64)
            rank[np.argsort(b, kind="stable")] = np.arange(len(seen))  # place in the answers' order
            at = rank[token]
            cuts = np.cumsum(per_row) - per_row
            rows = [_shrink(at[a:a + n]) for a, n in zip(cuts.tolist(), per_row.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.binary()), block.column(0).combine_chunks(),
                                              pa.array(rows, pa.binary())], names=["block", "id", "body"])

    id_type = src.schema["id"].dataType
    out_schema = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))]
                              + ([T.StructField("decoded", T.StringType())] if decode else []))

    def place(docs_t: pa.Table, ids_t: pa.Table) -> pa.Table:
        ids_t = ids_t.sort_by("bucket")
        bucket = ids_t.column("bucket").to_numpy()
        keep = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []  # equal blocks ask twice
        size = [_grow(ids_t.column("sizes")[int(i)].as_py()) for i in keep]
        flat = [_grow(ids_t.column("ids")[int(i)].as_py()) for i in keep]
        size = np.concatenate(size).astype(np.int64) if size else np.zeros(0, np.int64)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        off = np.cumsum(size) - size
        table = PieceTable(vocab) if decode else None
        out, ends, texts = [], [0], []
        for blob in docs_t.column("body").to_pylist():
            at = _grow(blob)
            n = size[at]
            gap = np.repeat(off[at] - (np.cumsum(n) - n), n)
            out.append(flat[gap + np.arange(len(gap))].astype(np.int32))
            ends.append(ends[-1] + len(gap))
            if decode:
                texts.append(table.text(out[-1]))
        values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32))
        got = {"id": docs_t.column("id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)}
        return pa.table({**got, "decoded": pa.array(texts, pa.string())} if decode else got)

    words = src.mapInArrow(textops.returning_memory(ask), "block binary, bucket int, words binary")
    coded = words.groupBy("bucket").applyInArrow(answer, "block binary, bucket int, sizes binary, ids binary")
    bodies = src.mapInArrow(textops.returning_memory(body), T.StructType([T.StructField("block", T.BinaryType()), T.StructField("id", id_type),
                                                T.StructField("body", T.BinaryType())]))
    return bodies.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(place, out_schema).withColumnRenamed("id", id_col)


def decode_ids(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of an id list as the library's ``decode(ids,
    skip_special_tokens=False)`` gives it: each id joins its piece (the
    vocabulary is a bounded table in every task), the bytes are read as UTF-8 with
    replacement characters. A null list stays null; an unknown id adds nothing."""
    vocab = Vocabulary(path)
    schema = T.StructType([f for f in coded.schema.fields if f.name != out_col] + [T.StructField(out_col, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(vocab)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            out = [table.text(values[a:z]) if ok else None for a, z, ok in zip(ends.tolist(), ends[1:].tolist(), valid.tolist())]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names],
                                              pa.array(out, pa.string())], schema=None, names=[*names, out_col])

    return coded.select(*names).mapInArrow(textops.returning_memory(run), schema)
