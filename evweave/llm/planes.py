"""Token ids in binary files of compressed bit or byte planes.

A file is a run of chunks and a footer. A chunk holds whole documents: their ids
and lengths (a compressed Arrow stream) and their tokens, cut into blocks of
``BLOCK`` ids. A block is transposed: plane p holds bit (or byte) p of every id, and
each plane is compressed with zstandard by itself. The footer is the chunk index:
place, sizes, documents and ids of every chunk, and the places of every block's
planes. So any range of ids is read by decoding only its blocks (``read_ids``).

The files are a Spark data source of its own (``PlaneSource``): every write task
makes files under names that no other attempt uses, and only the commit writes the
manifest that lists, in order, the files of the attempts that won. A lost executor or
a repeated attempt leaves stray files that no reader looks at.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from ..session import scratch_path
from . import bpe, textops

MAGIC = b"IDPLANE1"
MANIFEST = "manifest.json"
BLOCK = 1 << 16        # ids transposed together
CHUNK_IDS = 1 << 20    # a chunk is closed when it holds so many ids
CHUNK_DOCS = 1 << 16   # or so many documents
FILE_IDS = 1 << 28     # a file is closed when it holds so many ids
LEVEL = 3              # of zstandard


# --- blocks ---------------------------------------------------------------------------

def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids, lowest first; planes above the largest id are left out."""
    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    octets = ids.view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, p].tobytes() for p in range((bits + 7) // 8)]
    each = np.unpackbits(octets, axis=1, count=bits, bitorder="little") if bits else np.zeros((len(ids), 0), np.uint8)
    return [np.packbits(each[:, p], bitorder="little").tobytes() for p in range(bits)]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ``n`` ids whose planes these are."""
    if kind == "byte":
        out = np.zeros((n, 4), np.uint8)
        for p, plane in enumerate(planes):
            out[:, p] = np.frombuffer(plane, np.uint8)
        return out.reshape(-1).view("<u4")
    each = np.zeros((n, 32), np.uint8)
    for p, plane in enumerate(planes):
        each[:, p] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(each, axis=1, bitorder="little").reshape(-1).view("<u4")


# --- files ----------------------------------------------------------------------------

def open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the folder of a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


class PlaneWriter:
    """Writes one file; ``add`` takes documents in order, ``close`` the footer."""

    def __init__(self, out, kind: str):
        import zstandard
        self.out, self.kind, self.pack = out, kind, zstandard.ZstdCompressor(level=LEVEL).compress
        self.at = self.out.write(MAGIC) or len(MAGIC)
        self.chunks: list[tuple] = []   # place, length of the documents part, documents, ids, blocks
        self.blocks: list[tuple] = []   # ids, planes
        self.planes: list[int] = []     # compressed length of every plane
        self.n_docs = self.n_ids = self.held = 0
        self.keys: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []

    def add(self, keys: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with ids ``keys``, ``sizes`` tokens each, and their tokens."""
        ends = np.cumsum(sizes)
        a = 0
        while a < len(keys):
            before = int(ends[a - 1]) if a else 0
            docs = sum(map(len, self.keys))
            b = int(np.searchsorted(ends, before + max(1, CHUNK_IDS - self.held), "left")) + 1
            b = min(b, len(keys), a + CHUNK_DOCS - docs)
            self.keys.append(keys.slice(a, b - a))
            self.sizes.append(sizes[a:b])
            self.ids.append(ids[before:int(ends[b - 1])])
            self.held += len(self.ids[-1])
            if self.held >= CHUNK_IDS or docs + b - a >= CHUNK_DOCS:
                self._chunk()
            a = b

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _chunk(self) -> None:
        if not self.keys:
            return
        keys, sizes, ids = pa.concat_arrays(self.keys), np.concatenate(self.sizes), np.concatenate(self.ids)
        place, sink = self.at, io.BytesIO()
        rows = pa.record_batch([keys, pa.array(sizes.astype(np.int64))], names=["id", "n"])
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_batch(rows)
        head = self._write(self.pack(sink.getvalue()))
        first = len(self.blocks)
        for a in range(0, len(ids), BLOCK):
            part = ids[a:a + BLOCK]
            planes = [self.pack(p) for p in split_planes(part, self.kind)]
            self.blocks.append((len(part), len(planes)))
            self.planes += [self._write(p) for p in planes]
        self.chunks.append((place, head, len(keys), len(ids), len(self.blocks) - first))
        self.n_docs += len(keys)
        self.n_ids += len(ids)
        self.keys, self.sizes, self.ids, self.held = [], [], [], 0

    def close(self) -> None:
        self._chunk()
        index = [np.array(self.chunks, "<i8").reshape(-1, 5), np.array(self.blocks, "<i8").reshape(-1, 2),
                 np.array(self.planes, "<i8")]
        body = self.pack(b"".join(x.tobytes() for x in index))
        self._write(body)
        self._write(struct.pack("<4q", len(self.chunks), len(self.blocks), len(self.planes), len(body)) + MAGIC)
        self.out.close()


class PlaneFile:
    """Reads one file through its chunk index."""

    def __init__(self, fs: pa.fs.FileSystem, name: str, kind: str):
        import zstandard
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.file, self.kind = fs.open_input_file(name), kind
        size, tail = self.file.size(), 32 + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[32:] != MAGIC:
            raise ValueError(f"{name} is no finished file of id planes")
        chunks, blocks, planes, body = struct.unpack("<4q", end[:32])
        flat = np.frombuffer(self.unpack(self.file.read_at(body, size - tail - body)), "<i8")
        self.chunks = flat[:5 * chunks].reshape(-1, 5)
        self.blocks = flat[5 * chunks:5 * chunks + 2 * blocks].reshape(-1, 2)
        self.planes = flat[5 * chunks + 2 * blocks:]
        assert len(self.planes) == planes
        self.first_block = np.concatenate([[0], np.cumsum(self.chunks[:, 4])])
        self.first_plane = np.concatenate([[0], np.cumsum(self.blocks[:, 1])])
        self.first_id = np.concatenate([[0], np.cumsum(self.chunks[:, 3])])

    def documents(self, chunk: int) -> tuple[pa.Array, np.ndarray]:
        place, head = self.chunks[chunk, :2].tolist()
        rows = pa.ipc.open_stream(self.unpack(self.file.read_at(head, place))).read_all().combine_chunks()
        keys = rows.column("id").combine_chunks()
        return keys, rows.column("n").to_numpy()

    def ids(self, chunk: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a chunk; only the blocks they lie in are decoded."""
        n = int(self.chunks[chunk, 3])
        stop = n if stop is None else min(stop, n)
        if start >= stop:
            return np.zeros(0, "<u4")
        b0 = int(self.first_block[chunk])
        at = int(self.chunks[chunk, 0] + self.chunks[chunk, 1])
        a, b = b0 + start // BLOCK, b0 + (stop - 1) // BLOCK + 1
        at += int(self.planes[self.first_plane[b0]:self.first_plane[a]].sum())
        out = []
        for block in range(a, b):
            sizes = self.planes[self.first_plane[block]:self.first_plane[block + 1]].tolist()
            raw, planes, x = self.file.read_at(sum(sizes), at), [], 0
            for s in sizes:
                planes.append(self.unpack(raw[x:x + s]))
                x += s
            at += sum(sizes)
            out.append(join_planes(planes, int(self.blocks[block, 0]), self.kind))
        skip = (a - b0) * BLOCK
        return np.concatenate(out)[start - skip:stop - skip]


# --- the data source --------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list  # (name, documents, ids)


@dataclass
class Chunks(InputPartition):
    name: str
    start: int   # ids of all files before
    part: int    # this part of the file's chunks
    parts: int


class PlaneSource(DataSource):
    """``spark.read / write.format("idplanes")``. Writing takes ``(id, text)`` rows in the order of the partitions,
    and the options ``tokenizer`` (a file that the driver reads), ``end`` (an id after each document) and
    ``planes`` (byte or bit). Reading gives ``id, start, n_tokens`` and, unless the option ``ids`` is ``false``,
    ``ids``, little-endian 32-bit binary."""

    @classmethod
    def name(cls) -> str:
        return "idplanes"

    def schema(self) -> T.StructType:
        fs, folder = open_folder(self.options["path"])
        return read_type(_manifest(fs, folder)["id_type"], self.options.get("ids", "true") != "false")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PlaneReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PlaneSink(self.options, schema)


def read_type(id_type: str, with_ids: bool) -> T.StructType:
    fields = [T.StructField("id", T._parse_datatype_json_string(id_type)), T.StructField("start", T.LongType()),
              T.StructField("n_tokens", T.LongType())]
    return T.StructType(fields + ([T.StructField("ids", T.BinaryType())] if with_ids else []))


def _manifest(fs: pa.fs.FileSystem, folder: str) -> dict:
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


class PlaneSink(DataSourceArrowWriter):
    def __init__(self, options, schema: T.StructType):
        self.path, self.kind, self.end = options["path"], options.get("planes", "byte"), int(options["end"])
        self.id_type = schema.fields[0].dataType.json()
        with open(options["tokenizer"], encoding="utf-8") as f:
            self.spec = f.read()
        check_spaces(self.spec)
        fs, folder = open_folder(self.path)
        if fs.get_file_info(f"{folder}/{MANIFEST}").type != pa.fs.FileType.NotFound:
            raise ValueError(f"{folder} holds id planes already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return list(textops.returning_memory(self._write)(iterator))[0]

    def _write(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[Written]:
        fs, folder = open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        part, files, out, name = TaskContext.get().partitionId(), [], None, ""
        coder, end = SpaceCoder(self.spec), np.array([self.end], np.uint32)
        for b in iterator:
            first, held, size = 0, [], 0
            for i, ids in coder.rows(b.column(0), b.column(1)):
                held.append(ids)
                size += len(ids) + 1
                if size < CHUNK_IDS and i + 1 < b.num_rows:
                    continue
                if out is None:
                    name = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.idp"
                    out = PlaneWriter(fs.open_output_stream(f"{folder}/{name}"), self.kind)
                out.add(b.column(0).slice(first, i + 1 - first), np.array([len(x) + 1 for x in held]),
                        np.concatenate([y for x in held for y in (x, end)]))
                first, held, size = i + 1, [], 0
                if out.n_ids >= FILE_IDS:
                    out.close()
                    files.append((name, out.n_docs, out.n_ids))
                    out = None
        if out is not None:
            out.close()
            files.append((name, out.n_docs, out.n_ids))
        yield Written(part, files)

    def commit(self, messages) -> None:
        fs, folder = open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        files = [list(f) for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for f in m.files]
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps({"planes": self.kind, "id_type": self.id_type, "files": files}).encode())

    def abort(self, messages) -> None:
        """Nothing to undo: without a manifest no reader sees the files."""


class PlaneReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.with_ids = options["path"], options.get("ids", "true") != "false"
        self.kind = _manifest(*open_folder(self.path))["planes"]

    def partitions(self) -> list[Chunks]:
        out, start = [], 0
        for name, _, n in _manifest(*open_folder(self.path))["files"]:
            parts = max(1, n // (8 * CHUNK_IDS))
            out += [Chunks(name, start, p, parts) for p in range(parts)]
            start += n
        return out or [Chunks("", 0, 0, 1)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, folder = open_folder(self.path)
        f = PlaneFile(fs, f"{folder}/{partition.name}", self.kind)
        n = len(f.chunks)
        for c in range(n * partition.part // partition.parts, n * (partition.part + 1) // partition.parts):
            keys, sizes = f.documents(c)
            ends = np.cumsum(sizes)
            cols = [keys, pa.array(partition.start + int(f.first_id[c]) + ends - sizes), pa.array(sizes)]
            names = ["id", "start", "n_tokens"]
            if self.with_ids:
                off = np.concatenate([[0], ends]) * 4
                if off[-1] >= 1 << 31:
                    raise ValueError("one document's ids are larger than a binary value can be")
                cols.append(pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(off.astype(np.int32)),
                                                                           pa.py_buffer(f.ids(c).tobytes())]))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)


def read_ids(path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of all ids, for a trainer: the manifest gives
    the files, their chunk index the blocks, and only those are decoded. Places
    beyond the end give fewer ids."""
    fs, folder = open_folder(path)
    spec, out, at, stop = _manifest(fs, folder), [], 0, start + count
    for name, _, n in spec["files"]:
        if at < stop and at + n > start:
            f = PlaneFile(fs, f"{folder}/{name}", spec["planes"])
            a, b = max(start - at, 0), min(stop - at, n)
            c = int(np.searchsorted(f.first_id, a, "right")) - 1
            while c < len(f.chunks) and f.first_id[c] < b:
                first = int(f.first_id[c])
                out.append(f.ids(c, max(0, a - first), b - first))
                c += 1
        at += n
    return np.concatenate(out) if out else np.zeros(0, "<u4")


# --- documents -----------------------------------------------------------------------------

class SpaceCoder(bpe.WordCoder):
    """Ids of texts under a tokenizer whose words never cross white space.

    Texts are cut at ASCII white space, and plain words further into runs of letters, single digits and runs of
    other characters, as the tokenizer's own pattern does; words with an apostrophe, a special string or
    characters whose class or case is not plain stay whole. Each distinct piece is encoded by the tokenizers
    library once per task (a bounded cache)."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers
        tok = Tokenizer.from_str(spec)
        tok.no_truncation()
        tok.no_padding()
        self.encode = lambda w: tok.encode(w, add_special_tokens=False).ids
        # plain pieces are normal in lower case and one token of the pattern each: the model alone is enough
        bare = Tokenizer(tok.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(),
                                                      pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode_plain = lambda ws: bare.encode(" ".join(ws).lower(), add_special_tokens=False).ids
        vocab = tok.get_vocab()
        suffix = json.loads(spec)["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.special: dict[str, int] = {}
        self.hasher = textops.Hasher()
        self.cased = textops.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(textops._BASE))
        # classes of bytes: letters (also the bytes of two-byte letters), digits, others
        self.cls = np.full(256, 3, np.uint8)
        self.cls[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *PLAIN_LEADS]] = 1
        self.cls[0x30:0x3A] = 2
        self.odd = np.zeros(256, bool)
        self.odd[0xC0:] = True
        self.odd[[0x27, *PLAIN_LEADS]] = [True] + [False] * len(PLAIN_LEADS)
        self.reset()

    def _add(self, words: list[str]) -> int:
        """Put the words' ids into the cache; the number of the first. Plain pieces go to the library together,
        as each ends with an id that ends a word, the others one by one."""
        plain = np.fromiter((PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        at, parts, sizes, places = np.flatnonzero(plain), [], [], []
        for a in range(0, len(at), TOGETHER):
            some = at[a:a + TOGETHER]
            flat = np.array(self.encode_plain([words[i] for i in some.tolist()]), np.uint32)
            last = np.flatnonzero(self.ends[flat]) + 1
            if len(last) != len(some):
                plain[some] = False
                continue
            parts.append(flat)
            sizes.append(np.diff(last, prepend=0))
            places.append(some)
        for i in np.flatnonzero(~plain).tolist():
            parts.append(np.array(self.encode(words[i]), np.uint32))
            sizes.append(np.array([len(parts[-1])]))
            places.append(np.array([i]))
        flat, size, place = np.concatenate(parts), np.concatenate(sizes), np.concatenate(places)
        first, n = self.n, self.n + len(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.off):
            self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len))
        self.flat[self.used:self.used + len(flat)] = flat
        self.len[first + place] = size
        self.off[first + place] = self.used + np.cumsum(size) - size
        self.used, self.n = self.used + len(flat), n
        return first

    def rows(self, ids, col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """``(row, ids)`` for every row of a text column, in order."""
        for i, j, raw, off in textops.text_slices(col):
            if j == i + 1 and len(raw) > 2 * textops.SLICE:
                parts = [self._coded(raw[a:b], np.array([0, b - a]))[0] for a, b in space_parts(raw, self.hasher.sep)]
                yield i, np.concatenate(parts) if parts else np.zeros(0, np.uint32)
                continue
            flat, size, first = self._coded(raw, off)
            ends = np.concatenate([[0], np.cumsum(size)])
            for r in range(j - i):
                yield i + r, flat[ends[first[r]]:ends[first[r + 1]]]

    def _coded(self, raw: np.ndarray, off: np.ndarray):
        """Ids of all pieces, ids per piece, first piece of each text."""
        s, e, _, _ = self.hasher.words(raw, off)
        n = len(raw)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        odd = self.odd[raw]
        nxt = np.append(raw[1:], 0)
        odd |= (raw == 0x3C) & (nxt == 0x7C)  # may start a special string
        for a, b in NOT_LETTERS:
            odd |= (raw == a) & (nxt == b)
        seen = np.concatenate([[0], np.cumsum(odd)])
        whole = seen[e] > seen[s]
        edge = np.zeros(n + 1, np.int8)
        edge[s[whole]] += 1
        edge[e[whole]] -= 1
        kept = np.cumsum(edge[:n]).astype(bool)  # bytes of words that stay whole
        inside = ~self.hasher.sep[raw]
        k = self.cls[raw]
        cut = np.zeros(n, bool)
        cut[1:] = ((k[1:] != k[:-1]) | (k[1:] == 2)) & inside[1:] & inside[:-1] & ~kept[1:]
        cut[s] = True
        start = np.flatnonzero(cut)
        last = np.zeros(n + 1, bool)
        last[e] = True
        last[start[1:]] |= inside[start[1:] - 1]  # a piece also ends where the next begins
        end = np.flatnonzero(last)
        h = self.hasher.runs(np.where(kept, self.cased[raw], self.hasher.byte[raw]), start, end)
        flat, size = self.ids(_Bytes(raw), start, end, h)
        return flat, size, np.searchsorted(start, off)


#: first bytes of two-byte letters: Latin (U+00C0 to U+027F) and Cyrillic (U+0400 to U+047F) ...
PLAIN_LEADS = (*range(0xC3, 0xCA), 0xD0, 0xD1)
#: ... but for the multiplication and division signs, and the capital I with a dot, whose lower case is two characters
NOT_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
#: pieces that are one token of the pattern each: letters of these, a digit, printable others
PLAIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u027F\u0400-\u047F]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
TOGETHER = 2000  # plain pieces in one call of the library


class _Bytes:
    """Slices of a byte array as text."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw

    def __getitem__(self, at: slice) -> str:
        return self.raw[at].tobytes().decode("utf-8")


def space_parts(raw: np.ndarray, sep: np.ndarray, size: int = textops.SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end before a separator."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and not sep[raw[end]]:
            near = np.flatnonzero(sep[raw[end:end + 4096]])
            end = end + int(near[0]) if len(near) else min(end + 4096, len(raw))
        yield at, end
        at = end


def check_spaces(spec: str) -> None:
    """Raise unless words of this tokenizer end at white space."""
    s = json.loads(spec)
    pre = s["pre_tokenizer"]
    steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
    split = [p for p in steps if p["type"] == "Split"]
    drops = any(p["behavior"] == "Removed" and p["invert"] and "[^\\s" in p["pattern"].get("Regex", "") for p in split)
    prefix = any(p.get("add_prefix_space") for p in steps)
    if not drops or prefix or s["post_processor"] or any(t["lstrip"] or t["rstrip"] for t in s["added_tokens"]):
        raise ValueError("the tokenizer's words may cross white space")


def write_documents(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, planes: str = "byte",
                    id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every document, each followed by ``end_id``, to files of id planes in ``path`` (a new
    folder that all machines share), in ascending order of ``id_col``.

    Null and empty texts have the end id only; null ids come first. Rows that share an id stand in the order of
    the hash of their text, equal rows in any order (their entries are alike). Texts are whole however long; a
    document's ids must stay below 2 GiB. An empty table gives a manifest without files. Other columns are
    ignored. Rows are dealt by range of (id, text hash, place), so one id, or one row repeated, that makes up a
    third of the table spreads over many tasks; ``docs`` must come from a stored table, whose rows keep their
    places when a task is repeated."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.col("h").asc(), F.col("place").asc()]
    ranged = src.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
    docs.sparkSession.dataSource.register(PlaneSource)
    ranged.write.format("idplanes").options(tokenizer=tokenizer, planes=planes, end=end_id).mode("append").save(path)


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``id_col, start, n_tokens`` (and ``ids``, little-endian 32-bit binary) of every document in ``path``."""
    spark.dataSource.register(PlaneSource)
    return spark.read.format("idplanes").option("ids", str(with_ids).lower()).load(path).withColumnRenamed("id", id_col)


def token_file_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to files in the shared checkpoint folder, read them back, and return ``doc_id, start,
    n_tokens, ids_crc32`` of every document from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, f"idplanes-{uuid.uuid4().hex}")
    write_documents(docs, tokenizer, path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
