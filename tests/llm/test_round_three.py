"""Ranked search, id-plane files and centroid clustering against brute force."""

import collections
import hashlib
import json
import math
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from evweave.llm import hybrid_rank, orchard, planes  # noqa: E402
from evweave.session import scratch_path  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, rank int, term string, score double, q int, id string, place long"
ITEMS = "item_id long, text string, doc_id string, rank int, q long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0.5, 2, "y", 3) for i, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 7) for i, t in rows], ITEMS)


def some_texts(seed, n, most=80):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "GAMMA", "été", "naïve", "漢字", "don't", "12-34", "😀", "end.", "the", "the", "the", "of", "of",
             "Straße", "ÀB", "x\x00y", "foo_bar"] + [f"w{i}" for i in range(60)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, most))) for _ in range(n)]


# --- op11 ---------------------------------------------------------------------------------

def brute_rank(docs, items, k):
    bags = [(i, collections.Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        ask = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        hits = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * b[w] // (1000 * b[w] + 8 * m))
                    for w, c in ask.items() if w in b)
            if s > 0:
                hits.append((i, s))
        hits.sort(key=lambda t: (-t[1], t[0] is None, t[0] or 0))
        out += [(item, r + 1, i, s) for r, (i, s) in enumerate(hits[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **kw):
    got = hybrid_rank.rank_documents(docs_of(spark, docs), items_of(spark, items), **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("segment,chunk,terms", [(1 << 23, 512, 1 << 18), (400, 3, 20)])
def test_ranks_equal_brute_force(spark, monkeypatch, segment, chunk, terms):
    monkeypatch.setattr(hybrid_rank, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(hybrid_rank, "CHUNK", chunk)
    monkeypatch.setattr(hybrid_rank, "BLOCK_TERMS", terms)
    docs = list(enumerate(some_texts(1, 150)))
    docs += [(1000 + i, "the alpha of w1") for i in range(40)]  # equal scores
    docs += [(5, docs[5][1]), (None, "the alpha of w1"), (2000, None), (2001, ""), (2002, "  \t- ")]
    random.Random(2).shuffle(docs)
    items = [(i, t) for i, t in enumerate(some_texts(3, 25, 12))]
    items += [(90, None), (91, ""), (92, "the the the of"), (93, "unknownterm"), (94, "ALPHA alpha w1"), (94, "ALPHA alpha w1"),
              (None, "w1 w2")]
    assert ranked(spark, docs, items, k=10) == brute_rank(docs, items, 10)


def test_rank_small_and_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == []
    assert ranked(spark, [(1, "a")], []) == []
    assert ranked(spark, [(1, None)], [(1, "a")]) == []
    docs, items = [(1, "a b"), (2, "b")], [(7, "a b")]
    assert ranked(spark, docs, items) == brute_rank(docs, items, 10)


def test_rank_takes_whole_long_texts(spark):
    long = "x " * 700_000 + "needle"
    docs = [(1, long), (2, "needle in hay"), (3, "hay " * 50)]
    items = [(1, "needle hay")]
    assert ranked(spark, docs, items) == brute_rank(docs, items, 10)


def test_hybrid_search_skips_and_stays_exact():
    rng = np.random.default_rng(5)
    n, k = 20_000, 10
    lists = []
    for size, scale in ((15, 900), (40, 800), (9000, 30), (15000, 20)):
        doc = np.sort(rng.choice(n, size, replace=False))
        lists.append((doc, rng.integers(1, scale, size)))
    total = np.zeros(n, np.int64)
    for d, s in lists:
        total[d] += s
    lists.sort(key=lambda x: len(x[0]))
    doc, score, looked = hybrid_rank.best_of(lists, n, k, 1)
    kth = np.sort(total)[-k]
    assert sorted(zip(doc.tolist(), score.tolist())) == sorted((int(d), int(total[d])) for d in np.flatnonzero(total >= kth))
    assert looked < 0.1 * np.count_nonzero(total)  # the long lists are skipped


# --- op12 ---------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, "<u4"), np.zeros(5, "<u4"), np.array([2 ** 32 - 1, 0, 7], "<u4"),
                rng.integers(0, 49408, 1000).astype("<u4"), rng.integers(0, 70000, 65536).astype("<u4")):
        got = planes.join_planes(planes.split_planes(ids, kind), len(ids), kind)
        assert got.dtype == np.dtype("<u4") and (got == ids).all()


def coded(texts):
    tok = Tokenizer.from_file(PATH)
    return [e.ids + [2] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_documents():
    rng = random.Random(4)
    texts = some_texts(6, 60)
    texts += ["", "   ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "don't I'LL we've 's", "ΑΣ ΣΑΣ σ", "é ́x",
              "a\x1cb\x85c d e", "tab\tnew\nline\r\n", "ﬁ Ⅷ ½ ١٢٣", "x" * 3000, "가각 한", "퟿"]
    texts.append(" ".join(rng.choice(texts[:40]) for _ in range(9000)))  # longer than a slice
    docs = [(i * 3 - 20, t) for i, t in enumerate(texts)] + [(7, None), (500, "same"), (500, "same"), (500, "other"), (None, "last")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("kind,small", [("byte", True), ("bit", False)])
def test_files_hold_all_documents_in_order(spark, monkeypatch, kind, small):
    if small:
        for name, value in (("BLOCK", 64), ("CHUNK_IDS", 500), ("CHUNK_DOCS", 9), ("FILE_IDS", 5000)):
            monkeypatch.setattr(planes, name, value)
    docs = odd_documents()
    path = scratch_path(spark, f"planes-{uuid.uuid4().hex}")
    stored = scratch_path(spark, f"docs-{uuid.uuid4().hex}")
    docs_of(spark, docs).repartition(5).write.parquet(stored)
    planes.write_documents(spark.read.parquet(stored), PATH, path, planes=kind)
    got = planes.read_documents(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    want = collections.Counter((i, tuple(e)) for (i, _), e in zip(docs, coded([t for _, t in docs])))
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    ends = np.cumsum([r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == [0, *ends[:-1].tolist()]
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    bare = planes.read_documents(spark, path, with_ids=False).orderBy("start").collect()
    assert [tuple(r) for r in bare] == [tuple(r)[:3] for r in got]
    # any range through the chunk index
    flat = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    rng = random.Random(8)
    for _ in range(30):
        a, n = rng.randrange(len(flat)), rng.choice([0, 1, 63, 700, 10 ** 7])
        assert (planes.read_ids(path, a, n) == flat[a:a + n]).all()


def test_digests_and_empty_table(spark):
    docs = docs_of(spark, odd_documents())
    rows = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in planes.token_file_digests(docs, PATH).collect()}
    all_docs = odd_documents()
    assert rows == {(i, len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
                    for (i, _), e in zip(all_docs, coded([t for _, t in all_docs]))}
    assert planes.token_file_digests(docs.limit(0), PATH).count() == 0


def test_only_committed_files_are_read(spark):
    path = scratch_path(spark, f"planes-{uuid.uuid4().hex}")
    planes.write_documents(docs_of(spark, [(1, "a b"), (2, "c")]), PATH, path)
    fs, folder = planes.open_folder(path)
    with fs.open_output_stream(f"{folder}/part-000000-0000-stray.idp") as f:  # a lost attempt
        f.write(b"half a file")
    assert planes.read_documents(spark, path).count() == 2
    with pytest.raises(Exception, match="already"):
        planes.write_documents(docs_of(spark, [(1, "a")]), PATH, path)


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with pytest.raises(ValueError):
        planes.check_spaces(spec)
    with open(PATH, encoding="utf-8") as f:
        bad = json.load(f)
    bad["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        planes.check_spaces(json.dumps(bad))


def test_every_character_between_words():
    """Cutting at ASCII white space gives the library's ids, whatever stands beside it."""
    with open(PATH, encoding="utf-8") as f:
        coder = planes.SpaceCoder(f.read())
    points = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts = ["a " + " ".join(points[a:a + 97]) + "\tB" + "\n".join(points[a:a + 31]) for a in range(0, len(points), 97)]
    got = [ids.tolist() for _, ids in coder.rows(None, pa.array(texts))]
    assert got == [e[:-1] for e in coded(texts)]


# --- op13 ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, v int, id string, cluster string, distance double"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 0.5) for i, v in rows], VECTORS)


def brute_clusters(rows, k, rounds, dim, scale, seed):
    good = [(i, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]

    def key(t):
        return (hashlib.sha256(f"{seed}:{t[0]}".encode()).hexdigest() if t[0] is not None else "~", t[1])

    c = [v for _, v in sorted(good, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v in good:
            held[near(v)[1]].append(v)
        for j, vs in held.items():
            c[j] = tuple(sum(x) // len(vs) for x in zip(*vs))
    at = [(i, *near(v)) for i, v in good]
    per = collections.Counter()
    for _, d, j in at:
        per[j] += d
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for i, d, j in at), key=repr)


def odd_rows(seed=1, n=300, dim=6):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(3 * (i % 5), 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, [0.25] * dim) for i in range(120)]               # one vector many times: equal centroids, ties
    rows += [(n + 200 + i, [float(i % 3)] * dim) for i in range(30)]  # exact ties between centroids
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (900, None), (901, [1.0]), (902, [math.nan] * dim),
             (903, [math.inf] * dim), (904, [None] * dim), (905, [1.0] * (dim + 1)), (906, [])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,rounds", [(12, 5), (1, 2), (400, 1)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows = odd_rows()
    got = orchard.cluster(vectors_of(spark, rows), k=k, rounds=rounds, dim=6, scale=16).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows, k, rounds, 6, 16, 2)


def test_cluster_small_and_empty_tables(spark):
    got = orchard.cluster(vectors_of(spark, odd_rows()).limit(0), dim=6)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert orchard.cluster(vectors_of(spark, [(1, None), (2, [1.0])]), dim=6).count() == 0
    one = orchard.cluster(vectors_of(spark, [(1, [1.0, -0.001])]), dim=2).collect()
    assert [tuple(r)[:5] for r in one] == [(1, 0, 0, 0, 0)]


def test_cluster_refuses_what_does_not_fit(spark):
    with pytest.raises(Exception, match="beyond"):
        orchard.cluster(vectors_of(spark, [(1, [1e30, 0.0]), (2, [1.0, 1.0])]), dim=2).collect()


def test_orchard_search_looks_at_few_centroids():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-1000, 1000, (200, 2))
    x = centroids[rng.integers(0, 200, 3000)] + rng.integers(-20, 20, (3000, 2))
    best, near, looked = orchard.Orchard(centroids).assign(x)
    d = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (near == d.min(1)).all()
    assert looked < 0.35 * d.size
