"""The queries of this subpackage, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, hybrid_rank, nbsvm, nce_lm, near_dup, orchard, packing, planes, rp_forest, secrets, shards, url_rules,
               voronoi)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _spam_sql() -> str:
    return "|".join(url_rules.SPAM_LABELS)


@query("op1_url_filter", rf"""
with u as (
  select page_id, case when strpos(coalesce(url,''), '://') > 0
                       then substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
r as (select *,
  case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
       when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
       when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from h)
select page_id, host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
       when regexp_matches(host, '(^|\.)({_spam_sql()})(\.|$)') then 'block' else 'allow' end as verdict
from r""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning listed rule and verdict of every page URL."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op6_rp_forest_neighbours")
def op6_rp_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found by cosine for every 50th vector, against all others."""
    return rp_forest.nearest_by_cosine(table(spark, sf_dir, "embeddings"))


SHARD_BYTES = 1 << 20


@query("op8_extendible_shards", f"""
with r as materialized (
  select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
    cast('0x' || substr(md5(concat_ws(chr(31), coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, '')))), 1, 15) as bigint) as h
  from documents),
lv as (select r.*, d, h >> (60 - d) as p from r, (select unnest(generate_series(0, 40)) as d)),
s as (select d, p, sum(n_bytes) as b from lv group by d, p having sum(n_bytes) <= {SHARD_BYTES} or min(h) = max(h)),
m as (select doc_id, n_bytes, min(s.d) as d, arg_min(s.p, s.d) as p, arg_min(s.b, s.d) as b
      from lv join s on lv.d = s.d and lv.p = s.p group by doc_id, n_bytes)
select doc_id, n_bytes, case when d = 0 then '' else lpad(bin(p), cast(d as int), '0') end as shard,
  cast(d as int) as depth, cast(b as bigint) as shard_bytes, b <= {SHARD_BYTES} as fits from m""")
def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document: hash buckets that split until they fit 1 MiB of text."""
    return shards.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op9_voronoi_top10", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings where vec_id is not null and embedding is not null
   and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10""")
def op9_voronoi_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every 100th vector with all others."""
    return voronoi.top_inner_products(table(spark, sf_dir, "embeddings"))


def _secrets_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def located(name: str, pattern: str, group: int, source: str = "d") -> str:
        """Rows (doc_id, i, start, m, value) of all matches of a pattern."""
        return (f"{name}_h as (select doc_id, regexp_extract_all(t, {quoted(pattern)}) as m, "
                f"regexp_extract_all(t, {quoted(pattern)}, {group}) as v, string_split_regex(t, {quoted(pattern)}) as p "
                f"from {source} where regexp_matches(t, {quoted(pattern)})), "
                f"{name}_i as (select *, unnest(range(1, len(m) + 1)) as i from {name}_h), "
                f"{name}_at as (select doc_id, m[i] as m, v[i] as v, list_sum(list_transform(p[1:i], lambda x: length(x))) + "
                f"coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s from {name}_i)")

    ctes = ["d as materialized (select doc_id, coalesce(text, '') as t from documents)"]
    ctes += [located(k.name, k.pattern, k.group) for k in secrets.KINDS]
    ctes.append("base as (" + " union all ".join(
        f"select doc_id, {i} as kind, s, s + length(m) as e from {k.name}_at where length(v) >= {k.least}"
        for i, k in enumerate(secrets.KINDS)) + ")")
    # base matches, kind by kind, and allow-listed words turned to blanks
    clear = "d"
    for k in secrets.KINDS:
        ctes.append(
            f"{k.name}_b as materialized (select doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || case when i > len(m) then '' "
            f"when length(v[i]) >= {k.least} then repeat(' ', length(m[i])) else m[i] end), '') as t from (select doc_id, "
            f"regexp_extract_all(t, {quoted(k.pattern)}) as m, regexp_extract_all(t, {quoted(k.pattern)}, {k.group}) as v, "
            f"string_split_regex(t, {quoted(k.pattern)}) as p from {clear}))")
        clear = f"{k.name}_b"
    words = "t"
    for word in secrets.ALLOW_WORDS:
        words = f"regexp_replace({words}, {quoted(secrets.either_case(word))}, '{' ' * len(word)}', 'g')"
    ctes.append(f"clear as materialized (select doc_id, {words} as t from {clear})")
    w = secrets.WINDOW
    for c in secrets.CLASSES:
        needs = " and ".join(f"regexp_matches(m, {quoted(n)})" for n in c.needs)
        ctes.append(located(c.name + "_c", c.pattern, 0, "clear"))
        ctes.append(
            f"{c.name}_w as (select doc_id, s, m, unnest(range(0, length(m) - {w - 1})) as o from {c.name}_c_at "
            f"where {needs} and not regexp_matches(m, {quoted(secrets.ALLOW_WHOLE)})), "
            f"{c.name}_x as (select doc_id, s, length(m) as n, string_split(substr(m, cast(o + 1 as bigint), {w}), '') as ch from {c.name}_w), "
            f"{c.name}_s as (select distinct doc_id, s, s + n as e from {c.name}_x where log2({w}) - list_sum(list_transform(list_distinct(ch), "
            f"lambda x: len(list_filter(ch, lambda y: y = x)) * log2(len(list_filter(ch, lambda y: y = x))))) / {w} >= {c.bits})")
    ctes.append("extra as (" + " union ".join(f"select doc_id, {len(secrets.KINDS)} as kind, s, e from {c.name}_s"
                                              for c in secrets.CLASSES) + ")")
    names = "case kind " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(secrets.kind_names())) + " end"
    ctes.append(f"spans as (select doc_id, kind, s, e, {names} || ':' || cast(s as bigint) || ':' || cast(e as bigint) as x "
                "from (select * from base union all select * from extra))")
    return "with " + ",\n".join(ctes) + (
        "\nselect d.doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, "
        "count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 3) as n_entropy, "
        f"sha256(coalesce(string_agg(x, ',' order by s, kind, e) filter (kind < {len(secrets.KINDS)}), '')) as base_sha256, "
        "coalesce(string_agg(x, ',' order by s, kind, e), '') as spans "
        "from d left join spans using (doc_id) group by d.doc_id")


@query("op10_secret_scan", _secrets_sql())
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and entropy spans of secrets in every document."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def byte_bpe() -> str:
    """The tokenizer file of the queries (a parameter of the operators)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece of every document, 1024 tokens a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


@query("op7_bpe_round_trip")
def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), byte_bpe(), decode=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def _dedup_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
with w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') as w
  from documents),
sh as materialized (
  select distinct doc_id, unnest(case when len(w) >= 5
    then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as materialized (select doc_id, count(*) as n from sh group by doc_id),
ij as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as materialized (select a, b from ij join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as materialized (select a, b from link union all select b, a from link),
reach as (
  with recursive r(a, b) as (select doc_id, doc_id from n union select r.a, l.b from r join both_ways l on r.b = l.a)
  select a, min(b) as component from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(reach.component, d.doc_id) as component_id,
  coalesce(reach.component, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join reach on reach.a = d.doc_id"""


@query("op2_minhash_near_dup", _dedup_sql())
def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("class_key", "group_key")


@query("op4_nbsvm_quality")
def op4_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score_quality(docs, nbsvm.fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op3_nce_lm_scores")
def op3_nce_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document."""
    return nce_lm.score_texts(table(spark, sf_dir, "documents"))


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


@query("op11_hybrid_rank", f"""
with c as materialized (
  select doc_id, row_number() over () as r, t, cast(len(t) as bigint) as n
  from (select doc_id, {_TERMS} as t from documents where text is not null) where len(t) > 0),
s as materialized (select count(*) as docs, cast(sum(n) as bigint) as terms from c),
q as materialized (
  select item_id, qr, term, count(*) as times
  from (select item_id, row_number() over () as qr, unnest({_TERMS}) as term from benchmark where text is not null) group by all),
p as materialized (select r, term, count(*) as tf from (select r, unnest(t) as term from c)
  where term in (select term from q) group by all),
w as materialized (
  select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from p, s group by term, docs),
m as (select doc_id, r, 25 + (75 * n * docs) // terms as m from c, s),
e as (select item_id, qr, r, doc_id, cast(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from q join p using (term) join w using (term) join m using (r) group by all),
k as (select *, row_number() over (partition by qr order by score desc, doc_id) as rank from e where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from k where rank <= 10""")
def op11_hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents of highest lexical score for every benchmark item."""
    return hybrid_rank.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def word_bpe() -> str:
    """The tokenizer file of op12 (a parameter of the operator)."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op12_id_planes")
def op12_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from files of id planes."""
    return planes.token_file_digests(table(spark, sf_dir, "documents"), word_bpe())


def _clusters_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    ctes = [f"""x as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as bigint)) as v
  from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0)""",
            f"""c0 as materialized (
  select row_number() over (order by coalesce(sha256('{seed}:' || vec_id), '~'), v) - 1 as c, v from x
  qualify c < {k})"""]

    def assigned(i: int) -> str:
        return f"""a{i} as materialized (
  select r, arg_min(c, [d, c]) as c, min(d) as d
  from (select x.r, c.c, cast(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
        from x, c{i} c) group by r)"""

    for i in range(rounds):
        ctes.append(assigned(i))
        # floor of a quotient of integers, whatever the sign
        ctes.append(f"""s{i} as materialized (
  select c, j, cast(sum(v[j]) as bigint) as s, count(*) as n
  from (select a{i}.c, x.v, unnest(range(1, {dim + 1})) as j from x join a{i} using (r)) group by c, j)""")
        ctes.append(f"""c{i + 1} as materialized (
  select c{i}.c, coalesce(m.v, c{i}.v) as v from c{i} left join (
    select c, list((s - ((s % n) + n) % n) // n order by j) as v from s{i} group by c) m using (c))""")
    ctes.append(assigned(rounds))
    return "with " + ",\n".join(ctes) + f"""
select vec_id, cast(c as int) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join x using (r) join c{rounds} using (c)"""


@query("op13_orchard_clusters", _clusters_sql())
def op13_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroid and squared distance of every 64-component vector after five rounds."""
    return orchard.cluster(table(spark, sf_dir, "embeddings"))
