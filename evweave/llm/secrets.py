"""Secret scans in DataFrame functions only.

Base kinds are regular expressions with code-point spans: the pieces between
matches (``split``) and the matches (``regexp_extract_all``) give every start as
a running length. The method adds ``entropy`` spans. The characters of base spans (kind
by kind, in order) and of allow-listed words are blanked, position by position; what
is left of a run of one character class is a candidate. It is walked with a window
whose Shannon entropy is kept by incremental counts: the counts of all characters
of the class stand in a few packed numbers, one goes down, one up, and the
entropy's sum moves by two table values. A candidate with a hot window is a span as
a whole, so redaction leaves nothing of it. A word or a base span inside a run
therefore hides nothing beside it.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256  # running lengths are summed per chunk, then over chunks


@dataclass(frozen=True)
class Kind:
    """A base kind: whole matches whose ``group`` has ``least`` characters or more."""

    name: str
    pattern: str
    group: int
    least: int


# Fixed values. A failing match of access or hex ends where its run of characters
# ends, so asking for the length in the pattern finds the same spans.
KINDS = [
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
]


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``pattern`` (of the characters ``letters``) that hold a
    match of every ``needs``; a window is hot from ``bits`` of entropy on."""

    name: str
    pattern: str
    needs: tuple[str, ...]
    bits: float
    letters: str


WINDOW = 24
CLASSES = [
    CharClass("hex", r"[0-9A-Fa-f]{24,}", (r"[0-9]", r"[A-Fa-f]"), 3.1, "0123456789ABCDEFabcdef"),
    CharClass("base64", r"[A-Za-z0-9+/_=-]{24,}", (r"[0-9]", r"[a-z]", r"[A-Z]"), 3.95,
              string.ascii_letters + string.digits + "+/_=-"),
]
RUN = r"[A-Za-z0-9+/_=-]{24}"  # in every candidate of every class
PIECE = 1 << 15  # characters of a candidate that are walked at once
SLOTS, BITS = 12, 5  # counts (at most WINDOW) in one packed number
#: Candidates that look random and are not secrets: identifiers in UUID form, digests named as such.
ALLOW_WHOLE = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|^[Ss][Hh][Aa](1|256|384|512)-"
#: Words that are no part of a secret, in either case: counting alphabets, placeholders.
ALLOW_WORDS = ("0123456789", "abcdefghijklm", "example", "placeholder", "changeme", "dummy", "xxxxxx")


def either_case(word: str) -> str:
    """The pattern of a word in either case (spelt out: engines fold letters differently)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value bound to a lambda variable: inside other lambdas
    an expression would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column) -> Column:
    """Exclusive running sums of an int array, in two levels so that long arrays
    stay cheap (an array append copies its array)."""
    def walk(arr: Column, zero: Column) -> Column:
        state = F.struct(F.array().cast("array<int>").alias("a"), zero.cast("int").alias("t"))
        return F.aggregate(arr, state, lambda s, x: F.struct(
            F.concat(s["a"], F.array(s["t"])).alias("a"), (s["t"] + x).cast("int").alias("t")))["a"]

    return _once(lengths, lambda x: _chunked(x, walk))


def _chunked(lengths: Column, walk) -> Column:
    n = F.size(lengths)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")),
                         lambda i: F.slice(lengths, i * CHUNK + 1, F.lit(CHUNK)))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: (a + x).cast("int")))
    return F.when(n > 0, F.flatten(F.zip_with(chunks, walk(sums, F.lit(0)), walk))).otherwise(
        F.array().cast("array<int>"))


def _located(text: Column, pattern: str) -> Column:
    """``array<struct<start, m>>`` of all matches of ``pattern`` (none: empty)."""
    p = F.lit(pattern)
    m = F.regexp_extract_all(text, p, F.lit(0))
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
    step = F.zip_with(before, m, lambda a, b: F.length(a) + F.length(b))
    # the running sum ends before piece i: add the piece itself
    return F.zip_with(F.zip_with(running(step), before, lambda o, a: (o + F.length(a)).cast("int")), m,
                      lambda s, x: F.struct(s.alias("start"), x.alias("m")))


def base_spans(text: Column, index: int, kind: Kind) -> Column:
    at = _located(text, kind.pattern)
    if kind.group:
        values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
        at = F.transform(F.filter(F.arrays_zip(at.alias("at"), values.alias("value")),
                                  lambda z: F.length(z["value"]) >= kind.least), lambda z: z["at"])
    spans = F.transform(at, lambda z: F.struct(z["start"].alias("start"), F.lit(index).alias("kind"),
                                               (z["start"] + F.length(z["m"])).alias("end")))
    return F.when(text.rlike(kind.pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def blank_base(text: Column, kind: Kind) -> Column:
    """``text`` with the characters of a kind's base matches turned to blanks, so places stay."""
    p = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(kind.group))
    mask = F.zip_with(whole, value, lambda m, v: F.when(F.length(v) >= kind.least, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    pieces = F.zip_with(F.split(text, kind.pattern, -1), mask, lambda a, m: F.concat(a, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(kind.pattern), F.array_join(pieces, "")).otherwise(text)


def blank_words(text: Column) -> Column:
    """``text`` with the characters of allow-listed words turned to blanks."""
    for word in ALLOW_WORDS:
        text = F.regexp_replace(text, either_case(word), " " * len(word))
    return text


def has_hot_window(s: Column, cls: CharClass, window: int = WINDOW) -> Column:
    """Whether some window of ``s``, a string of the class's characters, has the class's entropy.

    With f(c) = c log2 c, a window's entropy is log2 W - S / W for the sum S of f over its character counts, so
    S moves by one difference of f when a character leaves and one when a character enters. Long strings are
    walked in pieces that share ``window - 1`` characters, until one is hot."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(s) - window, F.lit(0)) / PIECE).cast("int"))
    pieces = F.transform(starts, lambda i: F.substring(s, i * PIECE + 1, F.lit(PIECE + window - 1)))
    return F.exists(pieces, lambda p: _walk(p, cls, window))


def _walk(piece: Column, cls: CharClass, window: int) -> Column:
    numbers = -(-len(cls.letters) // SLOTS)
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    most = window * (math.log2(window) - cls.bits)
    place = F.array(*[F.lit(cls.letters.find(chr(i))) for i in range(128)])
    none = F.struct(F.lit(0.0).alias("s"), *[F.lit(0).cast("long").alias(f"n{j}") for j in range(numbers)], F.lit(False).alias("hot"))

    def moved(codes: Column) -> Column:
        def step(st: Column, t: Column) -> Column:
            # even steps: the character that leaves (from the second window on); odd ones: the one that enters
            enters = t % 2 == 1
            i = F.floor(t / 2).cast("int")
            code = F.get(codes, F.when(enters, i).otherwise(i - window))
            return F.get(F.transform(F.array(F.struct(code.alias("c"), enters.alias("e"), i.alias("i"))), lambda x: counted(st, x)), F.lit(0))

        def counted(st: Column, x: Column) -> Column:
            number, shift = F.floor(x["c"] / SLOTS).cast("int"), (x["c"] % SLOTS * BITS).cast("int")
            held = st["n0"]
            for j in range(1, numbers):
                held = F.when(number == j, st[f"n{j}"]).otherwise(held)
            count = F.call_function("shiftright", held, shift).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
            sign = F.when(x["e"], 1).otherwise(-1)
            total = st["s"] - F.get(f, count) + F.get(f, count + sign)
            unit = F.call_function("shiftleft", sign.cast("long"), shift)
            kept = [F.when(number == j, st[f"n{j}"] + unit).otherwise(st[f"n{j}"]).alias(f"n{j}") for j in range(numbers)]
            after = F.struct(total.alias("s"), *kept, (st["hot"] | (x["e"] & (x["i"] >= window - 1) & (total <= most))).alias("hot"))
            return F.when(x["c"].isNull() | st["hot"], st).otherwise(after)

        return F.aggregate(F.sequence(F.lit(0), 2 * F.size(codes) - 1), none, step, lambda st: st["hot"])

    return _once(F.transform(F.split(piece, ""), lambda c: F.get(place, F.ascii(c))), moved)


def entropy_spans(clear: Column, index: int, cls: CharClass) -> Column:
    """The hot candidates of a class in a blanked text."""
    def wanted(z: Column) -> Column:
        ok = ~z["m"].rlike(ALLOW_WHOLE)
        for need in cls.needs:
            ok = ok & z["m"].rlike(need)
        return ok

    hot = F.filter(F.filter(_located(clear, cls.pattern), wanted), lambda z: has_hot_window(z["m"], cls))
    spans = F.transform(hot, lambda z: F.struct(z["start"].alias("start"), F.lit(index).alias("kind"),
                                                (z["start"] + F.length(z["m"])).alias("end")))
    return F.when(clear.rlike(cls.pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def kind_names() -> list[str]:
    return [k.name for k in KINDS] + ["entropy"]


def with_spans(docs: DataFrame, text_col: str = "text", base_col: str = "base_spans",
               span_col: str = "spans") -> DataFrame:
    """Add the base spans and all spans, each ``array<struct<start, kind, end>>``
    sorted by start, then kind (its place in ``kind_names()``); code points, end
    exclusive. Null and empty texts have no spans; repeated rows repeat theirs;
    columns of the two names are replaced, all others stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn(base_col, F.array_sort(F.concat(*[base_spans(text, i, k) for i, k in enumerate(KINDS)])))
    clear = _free(d, "blanked")
    # a text without a run of a candidate's length has no candidates: nothing of it is read again
    d = d.withColumn(clear, F.when(text.rlike(RUN), text).otherwise(""))
    for kind in KINDS:  # a column a step: a nested expression would be evaluated again wherever it occurs
        d = d.withColumn(clear, blank_base(F.col(clear), kind))
    d = d.withColumn(clear, blank_words(F.col(clear)))
    extra = F.array_distinct(F.concat(*[entropy_spans(F.col(clear), len(KINDS), c) for c in CLASSES]))
    return d.withColumn(span_col, F.array_sort(F.concat(F.col(base_col), extra))).drop(clear)


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(n) for n in kind_names()])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, n_entropy, base_sha256, spans`` per row
    (see :func:`with_spans`); an empty table gives no rows."""
    d = with_spans(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text", "b", "s")
    def count(index: int) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == index)).cast("long")

    counts = [count(i).alias(f"n_{n}") for i, n in enumerate(kind_names())]
    return d.select(F.col(id_col), *counts, F.sha2(spans_text(F.col("b")), 256).alias("base_sha256"),
                    spans_text(F.col("s")).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span (overlapping ones once) replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(st: Column, z: Column) -> Column:
        piece = F.when(z["start"] >= st["at"], F.array(F.substring(text, st["at"] + 1, z["start"] - st["at"]), F.lit(mask))
                       ).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(st["at"], z["end"]).alias("at"), F.concat(st["out"], piece).alias("out"))

    done = F.aggregate(spans, start, step, lambda st: F.concat(
        F.array_join(st["out"], ""), F.substring(text, st["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
