"""URL filters: pattern rules behind a rarest-token index.

A rule is a regular expression with the literal tokens that every matching URL
holds. Tokens are counted over all URLs of the table; each rule is filed under
its rarest token, so a URL fetches only the rules filed under one of its own
tokens, and only those run their expression. The rule list is the caller's
(bounded by ``MAX_RULES``), the counts are one row per rule token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULES = 100_000
#: ASCII letters and digits, in the lower-cased URL
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``host + '\\n' + path + '\\n' + url``; ``tokens``
    are literals (lower case, whole tokens) that each match implies."""

    name: str
    action: str  # allow or block
    pattern: str
    tokens: tuple[str, ...]
    weight: int  # the largest weight wins, then the smallest name
    listed: bool = False  # one of the caller's host/path rules


def host_rule(text: str, action: str) -> Rule:
    """``example.net/en/``: that host and its subdomains, paths from ``/en/`` on."""
    host, slash, path = text.partition("/")
    pattern = rf"\A(?:[^\n]*\.)?{re.escape(host)}\n{re.escape(slash + path)}"
    # a token at the end of the path may go on in the URL: it is not a whole token there
    tokens = re.findall(TOKEN, host.lower()) + re.findall(TOKEN + r"(?=[^a-z0-9])", path.lower())
    return Rule(text, action, pattern, tuple(tokens), len(text), True)


def word_rule(name: str, word_parts: str) -> Rule:
    """A blocking rule of the method: the dashed word as a whole host label."""
    tokens = tuple(re.findall(TOKEN, word_parts))
    return Rule(name, "block", rf"\A(?:[^\n]*\.)?{re.escape(word_parts)}(?:\.[^\n]*)?\n", tokens, 0)


LISTED = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"),
          host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]
#: Host labels of link farms and adult or gambling sites, blocked where no listed rule speaks.
SPAM_LABELS = ["spam-farm", "link-farm", "spam", "casino", "porn", "xxx", "viagra", "free-money", "cheap-pills"]
RULES = LISTED + [word_rule(f"label:{w}", w) for w in SPAM_LABELS]


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty without ``://``."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(u, "://")
    rest = F.substr(u, at + 3)
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.when(at > 0, host).otherwise(""), "path": F.when(at > 0, path).otherwise("")})


def token_counts(urls: DataFrame, tokens: Sequence[str], url_col: str = "url") -> dict[str, int]:
    """How many rows hold each of the rules' tokens, over the whole table: one
    map-side combined count per rule token (at most the rules' own tokens come
    to the driver)."""
    t = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(url_col), F.lit(""))), F.lit(f"({TOKEN})"), 1))
    hit = F.array_intersect(t, F.array(*[F.lit(x) for x in sorted(set(tokens))]))
    rows = urls.select(F.explode(hit).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """(rules by their rarest token, rules without a token)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    index: dict[str, list[int]] = {}
    always = []
    for i, r in enumerate(rules):
        if r.tokens:
            rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
            index.setdefault(rarest, []).append(i)
        else:
            always.append(i)
    return index, always


def judge_urls(urls: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """One row per URL: ``id_col, host, path, rule, verdict, matched``.

    ``rule`` is the winning listed rule's text (else null), ``matched`` the name
    of the rule that set the verdict (null: none, the verdict is allow). Null or
    empty URLs and URLs without ``://`` have empty host and path. Repeated rows
    give repeated results; an empty table gives none; other columns are ignored."""
    rules = list(rules)
    index, always = build_index(rules, token_counts(urls, [t for r in rules for t in r.tokens], url_col))
    schema = T.StructType([T.StructField("id", urls.schema[id_col].dataType), T.StructField("host", T.StringType()),
                           T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()),
                           T.StructField("verdict", T.StringType()), T.StructField("matched", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = re.compile(TOKEN).findall
        compiled = [re.compile(r.pattern) for r in rules]
        order = [(-r.weight, r.name) for r in rules]
        for b in batches:
            out = []
            for url, host, path in zip(b["url"], b["host"], b["path"]):
                url = url or ""
                mark = host.replace("\n", "\r")  # the line feed ends the host in the searched text
                text = f"{mark}\n{path}\n{url}"
                fetched = {i for t in set(find(url.lower())) for i in index.get(t, ())}
                won = [i for i in (*fetched, *always) if compiled[i].search(text)]
                listed = min((i for i in won if rules[i].listed), key=order.__getitem__, default=None)
                best = listed if listed is not None else min(won, key=order.__getitem__, default=None)
                out.append((rules[listed].name if listed is not None else None,
                            "allow" if best is None else rules[best].action,
                            None if best is None else rules[best].name))
            r = pd.DataFrame(out, columns=["rule", "verdict", "matched"], index=b.index).astype(object)
            yield pd.concat([b[["id", "host", "path"]], r], axis=1)

    split = split_url(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    return split.mapInPandas(run, schema).withColumnRenamed("id", id_col)
