"""URL filtering with a bit-parallel wildcard automaton."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.common import kept_in_worker

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Fits host and its subdomains where the url's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path


class Glob(NamedTuple):
    """Over host + path; `*` and `?` stay within a part between slashes, `**` doesn't."""

    verdict: str
    pattern: str


#: The fixed rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Advertising and tracking places, judged where no rule fits; all else is allowed.
GLOBS = (Glob("block", "ads.**"), Glob("block", "**/ads/**"), Glob("block", "**/track?r/**"))


class Automaton:
    """All patterns side by side in words of 64 bits (Shift-And with self-loops).

    A pattern of m symbols has m + 1 bits: bit i is set while some way of
    reading the text so far has matched its first i symbols. A wildcard run is
    a self-loop on the bit before it. Start bits are in no symbol's mask, so a
    shift from one pattern's last bit into the next pattern's start is lost.
    """

    def __init__(self, patterns: Sequence[str]):
        start, loop_any, loop_part, accept = 0, 0, 0, []
        literal: dict[int, int] = {}
        single, at = 0, 0
        for p in patterns:
            start |= 1 << at
            i = 0
            while i < len(p):
                if p.startswith("**", i):
                    loop_any |= 1 << at
                    i += 2
                    continue
                if p[i] == "*":
                    loop_part |= 1 << at
                else:
                    at += 1
                    if p[i] == "?":
                        single |= 1 << at
                    else:
                        literal[ord(p[i])] = literal.get(ord(p[i]), 0) | 1 << at
                i += 1
            accept.append(at)
            at += 1
        self.words = at // 64 + 1
        self.start, self.loop_any, self.accept = self._pack(start), self._pack(loop_any), accept
        self.symbols = np.array(sorted({*literal, ord("/")}), np.uint32)
        rows = [literal.get(int(c), 0) | (0 if c == ord("/") else single) for c in self.symbols] + [single]
        loops = [0 if c == ord("/") else loop_part for c in self.symbols] + [loop_part]
        self.masks = np.array([self._pack(x) for x in rows])
        self.loops = np.array([self._pack(x | loop_any) for x in loops])

    def _pack(self, bits: int) -> np.ndarray:
        return np.array([bits >> 64 * k & (1 << 64) - 1 for k in range(self.words)], np.uint64)

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean matrix: does text i match pattern j as a whole?"""
        codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(codes[i]))
        sizes = np.array([len(codes[i]) for i in order], np.int64)
        state = np.tile(self.start, (len(texts), 1))
        if len(texts):
            flat = np.concatenate([codes[i] for i in order])
            at = np.searchsorted(self.symbols, flat)
            at[(at == len(self.symbols)) | (self.symbols[np.minimum(at, len(self.symbols) - 1)] != flat)] = len(self.symbols)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for k in range(int(sizes[0])):
                live = int(np.searchsorted(-sizes, -k, "left"))  # texts longer than k
                c, d = at[first[:live] + k], state[:live]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                state[:live] = moved & self.masks[c] | d & self.loops[c]
        out = np.empty((len(texts), len(self.accept)), bool)
        back = np.empty(len(texts), np.int64)
        back[order] = np.arange(len(texts))
        for j, bit in enumerate(self.accept):
            out[:, j] = (state[back, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(bool)
        return out


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[Glob] = GLOBS, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Host, path, rule and verdict of each row.

    The longest fitting rule decides (the first listed among equals). Without
    one, rule is null and the globs decide: block if any blocking glob matches
    and no allowing one does, else allow. A null url or one without :// has an
    empty host and path, which no rule fits. Rows that repeat are each judged;
    an empty table gives an empty result; other columns are ignored.
    """
    rules = sorted(rules, key=lambda r: -len(r.label))
    patterns = [p for r in rules for p in (f"{r.host}{r.path}**", f"*.{r.host}{r.path}**")] + [g.pattern for g in globs]
    blocking = np.array([g.verdict == "block" for g in globs], bool)

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        automaton = kept_in_worker(("globs", *patterns), lambda: Automaton(patterns))
        found = automaton.match(list(host + path))
        by_rule = found[:, : 2 * len(rules)].reshape(-1, len(rules), 2).any(axis=2)
        by_glob = found[:, 2 * len(rules) :]
        fits, best = by_rule.any(axis=1), by_rule.argmax(axis=1)
        blocked = by_glob[:, blocking].any(axis=1) & ~by_glob[:, ~blocking].any(axis=1)
        return pd.DataFrame({
            "rule": [rules[b].label if f else None for f, b in zip(fits, best, strict=True)],
            "verdict": [rules[b].verdict if f else ("block" if x else "allow") for f, b, x in zip(fits, best, blocked, strict=True)],
        })

    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return rows.withColumn("_j", judged("host", "path")).select(*keep, "host", "path", "_j.rule", "_j.verdict")


ORACLE = """
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
  coalesce(arg_max(verdict, length(rule)),
    CASE WHEN starts_with(host, 'ads.') OR contains(path, '/ads/') OR regexp_matches(path, '/track[^/]r/', 's') THEN 'block' ELSE 'allow' END) AS verdict
FROM m GROUP BY page_id, host, path
"""
