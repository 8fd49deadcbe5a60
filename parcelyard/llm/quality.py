"""Quality rules: how much of a text repeats itself."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most that may lie in repeats, as a share of the text's word characters, by words in the repeated run.
MOST_REPEATED: Mapping[int, float] = {3: 0.30, 5: 0.20, 10: 0.15}
#: The most word characters in repeated lines, as a share of all, and the most symbols for each word.
MOST_LINE_CHARS, MOST_SYMBOLS = 0.20, 0.10
SYMBOLS = b"#*$%&|<>"
BASE_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30
#: Bytes of text that are measured at once in a task; one longer text is measured alone.
BATCH_BYTES = 3_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x, dtype=np.uint64)


class Windows:
    """Rolling hashes of word runs of any length within each text, modulo 2 ** 64."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        self.ids, self.doc = ids, doc
        values = _mix(ids.astype(np.uint64) + np.uint64(1))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(ids)), dtype=np.uint64)])
        self.shift = _powers(_INVERSE, len(ids) + 1)

    def repeats(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of runs that equal an earlier run of their text, and of the runs that they equal first.

        Runs with equal hashes count as equal only if their words are.
        """
        last = len(self.ids) - n + 1
        if last < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        key = (self.sums[at + n] - self.sums[at]) * self.shift[at]
        key = _mix(key ^ _mix(self.doc[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        ok = self.doc[at[same]] == self.doc[at[same - 1]]
        for j in range(n):
            ok &= self.ids[at[same] + j] == self.ids[at[same - 1] + j]
        return at[same[ok]], at[same[ok] - 1]


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    edge = np.bincount(starts, minlength=total + n + 1).astype(np.int64)
    edge[n:] -= edge[: len(edge) - n].copy()
    return np.cumsum(edge)[:total] > 0


def measure(texts: list[str | None]) -> pd.DataFrame:
    """The counts and the verdict of each text; a null text has no words."""
    raw = [(t or "").encode() for t in texts]
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    found = [np.array([number[w] for w in b.split()], np.int64) for b in raw]
    sizes = np.array([len(x) for x in found], np.int64)
    n, total = len(raw), int(sizes.sum())
    ids = np.concatenate([*found, np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(n), sizes)
    bytes_of = np.frombuffer(b"".join(number), np.uint8)
    ends = np.cumsum([len(w) for w in number]).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(bytes_of & 0xC0 != 0x80)])
    chars = (heads[ends] - np.concatenate([[0], heads[ends]])[:-1]) if len(ends) else np.zeros(0, np.int64)
    word_chars = chars[ids] if total else np.zeros(0, np.int64)
    in_words = np.bincount(doc, word_chars, n).astype(np.int64)
    runs = Windows(ids, doc)
    again, first = runs.repeats(BASE_WINDOW)
    repeated = _covered(np.concatenate([again, first]), BASE_WINDOW, total)
    n_repeat = np.bincount(doc, repeated, n).astype(np.int64)
    bad = np.zeros(n, bool)
    shares = {}
    for k, most in MOST_REPEATED.items():
        inside = np.bincount(doc, _covered(runs.repeats(k)[0], k, total) * word_chars, n)
        shares[f"repeat_{k}"] = inside / np.maximum(in_words, 1)
        bad |= shares[f"repeat_{k}"] > most
    symbols, dup_lines, dup_chars = (np.zeros(n, np.int64) for _ in range(3))
    for i, b in enumerate(raw):
        symbols[i] = len(b) - len(b.translate(None, SYMBOLS))
        own = [x for x in b.split(b"\n") if x.strip()]
        if len(set(own)) < len(own):
            seen: set[bytes] = set()
            for x in own:
                if x in seen:
                    dup_lines[i] += 1
                    dup_chars[i] += len(b"".join(x.split()).decode())
                seen.add(x)
    bad |= dup_chars > MOST_LINE_CHARS * in_words
    bad |= symbols > MOST_SYMBOLS * sizes
    failed = (sizes < BASE_WORDS) | (100 * n_repeat > BASE_PERCENT * sizes)
    return pd.DataFrame({
        "n_words": sizes, "word_chars": in_words, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~(failed | bad), **shares,
    })


def _in_parts(texts: pd.Series) -> Iterator[pd.DataFrame]:
    part: list[str | None] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held > BATCH_BYTES:
            yield measure(part)
            part, held = [], 0
    if part or not len(texts):
        yield measure(part)


def rate(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the base counts, base_failed, kept, and the shares in repeats.

    A repeat is a run of 3, 5 or 10 words that equals an earlier run of its
    text; its characters count once. A text is kept unless the base rule fails
    it or too many of its characters lie in repeats or in repeated lines, or it
    has too many symbols. Null and empty texts have no words and fail. Every row
    is judged by itself, repeated rows too.
    """
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean" + "".join(f", repeat_{k} double" for k in MOST_REPEATED)

    @F.pandas_udf(schema)
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.concat(list(_in_parts(texts)), ignore_index=True)

    return docs.select(*keep, rated(F.col(text)).alias("_r")).select(*keep, "_r.*")
