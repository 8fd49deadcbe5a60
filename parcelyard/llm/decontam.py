"""Benchmark decontamination: BM25 over an index of the test items, with block-max WAND.

Every passage of the training texts is a query against the items. A score is a
share of what the item scores against itself, so one threshold serves all.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.common import kept_in_worker, saved

K1, B = 1.2, 0.75
#: Items in a block with its own maximum for each term.
BLOCK = 8
#: Least share of its own score at which an item is retrieved for a passage.
RETRIEVE = 0.7
#: Words in a shingle, and the share of shingles, of an item or of both its halves, that makes a leak.
SHINGLE, OVERLAP = 5, 0.8
#: Characters of items in one index; more items make more indexes, each run over all passages. The blocks' maxima of one
#: (terms x blocks) take some 30 MB; kept as lists of the blocks that have a term they took five times the CPU seconds.
INDEX_CHARS = 500_000
#: Half a passage has at least so many words, or PARTED more than the longest item.
LEAST_STRIDE = 32
#: Words between the halves of an item that a passage has room for, even of the longest.
PARTED = 16
BATCH_CHARS = 2_000_000
CACHE_WORDS = 300_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _term(word: bytes) -> str:
    """Lower-cased, without what isn't a letter or digit at its ends."""
    w = word.decode().lower()
    if w.isalnum():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


class _Numbers(dict[bytes, int]):
    """Term number by word as written: -1 outside the items' words, -2 without a letter or digit."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        term = _term(word)
        self[word] = out = self.vocab.get(term, -1) if term else -2
        return out


def terms(text: str) -> list[str]:
    return [t for w in text.encode().split() if (t := _term(w))]


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    """Runs of SHINGLE words; fewer words are one run; none, no run."""
    if len(ids) <= SHINGLE:
        return {tuple(ids)} if ids else set()
    return {tuple(ids[i : i + SHINGLE]) for i in range(len(ids) - SHINGLE + 1)}


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: all sentences but the last and the last, or two halves of one sentence."""
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1:
        return terms(" ".join(parts[:-1])), terms(parts[-1])
    words = terms(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


class Index:
    """Postings by term in order of item, with the maximum of each term and of each term's blocks.

    df (items with a term), n (items), mean and longest (words of an item) are
    those of all items, of which these may be a part.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float, longest: int):
        # (items of like length share blocks: their impacts are alike)
        self.items = sorted(((i, w, t) for i, t in items if (w := terms(t))), key=lambda x: (len(x[1]), x[0], x[2]))
        self.ids = [i for i, _, _ in self.items]
        self.vocab: dict[str, int] = {}
        self.words = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for _, words, _ in self.items]
        split = [[[self.vocab.get(w, -1) for w in h] for h in halves(t)] for _, _, t in self.items]
        self.shingles = [(shingles(w), shingles(q), shingles(a)) for w, (q, a) in zip(self.words, split, strict=True)]
        self.stride = max(LEAST_STRIDE, PARTED + longest)
        idf = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in self.vocab]
        self.postings: list[list[int]] = [[] for _ in self.vocab]
        self.impacts: list[list[float]] = [[] for _ in self.vocab]
        self.block_max = np.zeros((len(self.vocab), -(-len(self.items) // BLOCK)), np.float32)
        for j, w in enumerate(self.words):
            weights = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
            own = math.fsum(weights.values())
            for t, x in weights.items():
                self.postings[t].append(j)
                self.impacts[t].append(x / own)
                self.block_max[t, j // BLOCK] = max(self.block_max[t, j // BLOCK], np.float32(x / own) * np.float32(1 + 1e-6))
        self.most = self.block_max.max(axis=1, initial=0)
        self.known = _Numbers(self.vocab)

    def numbers(self, text: str) -> np.ndarray:
        known = self.known
        x = np.array([known[w] for w in text.encode().split()], np.int32)
        return x[x != -2]

    def wand(self, query: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """Items of a block that score at least `least`, document at a time with pivots."""
        first, last = block * BLOCK, min((block + 1) * BLOCK, len(self.ids))
        cursors = []
        for t in query:
            at = bisect_left(self.postings[t], first)
            if at < len(self.postings[t]) and self.postings[t][at] < last:
                cursors.append([self.postings[t][at], at, t])
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += float(self.block_max[t, block])
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = math.fsum(self.impacts[t][at] for d, at, t in cursors if d == item)  # the same in any order of terms
                if score >= least:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            moved = []
            for d, at, t in cursors:
                if d < to:
                    at = bisect_left(self.postings[t], to, at)
                    if at == len(self.postings[t]) or self.postings[t][at] >= last:
                        continue
                    d = self.postings[t][at]
                moved.append([d, at, t])
            cursors = moved
        return out

    def search(self, texts: list[str]) -> list[tuple[int, int, float, float, float, float]]:
        """Leaks as (text, item, score, overlap, question overlap, answer overlap)."""
        if not self.ids or not texts:
            return []
        docs = [self.numbers(x) for x in texts]
        sizes = np.array([len(d) for d in docs], np.int64)
        windows = np.maximum(-(-sizes // self.stride), 1)  # of two strides; the last may be one
        base = np.cumsum(windows) - windows
        flat = np.concatenate(docs).astype(np.int64)
        own = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = own // self.stride
        lead = np.repeat(base, sizes)
        hit = flat >= 0
        n = len(self.vocab)
        k1 = (lead + at)[hit] * n + flat[hit]
        again = hit & (at > 0)
        k2 = (lead + at - 1)[again] * n + flat[again]
        key = np.unique(np.concatenate([k1, k2]))
        window, term = key // n, key % n
        # WAND's bound, then the blocks' bounds, for all passages at once
        bound = np.bincount(window, self.most[term], int(windows.sum()))
        live = bound[window] >= RETRIEVE
        window, term = window[live], term[live]
        if not len(window):
            return []
        heads = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        tails = np.append(heads[1:], len(window))
        for part in range(0, len(heads), 4096):
            h, e = heads[part : part + 4096], tails[part : part + 4096]
            sums = np.add.reduceat(self.block_max[term[h[0] : e[-1]]], h - h[0], axis=0)
            for w, block in zip(*np.nonzero(sums >= RETRIEVE), strict=True):
                number = int(window[h[w]])
                found = self.wand(term[h[w] : e[w]].tolist(), int(block), RETRIEVE)
                if not found:
                    continue
                d = int(np.searchsorted(base, number, "right")) - 1
                start = (number - int(base[d])) * self.stride
                words = docs[d][start : start + 2 * self.stride].tolist()
                for item, score in found:
                    whole, question, answer = self.shingles[item]
                    sets = {k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} for k in {len(x) for s in self.shingles[item] for x in s}}
                    share = lambda s, sets=sets: sum(x in sets[len(x)] for x in s) / len(s) if s else 0.0
                    got = (share(whole), score, share(question), share(answer))
                    if (got[0] >= OVERLAP or min(got[2:]) >= OVERLAP) and got > best.get((d, item), (-1.0,)):
                        best[d, item] = got
        return [(d, self.ids[j], s, o, q, a) for (d, j), (o, s, q, a) in sorted(best.items())]


def _index(name: str, row: dict) -> Index:
    df = lambda: {x["term"]: x["df"] for x in row["terms"]}
    return kept_in_worker(("index", name), lambda: Index([(x["item_id"], x["text"]) for x in row["items"]], df(), int(row["n"]), row["mean"], int(row["longest"])))


def _index_rows(items: DataFrame) -> tuple[DataFrame, int]:
    """A written table with a row for each index, and the number of indexes.

    A row has a part of the items by a hash of their id, the counts of its
    terms among all items, and the number, mean and greatest length of all items.
    """

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(terms)

    rows = saved(items.withColumn("words", words("text")).where(F.size("words") > 0), "items")
    chars, n, mean, longest = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1)), F.avg(F.size("words")), F.max(F.size("words"))).first()
    parts = int(chars // INDEX_CHARS) + 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
    own = rows.select("part", F.explode(F.array_distinct("words")).alias("term")).groupBy("part", "term").agg(F.count(F.lit(1)).alias("df"))
    df = own.groupBy("term").agg(F.sum("df").alias("df"))
    counted = own.select("part", "term").join(df, "term").groupBy("part").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    whole = rows.groupBy("part").agg(F.collect_list(F.struct("item_id", "text")).alias("items")).join(counted, "part")
    stats = (F.lit(n).cast("long").alias("n"), F.lit(mean).cast("double").alias("mean"), F.lit(longest).cast("int").alias("longest"))
    return saved(whole.select("part", F.struct("items", "terms", *stats).alias("index")), "indexes"), parts


def _scan(docs: DataFrame, index: DataFrame, name: str, key: str, text: str) -> DataFrame:
    """Leaks of the items of one index, a table of one row; each task reads it once, beside its first text."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Index | None = None

        def leaks(keys: list[int], texts: list[str]) -> pd.DataFrame:
            rows = [(keys[d], *rest) for d, *rest in own.search(texts)]
            return pd.DataFrame(rows, columns=[key, "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        for batch in batches:
            if own is None and len(batch):
                own = _index(name, batch["index"].iloc[0])
            keys: list[int] = []
            texts: list[str] = []
            held = 0
            for k, t in zip(batch[key], batch[text], strict=True):
                keys.append(k)
                texts.append(t)
                held += len(t)
                if held > BATCH_CHARS:
                    yield leaks(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield leaks(keys, texts)

    # the low 33 bits of the id count the rows of a task's partition
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    rows = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(text).alias(text), first.alias("_first"))
    # a product of partitions: the texts aren't shuffled, and tasks read the index, not the driver
    both = rows.crossJoin(index.select("index").coalesce(1).hint("shuffle_replicate_nl"))
    both = both.select(key, text, F.when(F.col("_first"), F.col("index")).alias("index"))
    return both.mapInPandas(found, f"{key} long, item_id long, score double, overlap double, question_overlap double, answer_overlap double")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text and test item that it contains.

    An item leaks into a text if a passage (two strides of words, overlapping
    by one) reaches RETRIEVE of the item's own BM25 score and holds at least
    OVERLAP of its 5-word shingles, or of those of its question and of its
    answer each, which text between the two doesn't part; score and overlaps
    are those of the best passage. Rows with a null key or text, and items with
    a null id or no word, have no part in it. Repeated rows each give their
    rows. An index holds about INDEX_CHARS characters of items: more items are
    dealt to more indexes by a hash of their id, which changes no result, since
    the counts that scores need are those of all items.
    """
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    table, parts = _index_rows(items)
    name = uuid.uuid4().hex
    out = None
    for p in range(parts):
        rows = _scan(docs, table.where(F.col("part") == p), f"{name}-{p}", key, text)
        out = rows if out is None else out.unionByName(rows)
    return out
