"""Byte-level BPE with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.common import give_back, in_slices, kept_in_worker

#: A worker's memory of encoded pre-tokens: entries, and the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Characters that are encoded at once in a task; one longer text is encoded alone.
BATCH_CHARS = 1_000_000


class RankQueue:
    """Positions by merge rank; the least rank in use is found by find-first-set.

    Level 0 has a bit for each rank with a bucket, and each higher level a bit
    for each non-zero word of the level below.
    """

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        n = ranks
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        """Positions for a rank that has no bucket; for others, append to the bucket."""
        self.buckets[rank] = positions
        at = rank
        for level in self.levels:
            word = level[at >> 6]
            level[at >> 6] = word | 1 << (at & 63)
            if word:
                return
            at >>= 6

    def first(self) -> int:
        """The least rank with a bucket, or -1."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def pop(self, rank: int) -> list[int]:
        """The bucket of rank, leftmost position first."""
        at = rank
        for level in self.levels:
            word = level[at >> 6] & ~(1 << (at & 63))
            level[at >> 6] = word
            if word:
                break
            at >>= 6
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return bucket


class ByteBPE:
    """Ranks are the merge order and the ids, as in the public rank files."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.size = max(self.ranks.values(), default=-1) + 1
        # which two ids, joined, are a token
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                x, y = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if x is not None and y is not None:
                    self.pairs[x * self.size + y] = rank
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        x, y = np.divmod(np.arange(1 << 16), 256)
        self.byte_pairs = np.array([self.pairs.get(k, -1) for k in (self.byte_ids[x] * self.size + self.byte_ids[y]).tolist()], np.int64)
        self.queue = RankQueue(max(self.size, 1))
        self.cache: dict[str, bytes] = {}
        tokens = {v: k for k, v in self.ranks.items()}
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(self.size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(self.size)), np.uint8)

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens: a token's own id, or merges by rank, leftmost first.

        All pre-tokens share one linked list, which no pair crosses from one to
        the next, and one queue; what one does never touches another.
        """
        out: list[bytes] = [b""] * len(pieces)
        merging = []
        for p, data in enumerate(pieces):
            whole = self.ranks.get(data)
            if whole is None:
                merging.append(p)
            else:
                out[p] = whole.to_bytes(4, "little")
        if not merging:
            return out
        data = np.frombuffer(b"".join([pieces[p] for p in merging]), np.uint8).astype(np.int64)
        ends = np.cumsum([len(pieces[p]) for p in merging])
        begins = np.concatenate([[0], ends[:-1]])
        n = len(data)
        right_at, left_at, merge_at = np.arange(1, n + 1), np.arange(-1, n - 1), np.full(n, -1, np.int64)
        merge_at[:-1] = self.byte_pairs[data[:-1] * 256 + data[1:]]
        right_at[ends - 1] = left_at[begins] = merge_at[ends - 1] = -1
        queue, pairs, size = self.queue, self.pairs, self.size
        order = np.argsort(merge_at, kind="stable")
        order = order[np.searchsorted(merge_at[order], 0) :]
        if len(order):
            for bucket in np.split(order, np.flatnonzero(np.diff(merge_at[order])) + 1):
                queue.push(int(merge_at[bucket[0]]), bucket.tolist())
        ids, right, left, merge = self.byte_ids[data].tolist(), right_at.tolist(), left_at.tolist(), merge_at.tolist()
        buckets, push, find = queue.buckets, queue.push, pairs.get
        while (rank := queue.first()) >= 0:
            bucket = queue.pop(rank)
            for done, i in enumerate(bucket):
                if merge[i] != rank:
                    continue  # stale
                j = right[i]
                k = right[i] = right[j]
                ids[i] = rank
                merge[j] = -1
                least = rank
                r = -1
                if k >= 0:
                    left[k] = i
                    if (r := find(rank * size + ids[k], -1)) >= 0:
                        if (b := buckets.get(r)) is None:
                            push(r, [i])
                        else:
                            b.append(i)
                        if r < least:
                            least = r
                merge[i] = r
                if (h := left[i]) >= 0:
                    if (r := find(ids[h] * size + rank, -1)) >= 0:
                        if (b := buckets.get(r)) is None:
                            push(r, [h])
                        else:
                            b.append(h)
                        if r < least:
                            least = r
                    merge[h] = r
                if least < rank:  # it comes before the rest of this bucket
                    if done + 1 < len(bucket):
                        push(rank, bucket[done + 1 :])
                    break
        for p, i in zip(merging, begins.tolist(), strict=True):
            own = []
            while i >= 0:
                own.append(ids[i])
                i = right[i]
            out[p] = array("I", own).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        cache = self.cache
        found = [self.split(t) for t in texts]
        new = list({p for own in found for p in own if p not in cache})
        if len(cache) + len(new) > CACHE_ENTRIES:
            cache.clear()
            new = list({p for own in found for p in own})
        cache.update(zip(new, self.pieces([p.encode() for p in new]), strict=True))
        out = [b"".join([cache[p] for p in own]) for own in found]
        for p in new:
            if len(p) > CACHE_CHARS:
                del cache[p]
        return out

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """encode() in bounded parts; None counts as an empty text."""
        part: list[str] = []
        held = 0
        for t in texts:
            part.append(t or "")
            held += len(part[-1])
            if held > BATCH_CHARS:
                yield from self.encode(part)
                part, held = [], 0
        yield from self.encode(part)

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(total)].tobytes()


def loaded(path: str, pattern: str) -> ByteBPE:
    """The worker's own codec, kept from task to task."""
    return kept_in_worker(("bpe", path, pattern), lambda: ByteBPE(path, pattern))


def id_lists(codec: ByteBPE, texts: pa.Array) -> pa.ListArray:
    """The ids of each text, none of a null one. Texts are Python's for BATCH_CHARS at a time, ids lie in one buffer."""
    flat, sizes = bytearray(), [0]
    for part in in_slices(texts, BATCH_CHARS):
        for ids in codec.encode([t or "" for t in part]):
            flat += ids
            sizes.append(len(ids) // 4)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.frombuffer(flat, "<i4")))


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Every column of docs and the ids of its whole text as array<int> in column out.

    Encodes each match of pattern apart, without special tokens. A null text
    counts as empty and has no ids. Very long pre-tokens take time in
    proportion to their length (but for sorting buckets). Repeated
    rows stay; a column already named like out is replaced.
    """

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = loaded(path, pattern)
        for texts in batches:
            yield id_lists(codec, texts)
        give_back()

    return docs.withColumn(out, ids(F.col(text)))


def decode_ids(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Every column of docs and the bytes that its ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = loaded(path, pattern)
        for rows in batches:
            yield pd.Series([None if x is None else codec.decode(np.asarray(x, "<u4").tobytes()) for x in rows])

    return docs.withColumn(out, text(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, and the SHA-256 of the ids and of the bytes decoded from them, in one pass.

    A null text counts as empty. Every row is judged by itself, repeated rows
    too; texts of any length are encoded whole; an empty table gives an empty
    result; other columns are ignored.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = loaded(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for texts in batches:
            ids = list(codec.encode_all(texts))
            yield pd.DataFrame({
                "n_tokens": np.array([len(x) // 4 for x in ids], np.int64),
                "ids_sha256": [sha(x) for x in ids],
                "decoded_sha256": [sha(codec.decode(x)) for x in ids],
            })

    return docs.select(*keep, both(F.col(text)).alias("_d")).select(*keep, "_d.*")
