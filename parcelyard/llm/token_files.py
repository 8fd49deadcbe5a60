"""Token ids in files of canonical length-limited Huffman codes.

A data set is a Parquet table of chunks and a table with one row, the code
book. A chunk holds the ids of successive documents; each document starts at a
byte, and every BLOCK ids the bit offset within the document is noted, so that
any block can be decoded alone.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.llm.common import kept_in_worker, saved, shuffle_parts

#: Longest code in bits (or what the number of ids in use needs), ids in a block, ids in a chunk at which it is closed.
LIMIT, BLOCK, CHUNK_IDS = 16, 256, 500_000
#: Words that a worker keeps the ids of, words that are encoded in one text, and words of letters whose tokens are read together.
CACHE_WORDS, JOINED, TOGETHER = 600_000, 100, 5_000
BATCH_CHARS = 3_000_000
PUNCTUATION = string.punctuation.encode()


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths under a limit by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(level) // 2 * 2
        both = np.concatenate([leaves, level[0:pairs:2] + level[1:pairs:2]])
        at = np.argsort(both, kind="stable")
        level = both[at]
        is_leaf.append(at < n)
    take, bits = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    lengths[order] = bits
    return lengths


class Code:
    """The canonical code of given lengths: encodes, and decodes by table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = int(self.lengths.max(initial=1))
        self.codes = np.zeros(len(lengths), np.uint64)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        spans = 1 << (self.width - self.lengths[order])
        firsts = np.cumsum(spans) - spans
        self.codes[order] = (firsts >> (self.width - self.lengths[order])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.length = np.zeros(1 << self.width, np.int64)
        self.symbol[: int(spans.sum())] = np.repeat(order, spans)
        self.length[: int(spans.sum())] = np.repeat(self.lengths[order], spans)

    def encode(self, docs: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
        """The bits of each document, and its blocks' bit offsets as little-endian unsigned 64-bit integers."""
        sizes = np.array([len(d) for d in docs], np.int64)
        ids = np.concatenate([*docs, np.zeros(0, np.uint32)]).astype(np.int64)
        n = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        heads = np.cumsum(sizes) - sizes
        bits = ends[heads + sizes] - ends[heads]
        octets = (bits + 7) // 8
        start = np.cumsum(octets) - octets
        inner = ends[:-1] - np.repeat(ends[heads], sizes)
        at = inner + np.repeat(start * 8, sizes)
        shifted = self.codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
        words = int(octets.sum()) // 4 + 3
        # codes never share a bit, so sums of 32-bit parts are exact
        high = np.bincount(at >> 5, (shifted >> np.uint64(32)).astype(np.float64), words)
        low = np.bincount((at >> 5) + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
        data = (high + low).astype(">u4").tobytes()
        marks = [inner[h : h + s : BLOCK].astype("<u8").tobytes() for h, s in zip(heads, sizes, strict=True)]
        return [data[s : s + o] for s, o in zip(start.tolist(), octets.tolist(), strict=True)], marks

    def decode(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of blocks that begin at bit offsets and have so many ids; all blocks a symbol at a time."""
        raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        order = np.argsort(-sizes, kind="stable")
        at, left = starts[order].astype(np.int64), sizes[order]
        out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.uint32)
        shift = np.uint32(32 - self.width)
        for k in range(out.shape[1]):
            live = int(np.searchsorted(-left, -k, "left"))
            p = at[:live]
            peek = window[p >> 3] << (p & 7).astype(np.uint32) >> shift
            out[:live, k] = self.symbol[peek]
            at[:live] += self.length[peek]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        out = out[back]
        return out[np.arange(out.shape[1]) < sizes[:, None]]


class WordTokenizer:
    """A tokenizers file that lower-cases and whose pre-tokens never cross white space, nor join letters or digits and marks.

    Words are encoded once and kept. Texts that hold one of the file's added
    tokens are encoded whole, since those may be parted or joined in any way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # (compared in lower case, which finds more of them than there are)
        self.added = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}
        # the printable characters by which byte-level models write bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.written = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}

    def _encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """A word of letters that the normalizer leaves alone is one pre-token and goes straight to the model.

        Others are encoded many to a text and told apart by their tokens' offsets.
        """
        own: list[bytes] = []
        letters: list[str] = []
        rest: list[tuple[bytes, str]] = []
        for w in words:
            if w.isalpha():  # ASCII letters alone
                own.append(w)
                letters.append(w.decode())
                continue
            t = w.decode()
            if t.isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t):
                own.append(w)
                letters.append(w.decode("latin-1").translate(self.written))
            else:
                rest.append((w, t))
        out: dict[bytes, bytes] = {}
        for part in range(0, len(own), TOGETHER):
            tokens = list(map(self.model.tokenize, letters[part : part + TOGETHER]))
            data = array("I", map(attrgetter("id"), chain.from_iterable(tokens))).tobytes()
            ends = [4 * n for n in accumulate(map(len, tokens))]
            out.update(zip(own[part : part + TOGETHER], [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for part in range(0, len(rest), JOINED):
            own = rest[part : part + JOINED]
            ends = np.cumsum([len(t) + 1 for _, t in own])
            got = self.tokenizer.encode(" ".join([t for _, t in own]), add_special_tokens=False)
            firsts = np.array([a for a, _ in got.offsets], np.int64)
            data, at = np.array(got.ids, "<u4").tobytes(), 0
            for (w, _), c in zip(own, (4 * np.searchsorted(firsts, ends, "left")).tolist(), strict=True):
                out[w] = data[at:c]
                at = c
        return out

    def _learn(self, new: set[bytes]) -> None:
        """Keep the ids of words that weren't kept.

        ASCII punctuation that ends a word after an ASCII letter or digit is a
        pre-token of its own, so what needs encoding is the word without it.
        """
        cache = self.cache
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
        ending = {w: (s, w[len(s) :]) for w in new if not w[-1:].isalnum() and (s := w.rstrip(PUNCTUATION)) != w and s[-1:].isalnum()}
        stems = set(chain.from_iterable(ending.values())).difference(cache)
        stems.update(new.difference(ending))
        cache.update(self._encode_words(stems))
        cache.update((w, cache[s] + cache[e]) for w, (s, e) in ending.items())

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        # the tokenizer lower-cases, so A-Z may be lower-cased before
        low = [t.encode().lower() for t in texts]
        whole = {i: t for i, (t, b) in enumerate(zip(texts, low, strict=True)) if any(x in b for x in self.added)}
        found = pc.ascii_split_whitespace(pa.array([b"" if i in whole else b for i, b in enumerate(low)], pa.large_binary()).cast(pa.large_string()))
        # different words are looked up, and their ids spread over where they occur
        distinct = found.values.dictionary_encode()
        words, which = distinct.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), distinct.indices.to_numpy()
        known = list(map(self.cache.get, words))
        missing = [i for i, x in enumerate(known) if x is None]
        self._learn({words[i] for i in missing} - {b""})
        for i in missing:
            known[i] = self.cache.get(words[i], b"")  # white space at the edges leaves an empty word
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])]
        bounds, tail = ends[found.offsets.to_numpy()].tolist(), np.array([end], "<u4")
        out = [np.concatenate((ids[a:b], tail)) for a, b in zip(bounds, bounds[1:], strict=False)]
        for i, t in whole.items():
            out[i] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end], "<u4")
        return out

    def encode_all(self, texts: Iterable[str | None], end: int) -> Iterator[list[np.ndarray]]:
        part: list[str] = []
        held = 0
        for t in texts:
            part.append(t or "")
            held += len(part[-1])
            if held > BATCH_CHARS:
                yield self.encode(part, end)
                part, held = [], 0
        if part:
            yield self.encode(part, end)


def _tokenizer(path: str) -> WordTokenizer:
    return kept_in_worker(("tokenizer", path), lambda: WordTokenizer(path))


def _planes(ids: np.ndarray) -> bytes:
    """Ids byte by byte of all of them, which compresses better."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _ids(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encode(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """is_null, key and ids (of the whole text and the end) of every row, written to the shared folder."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _tokenizer(tokenizer)
        for batch in batches:
            at = 0
            for ids in words.encode_all(batch["text"], end):
                own = batch.iloc[at : at + len(ids)]
                at += len(ids)
                yield pd.DataFrame({"is_null": own["is_null"], "key": own["key"], "ids": [_planes(x) for x in ids]})

    rows = docs.select(F.col(key).isNull().alias("is_null"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("key"), F.col(text).alias("text"))
    return saved(rows.mapInPandas(encoded, "is_null boolean, key long, ids binary"), "ids")


def count_ids(rows: DataFrame) -> np.ndarray:
    """How often each id occurs (a row for each id of the vocabulary comes to the driver)."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ends = np.cumsum(batch["ids"].str.len().to_numpy(np.int64))
            # as many texts at a time as a chunk holds; counting costs as much as the vocabulary each time
            for own in np.split(batch["ids"].to_numpy(), np.flatnonzero(np.diff(ends // (4 * CHUNK_IDS))) + 1):
                n = np.bincount(np.concatenate([np.zeros(0, np.uint32), *map(_ids, own)]), minlength=len(total))
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    got = rows.select("ids").mapInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([-1, *(r.id for r in got)]) + 1, np.int64)
    for r in got:
        out[r.id] = r.n
    return out


def write_ids(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encode every whole text, append the id `end`, and write chunks in ascending key and the code book.

    Returns both tables as read from the shared folder. Null texts count as
    empty (one id, the end). Null keys come first; rows with equal keys are in
    order of their coded ids. An empty table writes no chunk.
    """
    spark = docs.sparkSession
    ids = encode(docs, tokenizer, end, key, text)
    lengths = code_lengths(count_ids(ids))
    book = saved(spark.createDataFrame([(BLOCK, end, bytearray(lengths.tobytes()))], "block int, end int, lengths binary"), "code-book")
    parts = shuffle_parts(spark)
    bounds = ids.approxQuantile("key", [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    edges = np.unique(np.array(bounds, np.int64))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(lengths)
        for batch in batches:
            at = 0
            while at < len(batch):
                upto, held = at, 0
                while upto < len(batch) and held < CHUNK_IDS:
                    held += len(batch["ids"].iat[upto]) // 4
                    upto += 1
                own = batch.iloc[at:upto]
                at = upto
                x = [_ids(i) for i in own["ids"]]
                data, marks = code.encode(x)
                part = np.searchsorted(edges, own["key"].to_numpy(), "right")
                yield pd.DataFrame({"part": part, "is_null": own["is_null"].to_numpy(), "key": own["key"].to_numpy(), "n_tokens": [len(i) for i in x], "data": data, "marks": marks})

    rows = ids.mapInPandas(coded, "part int, is_null boolean, key long, n_tokens long, data binary, marks binary")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", F.desc("is_null"), "key", "data")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: list[tuple] = []
        part, before, held = -1, 0, 0

        def chunk() -> pd.DataFrame:
            return pd.DataFrame({
                "part": [part], "before": [before], "keys": [[None if r.is_null else r.key for r in own]], "n_tokens": [[r.n_tokens for r in own]],
                "n_bytes": [[len(r.data) for r in own]], "marks": [b"".join(r.marks for r in own)], "data": [b"".join(r.data for r in own)],
            })

        for batch in batches:
            for r in batch.itertuples(index=False):
                if own and (r.part != part or held >= CHUNK_IDS):
                    yield chunk()
                    before, own, held = before + held, [], 0
                if r.part != part:
                    part, before = r.part, 0
                own.append(r)
                held += r.n_tokens
        if own:
            yield chunk()

    chunks = rows.mapInPandas(packed, "part int, before long, keys array<long>, n_tokens array<long>, n_bytes array<long>, marks binary, data binary")
    return saved(chunks, "token-files"), book


def read_ids(chunks: DataFrame, book: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids in all files before it), n_tokens and ids_crc32 of every document in the files."""
    block, _, lengths = book.first()
    lengths = np.frombuffer(bytes(lengths), np.uint8)
    # one row for each part of the range partitioning
    totals = chunks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(lengths)
        for batch in batches:
            for r in batch.itertuples(index=False):
                tokens, octets = np.asarray(r.n_tokens, np.int64), np.asarray(r.n_bytes, np.int64)
                blocks = -(-tokens // block)
                doc_of = np.repeat(np.arange(len(tokens)), blocks)
                nth = np.arange(len(doc_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                starts = np.frombuffer(r.marks, "<u8").astype(np.int64) + 8 * (np.cumsum(octets) - octets)[doc_of]
                ids = code.decode(r.data, starts, np.minimum(block, tokens[doc_of] - nth * block)).astype("<u4")
                ends = np.cumsum(tokens)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - tokens, ends, strict=True)]
                yield pd.DataFrame({key: pd.array([None if x is None or x != x else int(x) for x in r.keys], "Int64"), "start": r.base + r.before + ends - tokens, "n_tokens": tokens, "ids_crc32": crc})

    return chunks.join(F.broadcast(bases), "part").mapInPandas(decoded, f"{key} long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """write_ids, then read_ids: doc_id, start, n_tokens and ids_crc32 of every document, as read from the files.

    Null texts are the end alone; null keys come first and keep their rows, as
    repeated keys do; an empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    return read_ids(*write_ids(docs, tokenizer, end))
