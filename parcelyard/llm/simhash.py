"""SimHash near-duplicates, found through deletion-variant signatures.

Two fingerprints that differ in at most 3 bits differ in at most 1 bit of one
of their two halves. Each half is indexed 32 times, each time with another bit
deleted, so such a pair meets under an equal key in at least one index.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations, count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.common import BROADCAST_ROWS, by_chars, by_shuffle, forget, give_back, keep_nothing, looked_up, once, saved

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Fingerprints under one key that are compared there; above it the key is refined by the other half.
SMALL_BUCKET = 1024
#: Above it, a refined bucket (all but 18 bits known) looks neighbours up by bit flips.
TILE = 4096


def _hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of a text's runs of words, repeats included; fewer words are one run."""
    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return []
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    if n <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]  # noqa: B905


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if more than half of the shingles' XXH64 have it; 0 without words."""
    return _majority(_hashes(text, words, seed))


#: The bits of a byte, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that more than half of the hashes have. Up to 255 are added in lanes of a byte."""
    counts = np.zeros(64, np.int64)
    x = np.ascontiguousarray(hashes, "<u8")
    for at in range(0, len(x), 255 << 10):
        lanes = _LANES[x[at : at + (255 << 10)].view(np.uint8).reshape(-1, 8)]
        counts += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(x), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """key and fp (the fingerprint's bits as a long) of every row."""

    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(key).alias(key), made(F.col(text)).alias("fp"))


def _without_bit(half: Column, bit: Column) -> Column:
    return half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _signatures(fps: DataFrame) -> DataFrame:
    """64 rows for each fp: a half with one bit deleted. key packs the half's bits, bit the index."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    rows = fps.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    half = F.when(F.col("bit") < 32, low).otherwise(high)
    return rows.select(*fps.columns, "bit", _without_bit(half, F.col("bit") % 32).alias("key"))


def _refined(rows: DataFrame) -> DataFrame:
    """The same idea within a large bucket: the other half is cut in two, one bit of a quarter deleted.

    A bucket of this kind has at most 2 ** 18 fingerprints: 46 bits are equal.
    """
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    other = F.when(F.col("bit") < 32, high).otherwise(low)
    rows = rows.withColumn("other", other).withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(31))))
    quarter = F.when(F.col("sub") < 16, F.col("other").bitwiseAND(0xFFFF)).otherwise(F.shiftrightunsigned("other", 16))
    return rows.select(*[c for c in rows.columns if c != "other"], _without_bit(quarter, F.col("sub") % 16).alias("sub_key"))


def _forest(bits: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a bucket's fingerprints: each that links to earlier ones, and its component's first, by position."""
    n = len(bits)
    if n > TILE:
        order = np.argsort(bits)
        known = bits[order]
        differ = int(np.bitwise_or.reduce(bits ^ bits[0]))
        varying = [b for b in range(64) if differ >> b & 1]
        flips = np.array([sum(1 << b for b in c) for k in range(1, MOST_BITS + 1) for c in combinations(varying, k)], np.uint64)

        def near(i: int, left: np.ndarray) -> np.ndarray:
            want = bits[i] ^ flips
            at = np.minimum(np.searchsorted(known, want), n - 1)
            got = order[at[known[at] == want]]
            return got[free[got]]
    else:

        def near(i: int, left: np.ndarray) -> np.ndarray:
            return left[np.bitwise_count(bits[left] ^ bits[i]) <= MOST_BITS]

    free = np.ones(n, bool)
    child: list[int] = []
    root: list[int] = []
    for i in range(n):
        if not free[i]:
            continue
        free[i] = False
        queue = [i]
        left = np.flatnonzero(free)
        while queue:
            at = queue.pop()
            got = near(at, left)
            if len(got):
                free[got] = False
                left = left[free[left]]
                queue += got.tolist()
                child += got.tolist()
                root += [i] * len(got)
    return child, root


def _buckets(fps: DataFrame) -> DataFrame:
    """Arrays of fingerprints that share a signature; every pair within 3 bits shares one."""
    rows = _signatures(fps)
    sizes = rows.groupBy("key", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(by_shuffle(sizes), ["key", "bit"])
    own = F.collect_list("fp").alias("fp")
    small = met.where(F.col("n") <= SMALL_BUCKET).groupBy("key", "bit").agg(own).select("fp")
    large = _refined(met.where(F.col("n") > SMALL_BUCKET)).groupBy("key", "bit", "sub_key", "sub").agg(own).where(F.size("fp") > 1).select("fp")
    return small.unionByName(large)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) with the components of the graph of all pairs within 3 bits."""

    @F.pandas_udf("struct<a: array<long>, b: array<long>>")
    def forest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for x in rows:
                x = np.sort(np.asarray(x, np.int64))
                child, root = _forest(x.view(np.uint64))
                out.append((x[child], x[root]))
            yield pd.DataFrame(out, columns=["a", "b"])

    pairs = _buckets(fps).select(forest("fp").alias("f")).select(F.explode(F.arrays_zip("f.a", "f.b")).alias("e"))
    return pairs.select("e.a", "e.b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of an undirected graph, as (a, b) with a > b or not.

    Alternating large-star and small-star rounds (Kiveris and others, 2014),
    each written to the shared folder, until nothing changes.
    """
    spark = edges.sparkSession

    def signed(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()

    summed = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    now = saved(signed(edges), "edges")
    before = summed(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large-star: neighbours above a node go to the least of its neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = saved(large, "large-star")
        # small-star: neighbours at or below a node, and the node, go to the least
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = saved(signed(small.select("e.a", "e.b")), "small-star")
        forget(now, large)
        now, last = new, before
        before = summed(now)
        if before == last:
            break
    if not before[0]:
        return spark.createDataFrame([], "node long, root long")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (the least key reachable over links) of every row.

    Texts without words (null, empty, white space) have fingerprint zero and
    link like any other. Rows with equal fingerprints form one node, so copies
    are never paired. Null keys keep their row; they don't count as least
    unless a component has no other (then component_id is null). Repeated keys
    keep their rows.
    """
    rows = saved(fingerprints(docs, key, text, words), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = components(links(nodes.select("fp")))
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    # only nodes with links can have another component than their own least key
    moved = saved(member.join(least, "root").where(~F.col("component_id").eqNullSafe(F.col("least")) | (F.col("root") != F.col("fp"))).select("fp", "component_id"), "moved")
    alone = nodes.join(by_shuffle(moved), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(by_shuffle(alone), "fp").select(key, digits.alias("fingerprint"), "component_id")


#: Documents sampled to find common shingles, those in how many of them are common, and how many are told at most.
HOT_DOCS, HOT_FROM, HOT_MOST = 20_000, 8, 65_536
#: Texts under one key that are compared in one piece; more are dealt to chunks, and each two chunks are compared.
CHUNK = 4096
#: Rounds in which the texts under a key are verified against one of them, another in each round.
LEADERS = 2
#: Shingles up to which a text has the keys of its prefix; more have BANDS keys of BAND least hashes each, of which two texts
#: similar by 0.8 share none once in 70,000 times (by 0.85 once in ten million). Texts about this size have both.
EXACT, BANDS, BAND = 100, 28, 5
#: Slots of a sketch, one byte each; deviations by which a pair's sketches may fall short of the similarity (one pair in three million does by more).
SLOTS, SHORT = 256, 5.0

_odd = lambda i: np.uint64(xxhash.xxh64_intdigest(str(i).encode(), SEED) | 1)
_PLACE = [_odd(i) for i in range(64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its distinct runs of words (fewer are one run; none, no run)."""
    for part in by_chars(texts):
        yield from _sets_of_part(part, words)


def _sets_of_part(batch: list[str | None], words: int) -> Iterator[np.ndarray]:
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    texts = [np.array([number[w] for w in (t or "").encode().lower().split()], np.int64) for t in batch]
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in number], np.uint64)
    for ids in texts:
        w, size = hashes[ids], min(words, len(ids))
        runs = np.zeros(len(ids) - size + 1 if size else 0, np.uint64)
        for k in range(size):
            runs += w[k : k + len(runs)] * _PLACE[k % len(_PLACE)]
        yield np.unique(_mixed(runs))


_MULTIPLIERS = np.array([_odd(1000 + i) for i in range(BANDS * BAND)], np.uint64)
_BAND_PLACES = np.array([_odd(2000 + i) for i in range(BAND)], np.uint64)
_BAND_NUMBERS = np.array([_odd(3000 + i) for i in range(BANDS)], np.uint64)


def _prefix(own: np.ndarray, hot: np.ndarray, least: float) -> np.ndarray:
    """So many of a text's distinct shingles, common ones (hot, sorted) last, that each similar text has one of them in its own.

    A similar text shares at least ceil(least * n) of n. Any order will do that
    is one for all texts: by hash, the hot after the others.
    """
    n = len(own)
    common = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(n, bool)
    return np.concatenate([own[~common], own[common]])[: n - math.ceil(least * n - 1e-9) + 1]


def _bands(own: np.ndarray) -> np.ndarray:
    """BANDS keys, each of the least values of BAND hashes over the shingles: equal with chance similarity ** BAND."""
    low = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(own), 4096):
        low = np.minimum(low, (own[part : part + 4096, None] * _MULTIPLIERS).min(axis=0))
    return _mixed((_mixed(low).reshape(BANDS, BAND) * _BAND_PLACES).sum(axis=1, dtype=np.uint64) + _BAND_NUMBERS)


def _meeting_keys(own: np.ndarray, hot: np.ndarray, least: float) -> np.ndarray:
    """Keys of which similar texts share one; none, or one for all, of texts without words."""
    if not len(own):
        return np.zeros(1, np.uint64)
    keys = [_prefix(own, hot, least)] if len(own) <= EXACT else []
    if len(own) >= least * EXACT:
        keys.append(_bands(own))
    return np.concatenate(keys)


def _sketch(own: np.ndarray) -> np.ndarray:
    """A byte of the least of the sorted hashes in each of SLOTS equal ranges of hashes, 0 where there is none."""
    slot = (own >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(own) else np.zeros(0, np.int64)
    out = np.zeros(SLOTS, np.uint8)
    out[slot[first]] = own[first] % np.uint64(255) + np.uint64(1)
    return out


def _may_be_similar(ids: np.ndarray, label: np.ndarray, size: np.ndarray, sketch: np.ndarray, side: np.ndarray | None, least: float) -> list[tuple[int, np.ndarray]]:
    """Of texts under one key, each with those of other labels that it may be similar to; a pair is told once.

    side: which of two chunks a text is in; only pairs between the two count.
    """
    names, at = np.unique(label, return_inverse=True)
    rest = np.flatnonzero(at != np.bincount(at, minlength=len(names)).argmax())
    small = np.zeros(len(ids), bool)
    small[rest] = True
    found = []
    step = max(1, (1 << 24) // (SLOTS * len(ids)))
    for part in range(0, len(rest), step):
        i = rest[part : part + step]
        # texts outside the largest label take partners there, and earlier ones outside it
        want = (label[i, None] != label) & (~small | (ids < ids[i, None]))
        want &= np.minimum(size[i, None], size) >= least * np.maximum(size[i, None], size)
        if side is not None:
            want &= side[i, None] != side
        j = np.flatnonzero(want.any(axis=0))
        if not len(j):
            continue
        x, y = sketch[i, None], sketch[None, j]
        used = ((x | y) != 0).sum(axis=2)
        near = ((x == y) & (x != 0)).sum(axis=2) >= least * used - SHORT * np.sqrt(least * (1 - least) * used)
        for row, ok in zip(i, near & want[:, j], strict=True):
            if ok.any():
                found.append((int(ids[row]), ids[j[ok]]))
    return found


def _keys(made: DataFrame) -> DataFrame:
    """key and id of texts that share a key with another; of keys with the same texts one stays: similar texts meet under most of theirs."""
    rows = made.select(F.explode("keys").alias("key"), "id")
    shared = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    met = saved(looked_up(rows, shared, "key"), "all-met")
    groups = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("one"))
    kept = saved(groups.groupBy("n", "x", "one").agg(F.min("key").alias("key")).select("key"), "keys")
    out = saved(looked_up(met, kept, "key"), "met")
    forget(shared, met, kept)
    return out


def _chunks(met: DataFrame) -> DataFrame:
    """Rows of met with chunks and side; under a key of over CHUNK texts each two chunks meet."""
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = met.join(sizes, "key").withColumn("m", F.ceil(F.col("n") / CHUNK)).withColumn("c", F.pmod(F.xxhash64("id"), F.col("m")))
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    chunks = F.least("c", "d") * F.col("m") + F.greatest("c", "d")
    return rows.select(*met.columns, chunks.alias("chunks"), F.when(F.col("c") > F.col("d"), 1).when(F.col("c") < F.col("d"), 0).otherwise(-1).alias("side"))


def _made(rows: DataFrame, key: str, text: str, words: int, least: float) -> DataFrame:
    """A saved row for each distinct text: id, h and h2 (its hashes), first (its least key), n (its rows), fp, size, sketch and keys."""

    @F.pandas_udf("array<long>")
    def distinct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keep_nothing()
        for texts in batches:
            yield pd.Series([x.view(np.int64) for x in _shingle_sets(texts, words)], dtype=object)
        give_back()

    @F.pandas_udf("fp long, size long, sketch binary, keys array<long>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keep_nothing()
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        for texts in batches:
            out = []
            for own in _shingle_sets(texts, words):
                out.append((int(signed([_majority(own)])[0]), len(own), _sketch(own).tobytes(), signed(_meeting_keys(own, common, least))))
            yield pd.DataFrame(out, columns=["fp", "size", "sketch", "keys"])
        give_back()

    part = F.pmod(F.xxhash64(key, text), F.lit(max(1, rows.count() // HOT_DOCS))) == 0
    some = rows.where(part).select(F.explode(distinct(F.col(text))).alias("s"))
    told = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_FROM).orderBy(F.desc("n"), "s").limit(HOT_MOST)
    common = np.sort(np.array([r[0] for r in told.collect()], np.int64).view(np.uint64))
    copies = rows.groupBy("h", "h2").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    copies = saved(copies.where("n > 1"), "text-copies")
    marked = looked_up(rows, copies, ["h", "h2"], "left")
    one = marked.where(F.col("n").isNull() | F.col(key).eqNullSafe(F.col("first"))).select("h", "h2", F.col(key).alias("first"), F.coalesce("n", F.lit(1)).alias("n"), F.col(text).alias("text"))
    return saved(one.select(F.monotonically_increasing_id().alias("id"), "h", "h2", "first", "n", prints("text").alias("f")).select("id", "h", "h2", "first", "n", "f.*"), "prints")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """key, h and h2 (hashes of the text), group_id (the least key of the row's group) and kept (whether the row is the one of its group that stays).

    Two texts belong together if they are equal, or if the Jaccard similarity
    of their sets of shingles is at least `least`; groups are what that reaches.

    Texts whose fingerprints (of shingles) are within 3 bits are found by their
    deletion-variant signatures. An equality join of keys makes the candidates
    complete: of texts of up to EXACT shingles the prefixes of their sets, of
    which all similar texts share one; of longer ones bands of least hashes, of
    which nearly all do (BANDS). What is found is verified by the sets: first the texts under a key against
    one of them, in LEADERS rounds; then those under a key that are still in
    different groups and whose sketches don't rule it out. Texts without words
    are equal to each other. Null texts count as empty. Null keys come after
    others; of rows with one key and one text each counts, but a single one
    (any) is to stay, which `once` sees to before.
    """

    @F.pandas_udf("binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x.tobytes() for x in _shingle_sets(texts, words)], dtype=object)

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out.append(shared >= least * (len(both) - shared))
        return pd.Series(out, dtype=bool)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows by key and chunks; a group is at most two chunks."""
        columns = ["id", "label", "size", "sketch", "side"]
        name, parts = None, []

        def pairs() -> pd.DataFrame:
            ids, label, size, sketch, side = map(np.concatenate, zip(*parts, strict=True))
            found = _may_be_similar(ids, label, size, np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SLOTS), side if side[0] >= 0 else None, least)
            return pd.DataFrame({"a": np.array([i for i, _ in found], np.int64), "b": pd.Series([j for _, j in found], dtype=object)})

        for batch in batches:
            where = batch["key"].to_numpy(), batch["chunks"].to_numpy()
            values = [batch[c].to_numpy() for c in columns]
            heads = np.flatnonzero((where[0][1:] != where[0][:-1]) | (where[1][1:] != where[1][:-1])) + 1
            for h, e in zip([0, *heads], [*heads, len(batch)], strict=True):
                own = (where[0][h], where[1][h])
                if own != name and parts:
                    yield pairs()
                    parts = []
                name = own
                parts.append([x[h:e] for x in values])
        if parts:
            yield pairs()

    hashed = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).withColumns({"h": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})
    scratch: list[DataFrame] = []

    def kept_for_now(df: DataFrame, name: str) -> DataFrame:
        scratch.append(saved(df, name))
        return scratch[-1]

    made = _made(hashed, key, text, words, least)
    met = _keys(made)
    edges: list[DataFrame] = []

    # texts that may be similar by their fingerprints, with the first of those that have the same
    fps = kept_for_now(made.groupBy("fp").agg(F.min("id").alias("one")), "fps")
    twins = made.join(by_shuffle(fps), "fp").where("id != one").select(F.col("id").alias("a"), F.col("one").alias("b"))
    near_fps = links(fps.select("fp"))
    near_fps = near_fps.join(fps.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b")
    first = kept_for_now(twins.unionByName(near_fps.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct(), "signature-pairs")

    named = kept_for_now(met.select("id").union(first.select(F.explode(F.array("a", "b")))).distinct(), "met-ids")
    known = kept_for_now(looked_up(made.select("id", "h", "h2", "first", "size", "sketch"), named, "id"), "met-prints")
    wanted = known.select("id", "h", "h2", "first")
    of_text = looked_up(hashed, wanted, ["h", "h2"]).where(F.col(key).eqNullSafe(F.col("first")))
    shingled = kept_for_now(of_text.select("id", sets(F.col(text)).alias("s")), "shingle-sets")

    def verified(pairs: DataFrame) -> None:
        both = pairs.join(shingled.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(shingled.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        edges.append(kept_for_now(both.where(similar("sa", "sb")).select("a", "b"), "similar"))

    def roots() -> DataFrame:
        found = edges[0]
        for more in edges[1:]:
            found = found.unionByName(more)
        return kept_for_now(components(found), "similar-roots")

    def unlike(nth: int, least_texts: int) -> tuple[DataFrame, DataFrame]:
        """Rows of keys whose texts aren't all in one group yet, with labels, and the keys."""
        rows = met.join(group, met.id == group.node, "left").select("key", "id", F.coalesce("root", "id").alias("label"))
        leader = F.min(F.struct(F.xxhash64("id", "key", F.lit(nth)).alias("o"), F.col("id").alias("one"), F.col("label").alias("one_label")))
        keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), leader.alias("leader"))
        return rows, keys.where((F.col("lo") != F.col("hi")) & (F.col("n") >= least_texts))

    verified(first)
    group, tested = roots(), first
    for nth in range(LEADERS):
        rows, keys = unlike(nth, 2)
        pairs = rows.join(keys.select("key", "leader.one", "leader.one_label"), "key").where(F.col("label") != F.col("one_label"))
        pairs = pairs.select(F.greatest("id", "one").alias("a"), F.least("id", "one").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = kept_for_now(pairs, "leader-pairs")
        verified(pairs)
        tested = tested.unionByName(pairs)
        group = roots()
    # of two texts under a key one was the leader, so that they have been compared
    rows, keys = unlike(LEADERS, 3 if LEADERS else 2)
    rest = _chunks(kept_for_now(rows.join(keys.select("key"), "key"), "unlike")).join(known.select("id", "size", "sketch"), "id")
    rest = rest.repartition("key", "chunks").sortWithinPartitions("key", "chunks")
    found = rest.select("key", "chunks", "id", "label", "size", "sketch", "side").mapInPandas(near, "a long, b array<long>")
    found = kept_for_now(found.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("b")), "near")
    pairs = found.select("a", F.explode("b").alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    verified(kept_for_now(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs"))
    group = roots()

    member = made.join(group, made.id == group.node, "left").select("h", "h2", "first", "n", F.coalesce("root", "id").alias("root"))
    order = F.struct(F.col("first").isNull(), F.col("first"), F.col("h"), F.col("h2"))
    linked = group.select("root").distinct()
    heads = looked_up(member, kept_for_now(linked, "group-roots"), "root").groupBy("root").agg(F.min(order).alias("head"))
    told = member.join(kept_for_now(heads, "group-heads"), "root", "left").where("head is not null or n > 1")
    told = told.select("h", "h2", "n", F.coalesce("head", order).alias("head")).select("h", "h2", "n", F.col("head.first").alias("group_id"), F.col("head.h").alias("head_h"), F.col("head.h2").alias("head_h2"))
    told = saved(told, "groups-of-texts")
    # hashes with more than a thousandth of the rows: a thousand at most
    total = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > max(1, total // 1000)
    rows = hashed.select(key, "h", "h2")
    marked = rows.join(F.broadcast(told.where(hot)), ["h", "h2"], "left")
    other = marked.where("n is null").select(key, "h", "h2").join(told.where(~hot), ["h", "h2"], "left")
    out = marked.where("n is not null").unionByName(other)
    alone = F.col("n").isNull()
    kept = alone | ((F.col("h") == F.col("head_h")) & (F.col("h2") == F.col("head_h2")) & F.col(key).eqNullSafe(F.col("group_id")))
    out = out.select(key, "h", "h2", F.when(alone, F.col(key)).otherwise(F.col("group_id")).alias("group_id"), kept.alias("kept"))
    forget(made, met, *scratch)
    return out


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """docs in which a single row of each of the similar_groups stays: that with the least key, a null key last.

    Any other columns are carried along.
    """
    rows = once(docs, key, text)
    gone = saved(similar_groups(rows, key, text, words, least).where("not kept").select(F.col(key).alias("key"), "h", "h2"), "copies-gone")
    own, value = F.col("row"), F.coalesce(F.col("row")[text], F.lit(""))
    marked = rows.select(F.struct(*rows.columns).alias("row"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else by_shuffle(gone)
    same = (F.xxhash64(value) == F.col("h")) & (F.xxhash64(F.lit(1), value) == F.col("h2")) & own[key].eqNullSafe(F.col("key"))
    return marked.join(gone, same, "left_anti").select("row.*")
