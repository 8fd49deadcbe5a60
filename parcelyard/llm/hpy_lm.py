"""A hierarchical Pitman-Yor language model over all words of all texts (Teh, 2006).

Restaurants: one for each previous word, all with the word restaurant as
parent, whose base is uniform over the known words and one unknown. A dish is a
word; each customer of a context is a training token, each table of a context a
customer of the word restaurant. Gibbs sampling seats customers again;
probabilities are averaged over the last sweeps.

Every customer of both levels is seated again in a sweep. No score depends on
how many sit at which table, so the customers of a dish are seated all at once:
the number of their tables is drawn from its exact distribution, in which t
tables weigh as much as all ways to seat them at t tables (generalized Stirling
numbers; Buntine and Hutter, 2010). Dishes of contexts with over SMALL customers
move them one at a time instead, and keep the sizes of their tables.

A sweep runs in parts, as in distributed Gibbs sampling for topic models
(Newman et al., 2009): within a dish of a restaurant every move sees the one
before, and what other parts hold (tables of the restaurant, probability in the
parent) is that of the sweep before. Parts are of (context, word) by hash, so
that a hot context or word is spread over all of them. Random numbers follow
from the pair, the sweep and the step, and words are numbered by the rank of
their hash, so that scores don't depend on how the work is cut.

Texts are cut into blocks, each with its own dictionary. Blocks and parts
exchange packed messages, at most one for each that meet, as any shuffle does.
Pairs seen once have one table whatever happens and take no part in sweeps.
"""

from __future__ import annotations

import functools
import math
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate, count
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.common import forget, saved
from parcelyard.llm.langid import remainder

#: Sweeps, of which the last SAMPLES count; strength of both levels; seed.
SWEEPS, SAMPLES, STRENGTH, SEED = 5, 2, 1.0, 7
#: Customers of a dish up to which table sizes alone are kept in a sweep; dishes that move together, fewer go on one by one; draws made at once for one of these.
FEW, TOGETHER, DRAWS = 8, 40, 1_024
#: Customers of a dish up to which ways to seat them are tabled; tables up to which a sum of few terms gives them for more customers, and the most that its terms may cancel; logarithm of what is too unlikely to be drawn.
SMALL, TERMS, CANCELLED, UNLIKELY = 1_000, 64, 1e6, -40.0
#: splitmix64's step.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Characters at which a block of texts is closed.
BLOCK_CHARS = 7_000_000
#: Characters of texts for each part, and parts at least. Parts follow from the texts alone: whatever the session's shuffles have, messages are as many.
PART_CHARS, PARTS = 10_000_000, 8
#: Customers that are moved in one call.
MATRIX = 2_000_000
#: The end of a text; no word has white space.
END = b"\n"


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, which compresses well; first, how many bytes each takes."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _ints(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<i8").ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts in blocks: keys, whether held out, sizes in tokens, tokens as numbers of the block's words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seq = TaskContext.get().partitionId(), count()
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        keys, held, tokens, chars = [], [], [], 0

        def block() -> pd.DataFrame:
            ids = np.concatenate(tokens)
            by_use = np.argsort(-np.bincount(ids), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(by_use), np.int64)
            rank[by_use] = np.arange(len(by_use))
            words = list(number)
            return pd.DataFrame({
                "block": [task << 32 | next(seq)], "keys": [keys], "held": [held], "sizes": [_planes(np.array([len(t) for t in tokens]))],
                "tokens": [_planes(rank[ids])], "words": [b" ".join([words[i] for i in by_use.tolist()])], "chars": [chars],
            })

        for batch in batches:
            for k, null, h, t in zip(batch["k"], batch["is_null"], batch["held"], batch["text"], strict=True):
                own = [number[w] for w in (t or "").encode().lower().split()]
                own.append(number[END])
                keys.append(None if null else k)
                held.append(bool(h))
                tokens.append(np.array(own, np.int64))
                chars += len(t or "")
                if chars >= BLOCK_CHARS:
                    yield block()
                    number = defaultdict(count().__next__)
                    keys, held, tokens, chars = [], [], [], 0
        if keys:
            yield block()

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.col(key).isNull().alias("is_null"), (remainder(F.col(key), 7) == 2).alias("held"), F.col(text).alias("text"))
    return saved(rows.mapInPandas(cut, "block long, keys array<long>, held array<boolean>, sizes binary, tokens binary, words binary, chars long"), "lm-blocks")


def _each(make):
    """make gives lists of dicts of a row; for mapInPandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = make(row)
                if len(out):
                    yield pd.DataFrame(out)

    return run


def _by_part(messages: DataFrame, on: str, parts: int, name: str | None = None) -> DataFrame:
    """Messages gathered under each value of `on`, as the array `got`."""
    rest = [c for c in messages.columns if c != on]
    out = messages.repartition(parts, on).groupBy(on).agg(F.collect_list(F.struct(*rest)).alias("got"))
    return saved(out, name) if name else out


# -- words: ranks by hash ------------------------------------------------------


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _by_hash(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of words by hash, equal hashes by word; the hashes in that order."""
    h = _hashes(words)
    order = np.argsort(h, kind="stable")
    if (h[order][1:] == h[order][:-1]).any():
        order = np.array(sorted(range(len(words)), key=lambda i: (h[i], words[i])))
    return order, h[order]


def _range_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _send_words(parts: int):
    def send(row) -> list[dict]:
        words, tokens, sizes = row.words.split(b" "), _ints(row.tokens), _ints(row.sizes)
        n = np.bincount(tokens[np.repeat(~np.asarray(row.held, bool), sizes)], minlength=len(words))
        order, h = _by_hash(words)
        heads = np.searchsorted(_range_of(h, parts), np.arange(parts + 1)).tolist()
        return [{"part": p, "block": row.block, "words": b" ".join([words[i] for i in order[a:b].tolist()]), "n": _planes(n[order[a:b]])} for p, (a, b) in enumerate(zip(heads, heads[1:], strict=False)) if a < b]

    return _each(send)


def _ranked(got) -> tuple[int, list[np.ndarray]]:
    """How many different words blocks sent to a part, and the rank of each block's words."""
    lists = [bytes(s["words"]).split(b" ") for s in got]
    words = list({w for x in lists for w in x})
    rank = {words[i]: r for r, i in enumerate(_by_hash(words)[0].tolist())}
    return len(words), [np.array([rank[w] for w in x], np.int64) for x in lists]


def _vocabulary(row) -> list[dict]:
    """A part of the vocabulary: how many words, their counts, the rank of the end (if here) and of each block's words."""
    size, ranks = _ranked(row.got)
    n, end = np.zeros(size, np.int64), -1
    for at, s in zip(ranks, row.got, strict=True):
        n[at] += _ints(s["n"])
        words = bytes(s["words"]).split(b" ") if end < 0 else []
        end = int(at[words.index(END)]) if END in words else end
    places = [{"block": s["block"], "ranks": _planes(at)} for s, at in zip(row.got, ranks, strict=True)]
    return [{"part": row.part, "size": size, "tokens": n.sum(), "known": (n > 0).sum(), "end": end, "word_n": _planes(n), "places": places}]


def _numbered(starts: dict[int, int]):
    """Ids by the block's own numbers, in place of its words."""

    def numbered(row) -> list[dict]:
        ids = np.concatenate([_ints(g["ranks"]) + starts[g["part"]] for g in sorted(row.got, key=lambda g: g["part"])])
        own = np.empty(len(ids), np.int64)
        own[_by_hash(row.words.split(b" "))[0]] = ids
        return [{"block": row.block, "keys": row.keys, "held": row.held, "sizes": row.sizes, "tokens": row.tokens, "ids": _planes(own)}]

    return _each(numbered)


# -- pairs of a context and a word ---------------------------------------------


class Pairs(NamedTuple):
    """A block's different pairs, by part, context and word; the place of each token's pair among them."""

    context: np.ndarray
    word: np.ndarray
    context_at: np.ndarray  # the place among the block's ids, ascending
    word_at: np.ndarray
    part: np.ndarray
    n: np.ndarray  # training tokens
    at: np.ndarray


def _seed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(context + np.uint64(1)) + word.astype(np.uint64))


def _pairs(row, parts: int, end: int) -> Pairs:
    own, sizes = _ints(row.ids), _ints(row.sizes)
    by_id = np.argsort(own)
    ids, place = own[by_id], np.empty(len(own), np.int64)
    place[by_id] = np.arange(len(own))
    tokens = place[_ints(row.tokens)]
    before = np.concatenate([[0], tokens[:-1]])
    before[np.cumsum(sizes) - sizes] = np.searchsorted(ids, end)
    found, at = np.unique(before << 32 | tokens, return_inverse=True)
    context_at, word_at = found >> 32, found & 0xFFFFFFFF
    part = (_seed(ids[context_at].astype(np.uint64), ids[word_at]) % np.uint64(parts)).astype(np.int64)
    # those found are by context and word already; few parts are sorted by radix
    order = np.argsort(part.astype(np.uint16) if parts < 2**16 else part, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = np.bincount(at[np.repeat(~np.asarray(row.held, bool), sizes)], minlength=len(found))
    context_at, word_at = context_at[order], word_at[order]
    return Pairs(ids[context_at], ids[word_at], context_at, word_at, part[order], n[order], rank[at])


def _steps(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=0))


def _send_pairs(parts: int, end: int):
    def send(row) -> list[dict]:
        x = _pairs(row, parts, end)
        heads = np.searchsorted(x.part, np.arange(parts + 1)).tolist()
        return [{"part": p, "block": row.block, "context": _steps(x.context[a:b]), "word": _planes(x.word[a:b]), "n": _planes(x.n[a:b])} for p, (a, b) in enumerate(zip(heads, heads[1:], strict=False)) if a < b]

    return _each(send)


def _merged(got, words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Different pairs of a part as context * words + word, ascending; their counts; the place of each block's."""
    keys = [np.cumsum(_ints(s["context"])).astype(np.uint64) * np.uint64(words) + _ints(s["word"]).astype(np.uint64) for s in got]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.concatenate([_ints(s["n"]) for s in got]), len(found)).astype(np.int64)
    return found, n, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


# -- seating -------------------------------------------------------------------


def first_seats(n: int, discount: float) -> np.ndarray:
    """Sizes of tables to begin with: n to the power of the discount, their ranked sizes falling by a power law, as Pitman-Yor tables do."""
    tables = min(n, round(n**discount))
    share = np.arange(1, tables + 1) ** (-1 / discount)
    sizes = 1 + np.floor((n - tables) * share / share.sum()).astype(np.int64)
    sizes[0] += n - sizes.sum()
    return sizes


def _mass(own: np.ndarray, t: np.ndarray, others: np.ndarray, parent: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float) -> np.ndarray:
    """What a new table weighs for dishes `own` that have t tables."""
    return (STRENGTH + discount * (others[own] + t)) * parent(own, t)


def _draw(base: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return (_mixed(base + nth * GOLDEN) >> np.uint64(11)) * 2.0**-53


def _drawn(base: np.uint64, nth: int) -> Iterator[float]:
    """The draws of one dish from the nth on."""
    while True:
        yield from _draw(base, np.arange(nth, nth + DRAWS, dtype=np.uint64)).tolist()
        nth += DRAWS


class _Masses(dict):
    """What a new table weighs for one dish, by its tables; worked out some at a time."""

    def __init__(self, own: int, *rest):
        self.own, self.rest = own, rest

    def __missing__(self, t: int) -> float:
        first = t // 64 * 64
        ts = np.arange(first, first + 64)
        self.update(zip(ts.tolist(), _mass(np.full(64, self.own), ts, *self.rest).tolist(), strict=True))
        return self[t]


def _few(n: int, own: np.ndarray, sizes: np.ndarray, heads: np.ndarray, tables: np.ndarray, base: np.ndarray, rest: tuple) -> np.ndarray:
    """A sweep over dishes of n customers each: table sizes, a column for each dish."""
    discount, each = rest[-1], np.arange(len(own))
    s, t = np.zeros((n, len(own)), np.int64), tables[own].copy()
    for k in range(n):
        some = np.flatnonzero(t > k)
        s[k, some] = sizes[heads[own[some]] + k]
    left, nth = s.copy(), np.zeros(len(own), np.uint64)  # left: customers not moved yet
    for i in range(n):
        gone = (np.cumsum(left, axis=0) <= (_draw(base, nth + np.uint64(2 * i)) * (n - i)).astype(np.int64)).sum(axis=0)
        left[gone, each] -= 1
        s[gone, each] -= 1
        t -= s[gone, each] == 0
        joined = np.cumsum(np.where(s > 0, s - discount, 0.0), axis=0)
        x = _draw(base, nth + np.uint64(2 * i + 1)) * (joined[-1] + _mass(own, t, *rest))
        opens = x >= joined[-1]
        to = np.where(opens, (s == 0).argmax(axis=0), (joined <= x).sum(axis=0))
        s[to, each] += 1
        t += opens
    return s


def _many(own: np.ndarray, n: np.ndarray, sizes: np.ndarray, heads: np.ndarray, tables: np.ndarray, base: np.ndarray, rest: tuple) -> tuple[np.ndarray, np.ndarray]:
    """A sweep over dishes, those with most customers first: sizes of tables (0: closed) and where each dish's begin.

    The tables that customers sit at are kept one by one. To sit down, one
    follows a customer chosen evenly to a table of s with the chance 1 -
    discount / s, or opens a table, or draws again. Table t + i is that opened
    in move i. Dishes move together while there are many of them, the longest
    ones then go on alone; moves and draws are the same either way.
    """
    discount, t = rest[-1], tables[own].copy()
    at, room = _heads(n), _heads(n + t)
    within = np.arange(t.sum()) - np.repeat(_heads(t), t)
    own_sizes = sizes[np.repeat(heads[own], t) + within]
    z = np.repeat(within, own_sizes)
    s = np.zeros(int((n + t).sum()), np.int64)
    s[np.repeat(room, t) + within] = own_sizes
    first_free, nth, live, i = t.copy(), np.zeros(len(own), np.uint64), len(own), 0
    one = np.uint64(1)
    while live >= TOGETHER:
        own_, n_, at_, room_, base_, nth_, t_ = own[:live], n[:live], at[:live], room[:live], base[:live], nth[:live], t[:live]
        here = at_ + i
        there = here + (_draw(base_, nth_) * (n_ - i)).astype(np.int64)
        nth_ += one
        k = z[there]
        z[there] = z[here]
        place = room_ + k
        left = s[place] - 1
        s[place] = left
        t_ -= left == 0
        whole = (n_ - 1) + _mass(own_, t_, *rest)
        x = _draw(base_, nth_) * whole
        nth_ += one
        to = x.astype(np.int64)
        opens = to >= n_ - 1
        k = z[at_ + np.where(opens, 0, to + (to >= i))]
        seats = s[room_ + k]
        again = np.flatnonzero(~(opens | (seats * (1 - (x - to)) > discount)))
        k[opens] = first_free[:live][opens] + i
        while len(again):
            x = _draw(base_[again], nth_[again]) * whole[again]
            nth_[again] += one
            to = x.astype(np.int64)
            new = to >= n_[again] - 1
            k_ = z[at_[again] + np.where(new, 0, to + (to >= i))]
            done = new | (s[room_[again] + k_] * (1 - (x - to)) > discount)
            k[again] = np.where(new, first_free[again] + i, k_)
            opens[again[new]] = True
            again = again[~done]
        z[here] = k
        s[room_ + k] += 1
        t_ += opens
        i += 1
        live = int(np.searchsorted(-n, -i, "left"))
    for dish in range(live):
        a, b, c, d = at[dish], at[dish] + n[dish], room[dish], room[dish] + n[dish] + first_free[dish]
        s[c:d] = _alone(array("q", z[a:b].tobytes()), array("q", s[c:d].tobytes()), i, int(first_free[dish]), int(t[dish]), _drawn(base[dish], int(nth[dish])), _Masses(own[dish], *rest), discount)
    return s, room


def _alone(z: array, s: array, i: int, first_free: int, t: int, drawn: Iterator[float], mass: _Masses, discount: float) -> array:
    """The moves of one dish from the ith on, as in _many."""
    n = len(z)
    others = n - 1
    for i in range(i, n):
        j = i + int(next(drawn) * (n - i))
        k = z[j]
        z[j] = z[i]
        left = s[k] - 1
        s[k] = left
        if not left:
            t -= 1
        whole = others + mass[t]
        while True:
            x = next(drawn) * whole
            to = int(x)
            if to >= others:
                k = first_free + i
                s[k] = 1
                t += 1
                break
            k = z[to + (to >= i)]
            seats = s[k]
            if seats * (1 - (x - to)) > discount:
                s[k] = seats + 1
                break
        z[i] = k
    return s


def reseat(sizes: np.ndarray, heads: np.ndarray, others: np.ndarray, parent: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float, seeds: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over dishes: the new table sizes and tables of each dish.

    sizes: of all tables, dish after dish, dish i from heads[i] on. others:
    tables of other dishes in its restaurant. parent(i, t): the probability in
    the parent of dishes i that have t tables here. Every customer of a dish
    moves once, one after the other in random order: it is taken from its table
    and seated at a table of its dish, by size less the discount, or at a new
    one, by (strength + discount * tables of the restaurant) * parent.
    """
    tables = np.diff(np.append(heads, len(sizes)))
    if not len(heads):
        return sizes, tables
    customers, rest = np.add.reduceat(sizes, heads), (others, parent, discount)
    base = _mixed(seeds + np.uint64((SEED * 1_000 + sweep) * int(GOLDEN) % 2**64))
    flat_at, flat_sizes = [], []
    single = np.flatnonzero(customers == 1)
    flat_at.append(single)
    flat_sizes.append(np.ones(len(single), np.int64))
    for n in range(2, FEW + 1):
        among = np.flatnonzero(customers == n)
        step = max(1, MATRIX // 16 // n)
        for a in range(0, len(among), step):
            own = among[a : a + step]
            s = _few(n, own, sizes, heads, tables, base[own], rest).T
            row, col = np.nonzero(s)
            flat_at.append(own[row])
            flat_sizes.append(s[row, col])
    large = np.flatnonzero(customers > FEW)
    large = large[np.argsort(-customers[large], kind="stable")]
    group = np.cumsum(customers[large]) // MATRIX
    for own in np.split(large, np.flatnonzero(np.diff(group)) + 1):
        if len(own):
            s, room = _many(own, customers[own], sizes, heads, tables, base[own], rest)
            some = np.flatnonzero(s)
            flat_at.append(own[np.searchsorted(room, some, "right") - 1])
            flat_sizes.append(s[some])
    at = np.concatenate(flat_at)
    return np.concatenate(flat_sizes)[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(heads))


@functools.lru_cache(2)
def _ways(discount: float) -> np.ndarray:
    """Logarithms of the ways to seat n customers at t tables, up to SMALL of both: row n - 1, column t - 1."""
    out = np.full((SMALL, SMALL), -np.inf)
    out[0, 0] = 0.0
    for n in range(1, SMALL):
        out[n] = _next_ways(out[n - 1], n, discount)
    return out


def _next_ways(row: np.ndarray, n: int, discount: float) -> np.ndarray:
    """Those of n + 1 customers, from those of n: the last one sits down with others or alone."""
    t = min(len(row), n + 1)
    out = np.full(len(row), -np.inf)
    out[:t] = row[:t] + np.log(np.maximum(n - discount * np.arange(1, t + 1), 1e-300))
    out[1:t] = np.logaddexp(out[1:t], row[: t - 1])
    return out


@functools.lru_cache(2)
def _terms(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """For `_ways_of_many`: the factors 1 / gamma(-j * discount) with their signs, and the binomials of t and j."""
    j = range(1, TERMS + 1)
    # by reflection; a discount of j parts has a factor of nearly 0
    factor = [(-1) ** (i + 1) * math.gamma(1 + i * discount) * math.sin(math.pi * i * discount) / math.pi for i in j]
    return np.array(factor), np.array([[math.comb(t, i) for i in j] for t in j], np.float64)


def _ways_of_many(n: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of the ways to seat each n (over SMALL) at 1 to TERMS tables, less that of gamma(n); -inf from where terms cancel too much.

    By the sum of (-1)^j binomial(t, j) gamma(n - j * discount) / gamma(-j * discount) over j, divided by discount^t * t!.
    """
    factor, binomial = _terms(discount)
    a, x = discount * np.arange(1, TERMS + 1), n[:, None].astype(np.float64)
    y = x - a
    # the logarithm of gamma(n - a) / gamma(n), by Stirling's series
    ratio = (y - 0.5) * np.log1p(-a / x) - a * np.log(x) + a + (1 / y - 1 / x) / 12 - (1 / y**3 - 1 / x**3) / 360
    each = factor * np.exp(ratio)
    ways, whole = each @ binomial.T, np.abs(each) @ binomial.T
    good = np.logical_and.accumulate(ways * CANCELLED > whole, axis=1)
    t = np.arange(1, TERMS + 1)
    with np.errstate(divide="ignore"):
        out = np.log(np.where(good, ways, 0.0))
    return out - t * math.log(discount) - np.cumsum(np.log(t))


def _log_masses(own: np.ndarray, width: int, rest: tuple) -> np.ndarray:
    """For 1 to `width` tables of dishes `own`, the logarithm of what all but the first weigh."""
    out = np.zeros((len(own), width))
    np.cumsum(np.log(_mass(own[:, None], np.arange(1, width), *rest)), axis=1, out=out[:, 1:])
    return out


def _picked(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many tables a number in [0, 1) picks by the logarithms of weights of 1, 2 and more of them."""
    upto = np.exp(weights - weights.max(axis=1, keepdims=True)).cumsum(axis=1)
    return 1 + (upto <= (u * upto[:, -1])[:, None]).sum(axis=1)


def draw_tables(n: np.ndarray, others: np.ndarray, parent: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: float, seeds: np.ndarray, sweep: int) -> np.ndarray:
    """The tables of dishes of n customers, all of a dish seated anew at once.

    others and parent are those of `reseat`, whose moves, again and again, have
    these chances in the end; parent is given dishes in a column and tables in a
    row. For any n, but meant for dishes of few tables, or of up to SMALL
    customers.
    """
    u = _draw(_mixed(seeds + np.uint64((SEED * 1_000 + sweep) * int(GOLDEN) % 2**64)), np.zeros(len(n), np.uint64))
    out, rest = np.ones(len(n), np.int64), (others, parent, discount)
    order = np.argsort(n, kind="stable")
    ascending = n[order]
    # dishes of nearly as many customers share a matrix
    edges = np.unique(np.floor(1.15 ** np.arange(math.log(SMALL, 1.15) + 1)).astype(np.int64))
    heads = np.searchsorted(ascending, [*edges[edges < SMALL], SMALL], "right").tolist()
    for a, b in zip(heads, heads[1:], strict=False):
        width = int(ascending[b - 1]) if a < b else 1
        step = max(1, MATRIX // 4 // width)
        for at in range(a, b, step):
            own = order[at : min(b, at + step)]
            out[own] = _picked(_ways(discount)[n[own] - 1, :width] + _log_masses(own, width, rest), u[own])
    left: list[int] = []
    for at in range(heads[-1], len(n), max(1, MATRIX // 4 // TERMS)):
        own = order[at : at + max(1, MATRIX // 4 // TERMS)]
        weights = _ways_of_many(n[own], discount) + _log_masses(own, TERMS, rest)
        last = np.isfinite(weights).sum(axis=1) - 1
        done = weights[np.arange(len(own)), last] < weights.max(axis=1) + UNLIKELY
        out[own[done]] = _picked(weights[done], u[own[done]])
        left += own[~done].tolist()
    width = TERMS
    while left:
        # as many tables as matter, by the rule of one customer more
        width, row, k, more = width * 8, None, SMALL, []
        row = np.full(width, -np.inf)
        row[: min(width, SMALL)] = _ways(discount)[SMALL - 1, :width]
        for i in left:
            for k in range(k, int(n[i])):
                row = _next_ways(row, k, discount)
            k = int(n[i])
            weights = row[: min(width, k)] + _log_masses(np.array([i]), min(width, k), rest)[0]
            if width < k and weights[-1] >= weights.max() + UNLIKELY:
                more.append(i)
            else:
                out[i] = _picked(weights[None], u[i : i + 1])[0]
        left = more
    return out


def come_and_go(sizes: np.ndarray, tables: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: float, discount: float, seeds: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """Dishes after as many customers have come or gone as make up `customers`, one after the other: those that go are chosen evenly, those that come sit down as in `reseat`. (No part of `score`, which draws the word restaurant's tables anew.)"""
    if not len(tables):
        return sizes, tables
    heads = _heads(tables)
    change = customers - np.add.reduceat(sizes, heads)
    base = _mixed(seeds + np.uint64((SEED * 1_000 + sweep) * int(GOLDEN) % 2**64))
    out = np.split(sizes, heads[1:])
    for i in np.flatnonzero(change).tolist():
        s, more = out[i].tolist(), int(change[i])
        upto = list(accumulate(s))
        n, drawn = upto[-1], _drawn(base[i], 0)
        swapped: dict[int, int] = {}
        for k in range(-more):
            j = k + int(next(drawn) * (n - k))
            s[bisect_right(upto, swapped.get(j, j))] -= 1
            swapped[j] = swapped.get(k, k)
        came: list[int] = []
        for k in range(more):
            whole = n + k + (STRENGTH + discount * (int(others[i]) + len(s))) * parent
            while True:
                x = next(drawn) * whole
                to = int(x)
                if to >= n + k:
                    came.append(len(s))
                    s.append(1)
                    break
                at = bisect_right(upto, to) if to < n else came[to - n]
                if s[at] * (1 - (x - to)) > discount:
                    s[at] += 1
                    came.append(at)
                    break
        out[i] = np.array([x for x in s if x], np.int64)
    return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def _heads(tables: np.ndarray) -> np.ndarray:
    return np.cumsum(tables) - tables


def _firsts(n: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    each, at = np.unique(n, return_inverse=True)
    made = [first_seats(int(k), discount) for k in each]
    tables = np.array([len(m) for m in made], np.int64)[at]
    return (np.concatenate([made[i] for i in at.tolist()]) if len(n) else np.zeros(0, np.int64)), tables


class Totals(NamedTuple):
    """What every part knows."""

    words: int  # ids
    known: int  # V
    discount: float
    word_discount: float
    customers: float = 0.0  # of the word restaurant
    tables: float = 0.0

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.word_discount * tables + (STRENGTH + self.word_discount * self.tables) / (self.known + 1)) / (STRENGTH + self.customers)


def _tally(ids: np.ndarray, n: np.ndarray, side: str, frm: int, starts: np.ndarray, part_of: np.ndarray) -> list[dict]:
    """Messages to the parts of the vocabulary: sums of n by id."""
    each, at = np.unique(ids, return_inverse=True)
    sums = np.bincount(at, n, len(each)).astype(np.int64)
    heads = np.append(np.searchsorted(each, starts), len(each)).tolist()
    return [{"part": p, "frm": frm, "side": side, "ids": _steps(each[a:b]), "n": _planes(sums[a:b])} for p, a, b in zip(part_of.tolist(), heads, heads[1:], strict=False) if a < b]


_TALLY = "part int, frm int, side string, ids binary, n binary"


def _merge(words: int, starts: np.ndarray, part_of: np.ndarray):
    """A part's pairs seen at least twice; what those seen once tell the vocabulary; and for each block the counts of its pairs and the places of those seen at least twice."""

    def merge(row) -> list[dict]:
        found, n, places = _merged(row.got, words)
        one, often = found[n == 1], np.cumsum(n > 1) - 1
        told = [m for side, ids in (("word", one % np.uint64(words)), ("context", one // np.uint64(words))) for m in _tally(ids, np.ones(len(one)), side, row.part, starts, part_of)]
        blocks_ = [{"block": s["block"], "n": _planes(n[at]), "at": _planes(often[at[n[at] > 1]])} for s, at in zip(row.got, places, strict=True)]
        return [{"part": row.part, "pairs": _steps(found[n > 1]), "n": _planes(n[n > 1]), "one": len(one), "two": (n == 2).sum(), "told": told, "places": blocks_}]

    return _each(merge)


def _first_tables(n: np.ndarray, discount: float) -> np.ndarray:
    """As many as `first_seats` has."""
    return np.minimum(n, np.round(n**discount).astype(np.int64))


def _seated(t: Totals):
    """The first state of a part: pairs seen at least twice, their counts and tables, and the sizes of the tables of those with over SMALL customers."""

    def seated(row) -> list[dict]:
        n = _ints(row.n)
        tables = _first_tables(n, t.discount)
        sizes, tables[n > SMALL] = _firsts(n[n > SMALL], t.discount)
        return [{"part": row.part, "pairs": row.pairs, "n": row.n, "sizes": _planes(sizes), "tables": _planes(tables)}]

    return _each(seated)


_STATE = "part int, pairs binary, n binary, sizes binary, tables binary"


def _pair_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_ints(data).view(np.uint64), dtype=np.uint64)


def _report(t: Totals, starts: np.ndarray, part_of: np.ndarray):
    def report(row) -> list[dict]:
        keys, tables = _pair_keys(row.pairs), _ints(row.tables)
        return _tally(keys % np.uint64(t.words), tables, "word", row.part, starts, part_of) + _tally(keys // np.uint64(t.words), tables, "context", row.part, starts, part_of)

    return _each(report)


def _word_side(t: Totals, starts: dict[int, int], sweep: int):
    """A sweep over the word restaurant's dishes of a part of the vocabulary, whose customers are the contexts' new tables; and answers to all who reported."""

    def side(row) -> list[dict]:
        start, customers, tables = starts[row.part], _ints(row.ones_word).copy(), _ints(row.ones_context).copy()
        asked = [(g["frm"], g["side"], g["ids"], np.cumsum(_ints(g["ids"])) - start, _ints(g["n"])) for g in (row.got if row.got is not None else [])]
        for _, kind, _, ids, n in asked:
            (customers if kind == "word" else tables)[ids] += n
        own = np.zeros(len(customers), np.int64)
        served = np.flatnonzero(customers)
        seeds, base = _mixed(served.astype(np.uint64) + np.uint64(start)), 1 / (t.known + 1)
        # a trained word is in some context at any time, so the same words are served
        seats = _first_tables(customers[served], t.word_discount) if row.seats is None else _ints(row.seats)[served]
        own[served] = draw_tables(customers[served], np.maximum(t.tables - seats, 0), lambda _, t: np.full(t.shape, base), t.word_discount, seeds, 500 + sweep)
        out = [{"part": row.part, "frm": -1, "side": "all", "ids": None, "customers": _planes(customers), "tables": _planes(own), "contexts": _planes(tables), "sum_customers": customers.sum(), "sum_tables": own.sum()}]
        for frm, kind, ids, at, _ in asked:
            word = kind == "word"
            out.append({"part": row.part, "frm": frm, "side": kind, "ids": ids, "customers": _planes(customers[at]) if word else None, "tables": _planes(own[at]) if word else None, "contexts": None if word else _planes(tables[at]), "sum_customers": 0, "sum_tables": 0})
        return out

    return _each(side)


_WORD_SIDE = "part int, frm int, side string, ids binary, customers binary, tables binary, contexts binary, sum_customers long, sum_tables long"


def _sweep(t: Totals, nth: int):
    def sweep(row) -> list[dict]:
        keys, n, tables = _pair_keys(row.pairs), _ints(row.n), _ints(row.tables)
        got = sorted(row.got if row.got is not None else [], key=lambda g: g["part"])
        joined = lambda kind, name, read=_ints: np.concatenate([read(g[name]) for g in got if g["side"] == kind] or [np.zeros(0, np.int64)])
        read_ids = lambda data: np.cumsum(_ints(data))
        word_at = np.searchsorted(joined("word", "ids", read_ids), (keys % np.uint64(t.words)).astype(np.int64))
        context_at = np.searchsorted(joined("context", "ids", read_ids), (keys // np.uint64(t.words)).astype(np.int64))
        others = joined("context", "contexts")[context_at] - tables
        # what the word restaurant holds but for this dish's own tables; a move then sees those it has at the time
        customers, seats = joined("word", "customers")[word_at] - tables, joined("word", "tables")[word_at]

        def parent(i: np.ndarray, own: np.ndarray) -> np.ndarray:
            there = customers[i] + own
            return t.probability(there, np.minimum(seats[i], there))

        seeds = _seed(keys // np.uint64(t.words), keys % np.uint64(t.words))
        small, large = np.flatnonzero(n <= SMALL), np.flatnonzero(n > SMALL)
        sizes, seats_of_large = reseat(_ints(row.sizes), _heads(tables[large]), others[large], lambda i, own: parent(large[i], own), t.discount, seeds[large], nth)
        tables[small] = draw_tables(n[small], others[small], lambda i, own: parent(small[i], own), t.discount, seeds[small], nth)
        tables[large] = seats_of_large
        return [{"part": row.part, "pairs": row.pairs, "n": row.n, "sizes": _planes(sizes), "tables": _planes(tables)}]

    return _each(sweep)


# -- scores --------------------------------------------------------------------


def _pair_replies(row) -> list[dict]:
    """To each block: training counts of its pairs, and their tables in each sample."""
    samples, out = [_ints(x) for x in row.samples], []
    for s in row.places:
        n, at = _ints(s["n"]), _ints(s["at"])
        tables = []
        for x in samples:
            own = np.minimum(n, 1)
            own[n > 1] = x[at]
            tables.append(_planes(own))
        out.append({"block": s["block"], "part": row.part, "n": s["n"], "tables": tables})
    return out


def _word_replies(row) -> list[dict]:
    """To each block: counts of its words, and the word restaurant's state and the contexts' tables in each sample."""
    n, samples, out = _ints(row.word_n), [_ints(x) for x in row.samples], []
    for s in row.places:
        at = _ints(s["ranks"])
        out.append({"block": s["block"], "part": row.part, "n": _planes(n[at]), "samples": [_planes(x[at]) for x in samples]})
    return out


def _scores(known: list[Totals], parts: int, end: int, train: int, key: str):
    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = _pairs(row, parts, end)
                by = lambda got: sorted(got, key=lambda g: g["part"])
                words, pairs = by(row.words), by(row.pairs)
                word_at, context_at = x.word_at, x.context_at
                word_n, pair_n = (np.concatenate([_ints(g["n"]) for g in got]) for got in (words, pairs))
                p = np.zeros(len(pair_n))
                for s, t in enumerate(known):
                    customers, tables, contexts = (np.concatenate([_ints(g["samples"][3 * s + k]) for g in words]) for k in range(3))
                    own = np.concatenate([_ints(g["tables"][s]) for g in pairs])
                    parent = t.probability(customers, tables)[word_at]
                    # a context has as many customers as its word has training tokens: one text follows each end
                    p += (pair_n - t.discount * own + (STRENGTH + t.discount * contexts[context_at]) * parent) / (STRENGTH + word_n[context_at])
                sizes = _ints(row.sizes)
                heads = np.cumsum(sizes) - sizes
                add = lambda v: np.add.reduceat(v[x.at], heads)
                base = np.log10((word_n + 1) / (train + known[0].known + 1))
                yield pd.DataFrame({
                    key: pd.array([None if k is None or k != k else int(k) for k in row.keys], "Int64"), "held_out": np.asarray(row.held, bool), "n_tokens": sizes,
                    "n_known": add((word_n > 0)[word_at].astype(np.int64)), "train_tokens": train,
                    "base_score": add(base[word_at]), "score": add(np.log10(p / len(known))),
                })

    return scores


def _discount(one: int, two: int) -> float:
    """The discount that fits how many are seen once and twice."""
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Learns from the texts whose crc32 of the key, modulo 7, isn't 2, and scores
    all. Tokens are lower-cased (A-Z) words and one end; a text's first token
    follows an end. Null and empty texts are just the end. A null key counts as
    an empty text in the crc32. Repeated rows each count and are each scored.
    Without any training text all probabilities are 1 (one unknown word).
    """
    spark = docs.sparkSession
    out = f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    cut = blocks(docs, key, text)
    parts = max(PARTS, -(-(cut.agg(F.sum("chars")).first()[0] or 0) // PART_CHARS))
    sent = _by_part(cut.mapInPandas(_send_words(parts), "part int, block long, words binary, n binary"), "part", parts)
    vocabulary = saved(sent.mapInPandas(_each(_vocabulary), "part int, size long, tokens long, known long, end long, word_n binary, places array<struct<block: long, ranks: binary>>"), "lm-vocabulary")
    ranges = vocabulary.select("part", "size", "tokens", "known", "end").orderBy("part").collect()  # a row a part
    if not ranges:
        return spark.createDataFrame([], out)
    sizes = np.array([r.size for r in ranges], np.int64)
    starts, part_of = np.cumsum(sizes) - sizes, np.array([r.part for r in ranges])
    start_of = dict(zip(part_of.tolist(), starts.tolist(), strict=True))
    words, train, distinct = int(sizes.sum()), sum(r.tokens for r in ranges), sum(r.known for r in ranges)
    end = next(start_of[r.part] + r.end for r in ranges if r.end >= 0)
    ids = _by_part(vocabulary.select("part", F.inline("places")), "block", parts)
    numbered = saved(cut.join(ids, "block").mapInPandas(_numbered(start_of), "block long, keys array<long>, held array<boolean>, sizes binary, tokens binary, ids binary"), "lm-numbered")
    forget(cut)

    pairs = _by_part(numbered.mapInPandas(_send_pairs(parts, end), "part int, block long, context binary, word binary, n binary"), "part", parts)
    merged = saved(pairs.mapInPandas(_merge(words, starts, part_of), f"part int, pairs binary, n binary, one long, two long, told array<struct<{_TALLY}>>, places array<struct<block: long, n: binary, at: binary>>"), "lm-pairs")
    seen = merged.agg(F.sum("one").alias("one"), F.sum("two").alias("two")).first()
    ones = _by_part(merged.select(F.inline("told")), "part", parts)
    base = saved(vocabulary.select("part", "word_n").join(ones, "part", "left").mapInPandas(_ones(start_of), "part int, ones_word binary, ones_context binary, one long, two long"), "lm-ones")
    once = base.agg(F.sum("one").alias("one"), F.sum("two").alias("two")).first()
    t = Totals(words, distinct, _discount(seen.one, seen.two), _discount(once.one, once.two), 0.0, float(distinct))

    state = saved(merged.select("part", "pairs", "n").mapInPandas(_seated(t), _STATE), "lm-state")
    samples: list[tuple[Totals, DataFrame, DataFrame]] = []
    null, side = F.lit(None).cast("binary"), None
    for nth in range(SWEEPS + 1):
        told = _by_part(state.mapInPandas(_report(t, starts, part_of), _TALLY), "part", parts)
        before = side
        asked = base.join(told, "part", "left")
        asked = asked.withColumn("seats", null) if before is None else asked.join(before.where("frm = -1").select("part", F.col("tables").alias("seats")), "part")
        side = saved(asked.mapInPandas(_word_side(t, start_of, nth), _WORD_SIDE), "lm-side")
        sums = side.where("frm = -1").agg(F.sum("sum_customers").alias("c"), F.sum("sum_tables").alias("t")).first()
        t = t._replace(customers=float(sums.c), tables=float(sums.t))
        if nth > SWEEPS - SAMPLES:
            samples.append((t, state, side))
        if nth == SWEEPS:
            break
        answers = _by_part(side.where("frm >= 0").select(F.col("frm").alias("to"), "part", "side", "ids", "customers", "tables", "contexts"), "to", parts)
        after = saved(state.join(answers.withColumnRenamed("to", "part"), "part", "left").mapInPandas(_sweep(t, nth), _STATE), "lm-state")
        if before is not None and nth - 1 <= SWEEPS - SAMPLES:
            forget(before)
        if nth <= SWEEPS - SAMPLES:
            forget(state)
        state = after

    tables, restaurant = merged.select("part", "places"), vocabulary.select("part", "places", "word_n")
    for s, (_, seats, side) in enumerate(samples):
        tables = tables.join(seats.select("part", F.col("tables").alias(f"s{s}")), "part")
        restaurant = restaurant.join(side.where("frm = -1").select("part", *(F.col(c).alias(f"{c}{s}") for c in ("customers", "tables", "contexts"))), "part")
    n = range(len(samples))
    pair_replies = tables.select("part", "places", F.array(*(f"s{s}" for s in n)).alias("samples")).mapInPandas(_each(_pair_replies), "block long, part int, n binary, tables array<binary>")
    word_replies = restaurant.select("part", "places", "word_n", F.array(*(f"{c}{s}" for s in n for c in ("customers", "tables", "contexts"))).alias("samples")).mapInPandas(_each(_word_replies), "block long, part int, n binary, samples array<binary>")
    told = numbered.join(_by_part(pair_replies, "block", parts).withColumnRenamed("got", "pairs"), "block").join(_by_part(word_replies, "block", parts).withColumnRenamed("got", "words"), "block")
    return told.mapInPandas(_scores([x[0] for x in samples], parts, end, int(train), key), out)


def _ones(starts: dict[int, int]):
    """By id, how many pairs seen once it has as word and as context."""

    def ones(row) -> list[dict]:
        size = len(_ints(row.word_n))
        sums = {"word": np.zeros(size, np.int64), "context": np.zeros(size, np.int64)}
        for g in row.got if row.got is not None else []:
            sums[g["side"]][np.cumsum(_ints(g["ids"])) - starts[row.part]] += _ints(g["n"])
        return [{"part": row.part, "ones_word": _planes(sums["word"]), "ones_context": _planes(sums["context"]), "one": (sums["word"] == 1).sum(), "two": (sums["word"] == 2).sum()}]

    return _each(ones)
