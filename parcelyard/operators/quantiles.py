"""Exact quantiles over the days before each day, for keys of any size.

Values are counted by key and day first. Keys are answered in grouped maps, many
keys at a time. A key with too many rows for one task is cut into ranges of
values: counts by range and day tell in which range a wanted rank lies, and only
that range is searched for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.tables import written

#: Counted values of a key above which it is cut, whatever its share of all; so many large keys are joined by broadcast, more by a shuffle.
SPLIT, BROADCAST_KEYS = 1_000_000, 10_000
#: Ranges into which the values of a large key are cut.
RANGES = 256
#: Edges between two that are compared first.
STEP = 16
#: Counted values that are searched at once in a task, or those of one key.
BATCH = 100_000


class Ranked:
    """A wavelet matrix over weighted values: the value of a rank among any run of them. Its levels are made one after the other, so that one at a time is held."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        self.known, code = np.unique(values, return_inverse=True)
        self.code, self.weights = code.astype(np.int32), weights

    def at(self, first: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The values at ranks (from 0, by weight) among the values of positions first to last."""
        code, weights, found = self.code, self.weights, np.zeros(len(rank), np.int64)
        for bit in reversed(range(max(1, int(len(self.known) - 1).bit_length()))):
            one = (code >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            weight = np.concatenate([[0], np.cumsum(np.where(one, 0, weights))])
            here = weight[last] - weight[first]
            up = rank >= here
            found |= up.astype(np.int64) << bit
            rank = rank - np.where(up, here, 0)
            total = zeros[-1]
            first = np.where(up, total + first - zeros[first], zeros[first])
            last = np.where(up, total + last - zeros[last], zeros[last])
            order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
            code, weights = code[order], weights[order]
        return self.known[np.minimum(found, len(self.known) - 1)]


def _spans(group: np.ndarray, day: np.ndarray, at_group: np.ndarray, at_day: np.ndarray, days: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in rows sorted by group and day, of the rows of a group before a day, at most `days` before."""
    reach = 1 << 32
    place = group * reach + day
    last = np.searchsorted(place, at_group * reach + at_day, "left")
    first = np.searchsorted(place, at_group * reach + (0 if days is None else np.maximum(at_day - days, 0)), "left")
    return first, last


def _ends(n: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two ranks between which a quantile of n values lies, and how far."""
    at = q * np.maximum(n - 1, 0)
    low = np.floor(at + 1e-12).astype(np.int64)
    return low, np.minimum(low + 1, np.maximum(n - 1, 0)), np.maximum(at - low, 0.0)


def _answers(group: np.ndarray, day: np.ndarray, value: np.ndarray, n: np.ndarray, windows: Mapping[str, int | None], qs: Sequence[float]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For the first row of each group and day (returned by position): rows, counts and quantiles of each window."""
    heads = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (day[1:] != day[:-1])]))
    known = ~np.isnan(value)
    ranked = Ranked(value[known], n[known]) if known.any() else None
    upto = np.concatenate([[0], np.cumsum(known)])
    total, seen = np.concatenate([[0], np.cumsum(np.where(known, n, 0))]), np.concatenate([[0], np.cumsum(n)])
    out = {}
    for name, days in windows.items():
        first, last = _spans(group, day, group[heads], day[heads], days)
        count = total[last] - total[first]
        out[f"{name}_rows"], out[f"{name}_n"] = seen[last] - seen[first], count
        some = count > 0
        ends = [_ends(count[some], q) for q in qs]
        if ranked is not None and some.any():
            ranks = [x for low, high, _ in ends for x in (low, high)]
            found = ranked.at(np.tile(upto[first[some]], len(ranks)), np.tile(upto[last[some]], len(ranks)), np.concatenate(ranks)).reshape(len(ranks), -1)
        for k, (_, _, part) in enumerate(ends):
            x = np.full(len(heads), np.nan)
            if some.any():
                x[some] = found[2 * k] + (found[2 * k + 1] - found[2 * k]) * part
            out[f"{name}_q{k}"] = x
    return heads, out


def _numbers(t: pa.Table, c: str, kind: type = np.int64) -> np.ndarray:
    return t[c].to_numpy().astype(kind, copy=False)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, and the number of each row's group in its table."""

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in keys:
            code = t[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    held: list[pa.RecordBatch] = []
    size, enough = 0, BATCH
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= enough:
            t = pa.Table.from_batches(held).combine_chunks()
            group = numbered(t)
            at = int(np.searchsorted(group, group[-1]))
            if at:
                yield t.slice(0, at), group[:at]
            held = t.slice(at).to_batches()
            del t, group
            pa.default_memory_pool().release_unused()
            size -= at
            enough = max(BATCH, 2 * size)  # (a large group isn't looked through at each of its batches)
    if size:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        yield t, numbered(t)
        del t
    # the worker stays and waits beside those of other stages
    pa.default_memory_pool().release_unused()


def _sorted_rows(rows: DataFrame, group: Sequence[str], order: Sequence[str] = ("d",)) -> DataFrame:
    return rows.repartition(*group).sortWithinPartitions(*group, *order)


def _columns(windows: Mapping[str, int | None], qs: Sequence[float]) -> str:
    return ", ".join(f"{w}_rows long, {w}_n long, " + ", ".join(f"{w}_q{k} double" for k in range(len(qs))) for w in windows)


def window_quantiles(df: DataFrame, keys: Sequence[str], day: str, value: str, windows: Mapping[str, int | None], qs: Sequence[float], split: int | None = None) -> DataFrame:
    """keys and day of df, once each, with what the days strictly before tell.

    windows: for each name how many days back it reaches (None: all). Columns
    <name>_rows (rows dated there), <name>_n (values known there) and <name>_q0,
    _q1, ... (quantiles qs of the values, linear between two; null without a
    value). Rows with a null day have no part in it; null keys are a key.
    """
    kinds = dict(df.dtypes)
    own = [f"k{i}" for i in range(len(keys))]
    key_columns = ", ".join(f"{k} {kinds[c]}" for k, c in zip(own, keys, strict=True))
    counted = df.where(F.col(day).isNotNull()).select(F.struct(*[F.col(c).alias(k) for k, c in zip(own, keys, strict=True)]).alias("k"), F.unix_date(F.col(day).cast("date")).alias("d"), F.col(value).cast("double").alias("v"))
    # written once: what df is made of isn't worked out again for sizes, edges, and keys of either kind
    counted = written(counted.groupBy("k", "d", "v").agg(F.count(F.lit(1)).alias("n")), "counted")
    large = counted.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > (SPLIT if split is None else split)).select("k")
    large = written(large, "large-keys")
    n_large = large.count()
    near = F.broadcast if n_large <= BROADCAST_KEYS else lambda t: t
    if not n_large:
        rest, out = counted, None
    else:
        edges = counted.join(near(large), "k").groupBy("k").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1000).alias("edges"))
        rest = counted.join(near(large), "k", "left_anti")
        out = _split(_ranged(counted, written(edges.withColumn("id", F.monotonically_increasing_id()), "edges"), key_columns, n_large), key_columns, windows, qs)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_groups(batches, own):
            heads, got = _answers(group, _numbers(t, "d"), _numbers(t, "v", np.float64), _numbers(t, "n"), windows, qs)
            first = t.select([*own, "d"]).take(pa.array(heads))
            yield from pa.table([*first.columns, *map(pa.array, got.values())], names=[*first.column_names, *got]).to_batches()

    got = _sorted_rows(rest.select("k.*", "d", "v", "n"), own).mapInArrow(answered, f"{key_columns}, d int, {_columns(windows, qs)}")
    got = got if out is None else got.unionByName(out)
    stats = [c for c in got.columns if c not in (*own, "d")]
    return got.select(*[F.col(k).alias(c) for k, c in zip(own, keys, strict=True)], F.date_from_unix_date("d").cast(kinds[day]).alias(day), *[F.when(~F.isnan(c), F.col(c)).alias(c) if "_q" in c else c for c in stats])


def _range() -> Column:
    """How many edges are at most v, by every sixteenth edge first."""
    upto = lambda a: F.size(F.filter(a, lambda e: e <= F.col("v")))
    coarse = upto(F.transform(F.sequence(F.lit(STEP), F.lit(RANGES - STEP), F.lit(STEP)), lambda i: F.get("edges", i - 1)))
    return coarse * STEP + upto(F.slice("edges", coarse * STEP + 1, STEP - 1))


def _ranged(counted: DataFrame, edges: DataFrame, key_columns: str, n_large: int) -> DataFrame:
    """The keys' columns, d, v, n and the range r of v (-1: null) of all large keys, written once.

    Edges of up to BROADCAST_KEYS keys are handed to the tasks, which look values
    up in them; those of more keys go with the rows.
    """
    if n_large > BROADCAST_KEYS:
        at = F.when(F.col("v").isNull(), -1).otherwise(_range())
        return written(counted.join(edges, "k").select("k.*", "d", "v", "n", at.alias("r")), "ranged")
    of = {row.id: np.array(row.edges or [], np.float64) for row in edges.select("id", "edges").collect()}  # RANGES numbers a large key

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            v, key, r = t["v"].to_numpy(zero_copy_only=False), t["id"].to_numpy(), np.zeros(t.num_rows, np.int32)
            for i in np.unique(key).tolist():
                own = np.flatnonzero(key == i)
                r[own] = np.searchsorted(of[i], v[own], "right")
            r[t["v"].is_null().to_numpy(zero_copy_only=False)] = -1
            names = [c for c in t.schema.names if c != "id"]
            yield pa.RecordBatch.from_arrays([*(t[c] for c in names), pa.array(r)], names=[*names, "r"])

    rows = counted.join(F.broadcast(edges.select("k", "id")), "k").select("k.*", "d", "v", "n", "id")
    return written(rows.mapInArrow(ranged, f"{key_columns}, d int, v double, n long, r int"), "ranged")


def _split(cut: DataFrame, key_columns: str, windows: Mapping[str, int | None], qs: Sequence[float]) -> DataFrame:
    """The answers of keys that are cut into ranges: rows of keys, d, v, n and r. No task holds more than a key's counts by day and range, or a range's values."""
    own = [x.split(" ")[0] for x in key_columns.split(", ")]
    # at most (ranges + 1) x days numbers for each key
    daily = _sorted_rows(cut.groupBy(*own, "d", "r").agg(F.sum("n").alias("n")), own)
    names = list(windows)
    backs = [windows[w] for w in names]

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each key, day and window: how many rows (q null); and which rank of which range is wanted."""
        for t, group in _whole_groups(batches, own):
            heads = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
            for a, b in zip(heads, heads[1:], strict=False):
                d, r, n = (_numbers(t.slice(a, b - a), c) for c in ("d", "r", "n"))
                days, at = np.unique(d, return_inverse=True)
                grid = np.zeros((len(days) + 1, RANGES + 1), np.int64)
                np.add.at(grid, (at + 1, r + 1), n)
                grid = grid.cumsum(axis=0)
                for w, back in enumerate(backs):
                    first = np.zeros(len(days), np.int64) if back is None else np.searchsorted(days, days - back, "left")
                    here = grid[np.arange(len(days))] - grid[first]
                    runs = np.concatenate([np.zeros((len(days), 1), np.int64), here[:, 1:].cumsum(axis=1)], axis=1)
                    count = runs[:, -1]
                    yield _plan(t, a, own, d=days, w=w, rows=here.sum(axis=1), n=count)
                    some = np.flatnonzero(count > 0)
                    for k, q in enumerate(qs):
                        low, high, part = _ends(count[some], q)
                        for is_high, rank in ((False, low), (True, high)):
                            at_range = (runs[some, 1:] <= rank[:, None]).sum(axis=1)
                            yield _plan(t, a, own, d=days[some], w=w, q=k, high=is_high, part=part, r=at_range, rank=rank - runs[some, at_range])

    plans = written(daily.mapInArrow(planned, f"{key_columns}, " + ", ".join(f"{c} {kind}" for c, kind in _PLAN.items())), "plans")
    null = lambda kind: F.lit(None).cast(kind)
    asked = plans.where("q is not null").select(*own, "r", "d", null("double").alias("v"), F.lit(0).cast("long").alias("n"), "w", "q", "high", "part", "rank")
    facts = cut.where("r >= 0").select(*own, "r", "d", "v", "n", null("int").alias("w"), null("int").alias("q"), null("boolean").alias("high"), null("double").alias("part"), null("long").alias("rank"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_groups(batches, [*own, "r"]):
            mine = t["w"].is_null().to_numpy()
            asked, facts = t.filter(pa.array(~mine)), t.filter(pa.array(mine)).select(["d", "v", "n"])
            if not asked.num_rows:
                continue
            day, ranked = _numbers(facts, "d"), Ranked(_numbers(facts, "v", np.float64), _numbers(facts, "n"))
            at, which, rank, among = _numbers(asked, "d"), _numbers(asked, "w"), _numbers(asked, "rank"), group[~mine]
            value = np.zeros(len(at))
            for w, back in enumerate(backs):
                some = which == w
                if some.any():
                    first, last = _spans(group[mine], day, among[some], at[some], back)
                    value[some] = ranked.at(first, last, rank[some])
            kept = asked.select([*own, "d", "w", "q", "high", "part"])
            yield from kept.append_column("v", pa.array(value)).to_batches()

    got = _sorted_rows(facts.unionByName(asked), [*own, "r"]).mapInArrow(found, f"{key_columns}, d int, w int, q int, high boolean, part double, v double")
    end = lambda high, w, k: F.max(F.when((F.col("w") == w) & (F.col("q") == k) & (F.col("high") == F.lit(high)), F.col("v")))
    part = lambda w, k: F.max(F.when((F.col("w") == w) & (F.col("q") == k) & F.col("high"), F.col("part")))
    values = [(end(False, w, k) + (end(True, w, k) - end(False, w, k)) * part(w, k)).alias(f"{name}_q{k}") for w, name in enumerate(names) for k in range(len(qs))]
    number = lambda c, w: F.max(F.when((F.col("w") == w) & F.col("q").isNull(), F.col(c)))
    counts = [number(c, w).alias(f"{name}_{c}") for w, name in enumerate(names) for c in ("rows", "n")]
    told = plans.where("q is null").select(*own, "d", "w", "q", "rows", "n", null("boolean").alias("high"), null("double").alias("part"), null("double").alias("v"))
    both = told.unionByName(got.select("*", null("long").alias("rows"), null("long").alias("n")))
    return both.groupBy(*own, "d").agg(*counts, *values)


_PLAN = {"d": "int", "w": "int", "rows": "long", "n": "long", "q": "int", "high": "boolean", "part": "double", "r": "int", "rank": "long"}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def _plan(t: pa.Table, row: int, own: Sequence[str], **columns: object) -> pa.RecordBatch:
    """Rows of a plan under the key of a row: columns or single values, what isn't given is null."""
    size = len(columns["d"])
    made = [pa.array(np.broadcast_to(columns[c], size), _ARROW[kind]) if c in columns else pa.nulls(size, _ARROW[kind]) for c, kind in _PLAN.items()]
    return pa.RecordBatch.from_arrays([*(pa.repeat(t[k][row], size) for k in own), *made], names=[*own, *_PLAN])
