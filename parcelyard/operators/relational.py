"""Filters, deduplication, upserts, set operations and checksums."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.operators.aggregates import overall_quantiles

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_COMPARE = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}


def safe_name(name: str) -> str:
    """A plain identifier, or ValueError."""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"unsafe identifier: {name!r}")
    return name


#: What the parts of a table's full name may be, fixed values.
_PROJECT, _PART, _COLUMN = re.compile(r"[a-z][a-z0-9-]{4,28}[a-z0-9]"), re.compile(r"[A-Za-z0-9_]{1,1024}"), re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,299}")


def safe_reference(project: str, dataset: str, table: str, quote: bool = False) -> str:
    """project.dataset.table of names that are safe in a statement, or ValueError that names the part."""
    for kind, value, allowed in (("project", project, _PROJECT), ("dataset", dataset, _PART), ("table", table, _PART)):
        if not isinstance(value, str) or not allowed.fullmatch(value):
            raise ValueError(f"unsafe {kind}: {value!r}")
    whole = f"{project}.{dataset}.{table}"
    return f"`{whole}`" if quote else whole


def quoted(name: str) -> str:
    """A column's name in backticks, or ValueError."""
    if not isinstance(name, str) or not _COLUMN.fullmatch(name):
        raise ValueError(f"unsafe column: {name!r}")
    return f"`{name}`"


@dataclass(frozen=True)
class Filter:
    """A column, one of = != < <= > >= IN, NOT IN, IS NULL, IS NOT NULL, and its value."""

    column: str
    op: str
    value: Any = None

    def condition(self) -> Column:
        c, op = F.col(f"`{safe_name(self.column)}`"), self.op.upper()
        if op in ("IS NULL", "IS NOT NULL"):
            if self.value is not None:
                raise ValueError(f"{op} takes no value")
            return c.isNull() if op == "IS NULL" else c.isNotNull()
        if op in ("IN", "NOT IN"):
            if not isinstance(self.value, (list, tuple, set)) or not self.value:
                raise ValueError(f"{op} takes values")
            return c.isin(*self.value) if op == "IN" else ~c.isin(*self.value)
        if op not in _COMPARE:
            raise ValueError(f"unknown operator: {self.op!r}")
        if self.value is None or isinstance(self.value, (list, tuple, set, dict)):
            raise TypeError(f"{op} takes one value")
        return _COMPARE[op](c, F.lit(self.value))


def where_all(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (f.condition() for f in filters), F.lit(True)))


def valid_listings(df: DataFrame, least: float, require_listing: bool = False, known: Sequence[str] = (), area: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows whose price, and asking price where it is required, is at least so much and whose known columns are known; area names are normalised first, if a function is given for them."""
    missing = [c for c in ("sold_price", *(["listing_price"] if require_listing else []), *known) if c not in df.columns]
    if missing:
        raise KeyError(missing)
    if area is not None and "area" in df.columns:
        df = df.withColumn("area", area(F.col("area")))
    df = df.where(F.col("sold_price") >= least)
    df = df.where(F.col("listing_price") >= least) if require_listing else df
    return df.dropna(subset=list(known)) if known else df


def within_quantiles(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose every column is null or within its own quantiles over all rows."""
    rows = df
    for c in columns:
        rows = rows.crossJoin(F.broadcast(overall_quantiles(df, c, [low, high]).select(F.col("q").alias(f"_b_{c}"))))
    for c in columns:
        rows = rows.where(F.col(c).isNull() | F.col(c).between(F.col(f"_b_{c}")[0], F.col(f"_b_{c}")[1]))
    return rows.select(*df.columns)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def merge_newer(old: DataFrame, new: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Of rows of a key: one with a known value wins over one without, then the newer; the old one if a date is unknown or both are equal."""
    both = old.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    undated = F.max(F.col(at).isNull()).over(W.partitionBy(key))
    both = both.withColumn("_keep", F.when(undated, F.col("_old")).otherwise(0))
    return latest(both, [key], [F.col(value).isNotNull().desc(), F.desc("_keep"), F.col(at).desc_nulls_last(), F.col("_old").desc()]).drop("_old", "_keep")


def upsert(target: DataFrame, source: DataFrame, key: str, insert_only: bool = False) -> DataFrame:
    """MERGE for tables without it: source rows and the target's other rows; or only new keys are added.

    A key that the source has twice is an error when the rows are made, as in a
    MERGE. A null key equals none, so such source rows are always added.
    """
    w = W.partitionBy(key)
    repeated = F.col(key).isNotNull() & (F.count(F.lit(1)).over(w) > 1)
    checked = F.when(repeated, F.raise_error(F.concat(F.lit(f"the source has a {key} twice: "), F.col(key).cast("string")))).otherwise(F.col(key))
    source = source.withColumn(key, checked.cast(source.schema[key].dataType))
    if insert_only:
        return target.unionByName(source.join(target.select(key), key, "left_anti"))
    return source.unionByName(target.join(source.select(key), key, "left_anti"))


def upsert_counts(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """inserted, updated, kept and repeated (rows of source keys that occur there more than once, which a merge refuses)."""
    t = target.groupBy(key).agg(F.count(F.lit(1)).alias("t"))
    s = source.groupBy(key).agg(F.count(F.lit(1)).alias("s"))
    both = t.join(s, key, "full").select(F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("s", F.lit(0)).alias("s"))
    total = lambda rows, ok: F.coalesce(F.sum(F.when(ok, F.col(rows))), F.lit(0)).cast("long")
    return both.agg(total("s", F.col("t") == 0).alias("inserted"), total("t", F.col("s") > 0).alias("updated"), total("t", F.col("s") == 0).alias("kept"), total("s", F.col("s") > 1).alias("repeated"))


def append_unseen(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def replace_overlap(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def checksum(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows, distinct keys, an order-free hash of the keys' SHA-256, and the last date.

    The sum of the digests' first 60 bits stands for the digest of all sorted
    keys, which would need them all in one place.
    """
    digest = F.conv(F.substring(F.sha2(F.col(key), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.sum(digest).cast("string").alias("digest"), F.max(at).alias("last_at"))


def required(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows, rows with every field known and not blank, their rate, and the fields missing anywhere."""
    bad = {c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in fields}
    ok = reduce(lambda a, b: a & b, (~x for x in bad.values()))
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(ok, 1)).alias("valid"), *[F.max(F.when(x, 1).otherwise(0)).alias(f"_m_{c}") for c, x in bad.items()])
    names = F.array_compact(F.array(*[F.when(F.col(f"_m_{c}") == 1, F.lit(c)) for c in sorted(fields)]))
    return counts.select("total", "valid", F.try_divide("valid", "total").alias("rate"), F.array_join(names, ",").alias("missing"))


def evolve(df: DataFrame, schema) -> DataFrame:
    """Columns of schema, missing nullable ones as null; a missing required one is an error."""
    have = set(df.columns)
    lost = [f.name for f in schema if f.name not in have and not f.nullable]
    if lost:
        raise ValueError(f"required columns are missing: {lost}")
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in have})


def with_defaults(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """df with a constant column for each that is missing."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that both have, in a's order."""
    return [c for c in a.columns if c in set(b.columns)]


def equal_summary(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables, keys in only one of them, and whether both summaries are the same."""
    x, y = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("a")), b.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    both = x.join(y, list(keys), "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = both.agg(zero(F.sum("a")).alias("rows_a"), zero(F.sum("b")).alias("rows_b"), F.count(F.when(F.col("b") == 0, 1)).alias("only_a"), F.count(F.when(F.col("a") == 0, 1)).alias("only_b"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("unequal"))
    return out.select("rows_a", "rows_b", "only_a", "only_b", (F.col("unequal") == 0).alias("same"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same at every run: those with the least hash of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary")), key).limit(n)


def ranked_if_enough(df: DataFrame, count: str, least: int, order: Column) -> DataFrame:
    """Rows with at least so many behind them, in order, with their rank; all rows if none has (for tables of groups, not of rows)."""
    some = df.agg(F.coalesce(F.max(F.col(count) >= least), F.lit(False)).alias("_any"))
    rows = df.crossJoin(F.broadcast(some)).where(~F.col("_any") | (F.col(count) >= least)).drop("_any")
    return rows.withColumn("rank", F.row_number().over(W.orderBy(order)))


def consolidated(df: DataFrame, name: str, together: Mapping[str, str], parents: Sequence[str], least: int = 5) -> DataFrame:
    """df with names replaced: those of an explicit map by their entry, others with fewer than `least` rows by the first of the parents, in order, that they contain.

    Counts are of the names as they come. A name that contains no parent stays.
    """
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    to = F.lit(None).cast("string")
    for p in reversed(parents):
        to = F.when(F.contains(F.col(name), F.lit(p)) & (F.col(name) != p), p).otherwise(to)
    to = F.when(F.col("_n") < least, to)
    for k, v in together.items():
        to = F.when(F.col(name) == k, v).otherwise(to)
    moved = counts.select(name, to.alias("_to")).where("_to is not null")
    return df.join(moved, name, "left").withColumn(name, F.coalesce("_to", name)).drop("_to")
