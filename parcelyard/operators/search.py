"""Filtered, sorted and paged search over valued listings, facets and similar areas."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Query:
    """Sets, inclusive ranges, exact flags and a substring sought in several columns; all must hold."""

    sets: dict[str, Sequence[str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    flags: dict[str, bool] = field(default_factory=dict)
    text: str | None = None
    text_columns: Sequence[str] = ("listing_id", "address", "area")
    sort: str = "score"
    descending: bool = True
    limit: int = 50
    offset: int = 0

    def condition(self) -> Column:
        out = F.lit(True)
        for c, members in self.sets.items():
            out = out & F.col(c).isin(*members)
        for c, (low, high) in self.ranges.items():
            out = out & F.col(c).isNotNull()
            out = out if low is None else out & (F.col(c) >= low)
            out = out if high is None else out & (F.col(c) <= high)
        for c, v in self.flags.items():
            out = out & F.col(c).eqNullSafe(F.lit(v))
        if self.text:
            hit = F.lit(False)
            for c in self.text_columns:
                hit = hit | F.coalesce(F.lower(c).contains(self.text.lower()), F.lit(False))
            out = out & hit
        return out

    def page(self, df: DataFrame, tie: str) -> DataFrame:
        """The page, nulls last either way, with a tie-break for one order."""
        if not 1 <= self.limit <= 200:
            raise ValueError("limit must be from 1 to 200")
        c = F.col(self.sort)
        order = c.desc_nulls_last() if self.descending else c.asc_nulls_last()
        return df.where(self.condition()).orderBy(order, F.col(tie)).offset(self.offset).limit(self.limit)

    def totals(self, df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1))
        return df.where(self.condition()).agg(n.alias("total"), F.lit(self.offset // self.limit + 1).alias("page"), F.ceil(n / self.limit).cast("long").alias("total_pages"))


def facets(df: DataFrame, sets: Sequence[str], ranges: Sequence[str]) -> DataFrame:
    """Distinct values, sorted, and least and greatest values, in one pass."""
    lists = [F.array_join(F.array_sort(F.collect_set(c)), "|").alias(f"{c}_values") for c in sets]
    return df.agg(*lists, *[f(c).alias(f"{c}_{n}") for c in ranges for f, n in ((F.min, "min"), (F.max, "max"))])


def similar(areas: DataFrame, key: str, tier: str, price: str, k: int = 3) -> DataFrame:
    """The k most similar other areas: 3 for the tier, 2 or 1 for a price within 10 or 20 per cent; then by key.

    areas is a row for each area. A score above 0 needs a shared tier or a
    price step that is equal or next (steps of 20 per cent), so candidates meet
    there; areas with fewer than k of them are filled up with the first keys,
    of which k + 1 are enough.
    """
    cols = lambda p: [F.col(c).alias(f"{p}_{c}") for c in (key, tier, price)]
    step = F.floor(F.log(F.nullif(F.abs(F.col(price)), F.lit(0.0))) / math.log(1.25)).cast("int")
    # within 20 per cent of a, b is at most one step below or above
    marks = areas.withColumn("_m", F.array(F.concat(F.lit("t"), F.coalesce(F.col(tier).cast("string"), F.lit(""))), F.concat(F.lit("p"), step.cast("string"))))
    a = marks.select(*cols("a"), F.explode(F.array_compact(F.concat("_m", F.array(F.concat(F.lit("p"), (step - 1).cast("string")), F.concat(F.lit("p"), (step + 1).cast("string")))))).alias("m"))
    b = marks.select(*cols("b"), F.explode(F.array_compact("_m")).alias("m"))
    near = a.join(b, "m").drop("m").distinct()
    first = areas.orderBy(key).limit(k + 1).select(*cols("b"))
    both = near.unionByName(areas.select(*cols("a")).crossJoin(F.broadcast(first))).distinct().where(F.col(f"a_{key}") != F.col(f"b_{key}"))
    gap = F.try_divide(F.abs(F.col(f"b_{price}") - F.col(f"a_{price}")), F.nullif(f"a_{price}", F.lit(0.0)))
    score = F.when(F.col(f"a_{tier}") == F.col(f"b_{tier}"), 3).otherwise(0) + F.when(gap < 0.1, 2).when(gap < 0.2, 1).otherwise(0)
    w = W.partitionBy(f"a_{key}").orderBy(F.desc("score"), f"b_{key}")
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col(f"a_{key}").alias(key), F.col(f"b_{key}").alias("other"), "score", "rank")
