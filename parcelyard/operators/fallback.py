"""Cascades: the first statistic with enough rows behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tiered(levels: Sequence[tuple[str, Column, Column, int]], values: Sequence[str]) -> dict[str, Column]:
    """levels: (name, struct of values, count, least count), best first. Gives values, count and scope."""
    pick = {v: F.lit(None).cast("double") for v in values} | {"count": F.lit(None).cast("long"), "scope": F.lit(None).cast("string")}
    for name, stats, n, least in reversed(levels):
        ok = F.coalesce(n, F.lit(0)) >= least
        for v in values:
            pick[v] = F.when(ok, stats[v]).otherwise(pick[v])
        pick["count"] = F.when(ok, n).otherwise(pick["count"])
        pick["scope"] = F.when(ok, F.lit(name)).otherwise(pick["scope"])
    return pick
