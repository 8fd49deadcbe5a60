"""Distances to points of interest, and statistics of neighbouring cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.math import haversine
from parcelyard.operators.quantiles import window_quantiles

#: Points of interest are a curated list; more than this aren't taken into one expression.
MOST_POIS = 2000


def near_points(df: DataFrame, points: Sequence[tuple[float, float]], radii: Sequence[float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """nearest_m and within_<radius> of a bounded list of points, held as a literal array, without a join."""
    if len(points) > MOST_POIS:
        raise ValueError(f"{len(points)} points; at most {MOST_POIS}")
    spots = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points])
    far = F.transform(spots, lambda p: haversine(F.col(lat), F.col(lon), p["lat"], p["lon"]))
    rows = df.withColumn("_d", far)
    inside = lambda r: F.size(F.filter("_d", lambda d: d <= r))
    out = {"nearest_m": F.array_min("_d")} | {f"within_{int(r)}": inside(r) for r in radii}
    return rows.withColumns(out).drop("_d")


#: Metres a degree of latitude, and a degree of longitude at 59.3 degrees north.
NORTH, EAST = 111_200.0, 56_800.0
#: A cell's number holds its level (0 is the finest), q and r; q and r fit in 28 bits each.
_BITS, _HALF = 28, 1 << 27
#: The six steps to the cells next to one, in order round it.
AROUND = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))


def hex_factors(edge: float, north: float = NORTH, east: float = EAST) -> tuple[float, float, float]:
    """a, b, c with q = a * lon - b * lat and r = c * lat before rounding, for hexagons of that edge in metres, a corner to the north."""
    return east * 3**0.5 / 3 / edge, north / 3 / edge, north * 2 / 3 / edge


def _rounded(q: Column, r: Column) -> tuple[Column, Column]:
    """The hexagon that holds a point: of the three rounded coordinates, which add up to 0, the one that moved most follows from the others."""
    near = lambda x: F.floor(x + 0.5)
    rq, rr, rs = near(q), near(r), near(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    by_q = (dq > dr) & (dq > ds)
    return F.when(by_q, -rr - rs).otherwise(rq), F.when(~by_q & (dr > ds), -rq - rs).otherwise(rr)


def _numbered(level: Column | int, q: Column, r: Column) -> Column:
    at = F.lit(level) if isinstance(level, int) else level
    return F.shiftleft(at.cast("long"), 2 * _BITS) + F.shiftleft((q + _HALF).cast("long"), _BITS) + (r + _HALF).cast("long")


def hex_parts(cell: Column) -> tuple[Column, Column, Column]:
    """level, q and r of a cell's number."""
    mask = (1 << _BITS) - 1
    return F.shiftright(cell, 2 * _BITS), F.shiftright(cell, _BITS).bitwiseAND(mask) - _HALF, cell.bitwiseAND(mask) - _HALF


def hex_cell(lat: Column, lon: Column, edge: float) -> Column:
    """The number of the hexagon, in axial coordinates, that holds a place; null without a place."""
    a, b, c = hex_factors(edge)
    return _numbered(0, *_rounded(lon * a - lat * b, lat * c))


def hex_parent(cell: Column, levels: int = 1) -> Column:
    """The cell `levels` coarser: a parent is a cell and the six around it, seven times as large and turned by 19 degrees."""
    for _ in range(levels):
        level, q, r = hex_parts(cell)
        cell = _numbered(level + 1, *_rounded((3 * q + r) / 7, (2 * r - q) / 7))
    return cell


def hex_ring(cell: Column) -> Column:
    """The six cells next to a cell, in order."""
    level, q, r = hex_parts(cell)
    return F.array(*[_numbered(level, q + dq, r + dr) for dq, dr in AROUND])


def neighbor_stats(df: DataFrame, day: str, value: str, edge: float, key: str = "listing_key") -> DataFrame:
    """Count-weighted mean of the prior medians of the 6 adjacent cells: columns neighbor_p50 and neighbor_n.

    A cell's table has a row for each day on which it or a neighbour has a row;
    rows meet it by equal cell and day. Rows without a place have no neighbours.
    """
    rows = df.withColumn("_cell", hex_cell(F.col("lat"), F.col("lon"), edge))
    asked = rows.where("_cell is not null").select("_cell", day).distinct().withColumn("cell", F.explode(hex_ring(F.col("_cell"))))
    facts = rows.select(F.col("_cell").alias("cell"), day, F.col(value).cast("double").alias(value))
    wanted = asked.select("cell", day, F.lit(None).cast("double").alias(value)).distinct()
    got = window_quantiles(facts.unionByName(wanted), ["cell"], day, value, {"p": None}, [0.5]).where("p_n > 0")
    stats = asked.join(got, ["cell", day]).groupBy("_cell", day).agg((F.sum(F.col("p_q0") * F.col("p_n")) / F.sum("p_n")).alias("neighbor_p50"), F.sum("p_n").alias("neighbor_n"))
    return rows.join(stats, ["_cell", day], "left").withColumn("neighbor_n", F.coalesce("neighbor_n", F.lit(0))).select(*df.columns, "neighbor_p50", "neighbor_n")
