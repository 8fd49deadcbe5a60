"""Ladders and sets that turn numbers and names into classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucketize(x: Column, edges: Sequence[float], labels: Sequence[str] | Sequence[int], closed: str = "left", missing: str | int | None = None) -> Column:
    """Label of the interval that holds x: [a, b) if closed left, (a, b] if closed right.

    len(labels) = len(edges) - 1; infinite edges may open either end. Outside
    all intervals, or null, is `missing`.
    """
    out = F.lit(missing)
    for a, b, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        low = F.lit(True) if a == float("-inf") else (x >= a if closed == "left" else x > a)
        high = F.lit(True) if b == float("inf") else (x < b if closed == "left" else x <= b)
        out = F.when(x.isNotNull() & low & high, F.lit(label)).otherwise(out)
    return out


INF = float("inf")
# Edges and names of the classes.
SIZE_EDGES, SIZE_BANDS = (0, 35, 50, 70, 90, 120, INF), ("0_35", "35_50", "50_70", "70_90", "90_120", "120_plus")
ERA_EDGES = (-INF, 1929, 1945, 1965, 1975, 1990, 2005, 2015, INF)
ERAS = ("pre_war", "functionalism", "post_war_boom", "million_programme", "late_modern", "contemporary", "energy_efficient", "newest")
QUALITY = {"pre_war": 7, "functionalism": 8, "post_war_boom": 6, "million_programme": 4, "late_modern": 7, "contemporary": 8, "energy_efficient": 9, "newest": 10}
REPORT_ERAS = ((-INF, 1900, 1950, 1980, 2000, INF), ("pre-1900", "1900-1949", "1950-1979", "1980-1999", "2000+"))
REPORT_SIZES = ((0, 40, 50, 60, 70, 80, 90, 100, 120, INF), ("0-40", "40-50", "50-60", "60-70", "70-80", "80-90", "90-100", "100-120", "120+"))
CURVE_EDGES = (*range(20, 141, 10), INF)
CURVE_SIZES = (*(f"{a}-{a + 10}" for a in range(20, 140, 10)), "140+")
FEE_EDGES, FEES = (0, 2000, 3000, 4000, 5000, INF), ("<2000", "2000-3000", "3000-4000", "4000-5000", "5000+")
SEASONS = {"winter_slow": (12, 1, 2), "spring_awakening": (3, 4), "summer_peak": (5, 6, 7, 8), "autumn_rush": (9, 10), "pre_winter": (11,)}
SCHOOL = {"summer_vacation": (6, 7), "school_start": (8, 9), "winter_break": (12, 1), "spring_semester": (3, 4)}
CYCLE = ("downturn", "recovery", "expansion", "peak")
DISTRICTS = {"central_stockholm": (10000, 11499), "inner_south": (11500, 11799), "kungsholmen_vasastan": (11800, 12599), "inner_north": (12600, 12799), "outer_stockholm": (13000, 16999)}
DISTANCE = (
    (1.0, ("gamla stan", "norrmalm", "city", "östermalm central")),
    (2.0, ("östermalm", "södermalm", "vasastan", "kungsholmen")),
    (3.0, ("djurgården", "marieberg", "söder", "north stockholm")),
    (4.5, ("vällingby", "rinkeby", "tensta", "farsta", "skärholmen")),
    (5.5, ("täby", "danderyd", "nacka", "huddinge", "solna")),
)


def size_band(area: Column) -> Column:
    return bucketize(area, SIZE_EDGES, SIZE_BANDS, "right", "unknown")


def era(year: Column) -> Column:
    return bucketize(year, ERA_EDGES, ERAS, "right", "unknown")


def quality_of_year(year: Column) -> Column:
    """`quality` of the year's `era`, by one ladder instead of a ladder in each of its rungs."""
    return bucketize(year, ERA_EDGES, [QUALITY[e] for e in ERAS], "right", 5)


def quality(era: Column) -> Column:
    out = F.lit(5)
    for name, score in QUALITY.items():
        out = F.when(era == name, score).otherwise(out)
    return out


def age_bucket(age: Column) -> Column:
    return bucketize(age, (-INF, 10, 30, INF), ("new", "modern", "old"), "right")


def space_efficiency(rooms_per_sqm: Column) -> Column:
    return bucketize(rooms_per_sqm, (-INF, 0.03, 0.06, 0.10, INF), ("luxury_spacious", "spacious", "efficient", "cramped"), "right")


def renovation(age: Column) -> Column:
    return F.when(age.between(30, 50), "high").when(age.between(15, 70), "medium").otherwise("low")


def energy(year: Column, area: Column) -> Column:
    base = F.when(year >= 2010, 9.0).when(year >= 2000, 7.5).when(year >= 1990, 6.0).when(year >= 1980, 5.0).when(year >= 1970, 4.0).otherwise(6.0)
    bonus = F.when(area < 40, 1.0).when(area < 60, 0.5).when(area > 80, -0.5).otherwise(0.0)
    return F.when(year.isNull() | area.isNull(), 5.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(1.0), base + bonus)))


def district(postal: Column) -> Column:
    code = F.try_to_number(postal, F.lit("99999")).cast("int")
    out = F.when(code.isNull(), "unknown")
    for name, (a, b) in DISTRICTS.items():
        out = out.when(code.between(a, b), name)
    return out.otherwise("other_sweden")


def in_sets(x: Column, sets: dict[str, tuple[int, ...]], other: str | None = None) -> Column:
    out = F.lit(other)
    for name, members in reversed(sets.items()):
        out = F.when(x.isin(*members), name).otherwise(out)
    return out


def cycle(year: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CYCLE)), (F.pmod(year, F.lit(4)) + 1).cast("int"))


def dom_momentum(days: Column) -> Column:
    return F.when(days.isNull(), "normal").when(days <= 7, "hot_market").when(days <= 21, "normal").when(days <= 60, "slow").otherwise("stagnant")


def price_momentum(change: Column, unit: float = 250_000.0) -> Column:
    """unit: a quarter of a million in the price scale of the data."""
    return F.when(change.isNull(), "normal").when(change < 0, "below_asking").when(change < unit, "normal").when(change < 2 * unit, "hot").when(change < 3 * unit, "very_hot").when(change < 4 * unit, "extreme").otherwise("bidding_war")


def floor_tier(floor: Column) -> Column:
    return F.when(floor.isNull(), "unknown").when(floor <= 0, "ground").when(floor <= 2, "low").when(floor <= 5, "mid").otherwise("high")


def price_tier(price: Column, million: float = 1e6) -> Column:
    return F.when(price > 7 * million, "ultra_premium").when(price > 6 * million, "premium").when(price > 5 * million, "upper").when(price > 4 * million, "medium").otherwise("affordable")


def value_tier(score: Column) -> Column:
    return F.when(score >= 80, "Excellent").when(score >= 65, "Great").when(score >= 55, "Good").when(score >= 45, "Fair").when(score >= 30, "Overvalued").otherwise("Highly Overvalued")


def room_bucket(rooms: Column) -> Column:
    """1, 2, 3 or 4+; numbers between fall in none."""
    return F.when(rooms >= 4, "4+").when(rooms.isin(1, 2, 3), rooms.cast("int").cast("string"))


def floor_bucket(floor: Column) -> Column:
    return F.when(floor >= 6, "6+").when(floor.isin(0, 1, 2, 3, 4, 5), floor.cast("int").cast("string"))


def distance_to_center(area: Column) -> Column:
    out = F.lit(5.0)
    for score, names in reversed(DISTANCE):
        hit = F.lit(False)
        for n in names:
            hit = hit | F.lower(area).contains(n)
        out = F.when(hit, score).otherwise(out)
    return out


def timing_score(month: Column, year: Column) -> Column:
    f = lambda c: F.when(c, 1).otherwise(0)
    peak, start = month.isin(*SEASONS["summer_peak"]), month.isin(*SCHOOL["school_start"])
    return 2 * f(peak) + f(start) + f(month.between(5, 8)) - f(month.isin(12, 1, 7)) - 2 * f(cycle(year) == "downturn")
