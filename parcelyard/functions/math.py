"""Arithmetic on Columns; null means unknown, and nothing returns NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_divide(a: Column, b: Column) -> Column:
    """Null if either side is missing, the denominator is 0 or the result isn't finite."""
    return finite(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))))


def observed_ppsqm(sold: Column, area: Column, given: Column | None = None) -> Column:
    """Given price per square metre or sold price over area, if above 0."""
    x = safe_divide(sold, area)
    x = x if given is None else F.coalesce(given.cast("double"), x)
    return F.when(x > 0, x)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def flag(x: Column) -> Column:
    """1 where true, else 0, also where unknown."""
    return F.when(x, 1).otherwise(0)


def premium_pct(sold: Column, listed: Column) -> Column:
    return safe_divide((sold - listed) * 100, listed)


def floor_premium(floor: Column) -> Column:
    return F.when(floor > 0, F.log1p(floor.cast("double"))).otherwise(0.0)


def amenity_score(elevator: Column, balcony: Column, floor: Column) -> Column:
    return 1.5 * flag(elevator) + flag(balcony) - 0.8 * flag((floor > 3) & ~F.coalesce(elevator, F.lit(False))) - 0.3 * flag((floor <= 2) & elevator)


def transit_score(metro_m: Column, train_m: Column, metros_500: Column, metros_1000: Column) -> Column:
    """Weighted .4 / .3 / .2 / .1 of nearness and counts, each from 0 to 1."""
    near = lambda m, most: clip(1 - m / most, 0.0, 1.0)
    return 0.4 * near(metro_m, 2000.0) + 0.3 * near(train_m, 5000.0) + 0.2 * clip(metros_500 / 3.0, 0.0, 1.0) + 0.1 * clip(metros_1000 / 5.0, 0.0, 1.0)


def interpolated_normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution (Acklam's rational approximation, within 1.2e-9)."""
    # Fixed values of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(x: Column, k: tuple[float, ...], one: bool = False) -> Column:
        out = F.lit(k[0])
        for v in (*k[1:], *((1.0,) if one else ())):
            out = out * x + v
        return out

    q = p - 0.5
    r = q * q
    tail = lambda x: poly(x, c) / poly(x, d, True)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(poly(r, a) * q / poly(r, b, True))
