"""Ratios, interactions and composite scores of listings, and luxury tiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.math import clip, flag, safe_divide
from parcelyard.operators import aggregates as A

#: Parts of the desirability score and of the luxury score, the ratios between which a part grows from 0 to 1, and the tiers' edges.
DESIRABLE = {"quality": 0.3, "distance": 0.25, "energy": 0.2, "liquidity": 0.15, "timing": 0.1}
LUXURY = {"micro": 0.42, "same_size": 0.22, "neighbor": 0.14, "central": 0.12, "size": 0.10}
RATIO_LOW, RATIO_HIGH, FLAG_FROM = 0.90, 1.35, 0.65
LUXURY_EDGES, LUXURY_TIERS = (0.25, 0.50, 0.75), ("standard", "strong", "premium", "luxury")

#: Short names of what `with_interactions` adds.
NAMES: Mapping[str, str] = {
    "fee_efficiency": "fee_efficiency", "floor_per_sqm": "floor_per_sqm", "area_squared": "area_squared", "age": "property_age", "area_location": "area_location_score", "timing_location": "timing_location_interaction",
    "size_era": "size_era_interaction", "area_age": "area_age_interaction", "rooms_age": "rooms_age_interaction", "momentum_distance": "momentum_distance_interaction", "luxury": "luxury_score", "desirability": "property_desirability_score",
    "enhancement": "enhancement_potential", "cost_benefit": "cost_benefit_ratio", "efficiency_premium": "efficiency_premium",
}


def ratios(df: DataFrame) -> dict[str, Column]:
    """Of size, fee, floor and price."""
    c, area = (lambda n: F.col(n) if n in df.columns else F.lit(None).cast("double")), F.col("living_area")
    return {
        "price_per_sqm": safe_divide(c("listing_price"), area), "fee_efficiency": safe_divide(c("monthly_fee"), area), "floor_per_sqm": safe_divide(c("floor"), area), "rooms_per_sqm": safe_divide(c("rooms"), area), "area_squared": area * area,
        "total_cost_per_sqm": safe_divide(c("monthly_fee") * 12 + c("listing_price"), area),
    }


def with_interactions(df: DataFrame) -> DataFrame:
    """df with ratios, interactions and scores.

    Reads living_area, rooms, floor, monthly_fee, listing_price, days_on_market,
    property_age, era, quality, and, where the table has them, distance,
    liquidity, timing, energy, volatility, renovation, district, is_summer_peak,
    inventory and the medians and volumes median_1m, 3m, 6m, volume_3m; what it
    lacks makes what follows from it null. Norms (medians of price and size, the
    95th percentile of liquidity) are of all rows, from counts in ranges.
    """
    given = df = df.withColumns(ratios(df))
    norms = {"_price_norm": ("price_per_sqm", 0.5), "_area_norm": ("living_area", 0.5), "_liquidity_norm": ("liquidity", 0.95)}
    for name, (column, q) in norms.items():
        if column in given.columns:
            df = df.crossJoin(F.broadcast(A.overall_quantiles(given.select(column), column, [q]).select(F.col("q")[0].alias(name))))  # one row
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("double")
    text = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    quality, energy, distance, liquidity, timing = (c(n) for n in ("quality", "energy", "distance", "liquidity", "timing"))
    area, age = F.col("living_area"), c("property_age")
    desirable = DESIRABLE["quality"] * (quality / 10) + (6 - distance) / 5 * DESIRABLE["distance"] + energy / 10 * DESIRABLE["energy"] + safe_divide(liquidity, c("_liquidity_norm")) * DESIRABLE["liquidity"] + (timing + 3) / 6 * DESIRABLE["timing"]
    m1, m3, m6 = c("median_1m"), c("median_3m"), c("median_6m")
    added = {
        "area_location_score": distance * quality, "timing_location_interaction": timing * liquidity, "efficiency_quality_score": energy * quality, "size_era_interaction": area * quality,
        "rooms_efficiency_interaction": F.col("rooms_per_sqm") * energy, "volatility_timing_interaction": c("volatility") * timing, "liquidity_season_interaction": liquidity * c("is_summer_peak"),
        "momentum_distance_interaction": flag(F.col("days_on_market") <= 7) * (5 - distance), "area_age_interaction": area * age, "rooms_age_interaction": F.col("rooms") * age,
        "fee_price_interaction": F.col("monthly_fee") / (F.col("listing_price") + 1), "luxury_score": safe_divide(F.col("price_per_sqm"), c("_price_norm")) * safe_divide(area, c("_area_norm")) * (quality / 10),
        "value_score": safe_divide(area, F.col("listing_price") + F.col("monthly_fee") * 12), "property_desirability_score": clip(desirable, 0.0, 1.0),
        "enhancement_potential": 0.1 * flag(text("renovation") == "high") + 0.15 * flag(text("era").isin("functionalism", "pre_war")) + 0.2 * flag(text("district") == "central_stockholm"),
        "price_acceleration_3m": safe_divide(m1 - m3, m3), "temporal_price_trend": (safe_divide(m1, m3) + safe_divide(m3, m6)) / 2, "demand_supply_ratio": safe_divide(c("volume_3m"), c("inventory")),
        "cost_benefit_ratio": safe_divide(area * energy, F.col("listing_price") + F.col("monthly_fee") * 12 * 5), "efficiency_premium": F.col("price_per_sqm") * (energy / 10) * (quality / 10),
    }
    return df.withColumns(added).drop(*norms)


def luxury(micro: Column, same_size: Column, neighbor: Column, market: Column, central: Column, living_area: Column) -> dict[str, Column]:
    """score (0 to 1), flag (from FLAG_FROM) and tier of a home, from prices per square metre around it against the market's."""
    grown = lambda x: F.coalesce(clip((safe_divide(x, market) - RATIO_LOW) / (RATIO_HIGH - RATIO_LOW), 0.0, 1.0), F.lit(0.0))
    size = F.coalesce(clip((living_area - 70) / 70, 0.0, 1.0), F.lit(0.0))
    parts = {"micro": grown(micro), "same_size": grown(same_size), "neighbor": grown(neighbor), "central": flag(central), "size": size}
    score = clip(sum((parts[k] * w for k, w in LUXURY.items()), F.lit(0.0)), 0.0, 1.0)
    tier = F.lit(LUXURY_TIERS[-1])
    for edge, name in reversed(list(zip(LUXURY_EDGES, LUXURY_TIERS, strict=False))):
        tier = F.when(score <= edge, name).otherwise(tier)
    return {"score": score, "flag": flag(score >= FLAG_FROM), "tier": tier}
