"""Registered queries of market reports: histograms with percentiles, asking against sold prices, drift, interactions, luxury tiers, volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.functions import dates as D
from parcelyard.functions import interactions as N
from parcelyard.functions import math as M
from parcelyard.operators import aggregates as A
from parcelyard.operators import geo as G
from parcelyard.operators import models as P
from parcelyard.operators import relational as R
from parcelyard.operators import temporal as T
from parcelyard.plans.catalog import _BAND, _PREM, _WINDOWS, count, query, r4
from parcelyard.plans.comparables import _MICRO_SQL, EDGE, micro_area, same_size
from parcelyard.plans.insights import valued
from parcelyard.plans.reports import _SCORED_SQL, TIERS, scored
from parcelyard.sources.listings import LISTINGS_SQL
from parcelyard.tables import written

_PCT = (0.01, 0.25, 0.5, 0.75, 0.99)


def _report_sql(name: str, value: str, source: str, bins: int, low: float, high: float, whole: bool) -> str:
    r = (lambda x: f"round_even({x}, 0)") if whole else (lambda x: f"round({x} + 1e-7, 4)")
    qs = "[" + ", ".join(map(str, (*_PCT, low, high))) + "]"
    return f"""{name} AS (SELECT '{name}' AS name, n, {r('q[6]')} AS least, {r('q[7]')} AS most, {r(f'(q[7] - q[6]) / {bins}')} AS bin_width, {', '.join(f'{r(f"q[{i + 1}]")} AS p{round(p * 100)}' for i, p in enumerate(_PCT))},
  (SELECT string_agg(coalesce(h.k, 0)::VARCHAR, ',' ORDER BY i) FROM range({bins}) t(i) LEFT JOIN (SELECT least(floor(({value} - q[6]) / ((q[7] - q[6]) / {bins})), {bins - 1})::BIGINT AS i, count(*) AS k FROM {source} WHERE {value} BETWEEN q[6] AND q[7] GROUP BY 1) h USING (i)) AS counts
  FROM (SELECT count({value}) AS n, quantile_cont({value}, {qs}) AS q FROM {source}))"""


@query(f", pr AS (SELECT {_PREM} AS premium FROM l), {_report_sql('price', 'sold_price', 'l', 24, 0.01, 0.99, True)}, {_report_sql('premium', 'premium', 'pr', 24, 0.005, 0.995, False)} SELECT * FROM price UNION ALL SELECT * FROM premium")
def histogram_reports(l: DataFrame) -> DataFrame:
    """Histograms as reported: percentiles of all values, counts of those within the window, whole numbers for prices."""
    p = l.select(M.premium_pct(F.col("sold_price"), F.col("listing_price")).alias("premium"))
    a, b = A.histogram_report(l, "sold_price", 24, 0.01, 0.99, whole=True), A.histogram_report(p, "premium", 24, 0.005, 0.995, whole=False)
    return a.withColumn("name", F.lit("price")).unionByName(b.withColumn("name", F.lit("premium"))).withColumn("counts", F.array_join("counts", ","))


@query(f", p AS (SELECT sold_price, listing_price, {_PREM} AS premium FROM l WHERE listing_price > 0 AND sold_price IS NOT NULL) SELECT count(*) AS sample_size, round_even(median(listing_price), 0) AS median_listing, round_even(median(sold_price), 0) AS median_sold, round(median(premium) + 1e-7, 4) AS median_premium, round(coalesce(avg(CAST(premium > 0 AS DOUBLE)), 0), 6) AS share_over, round(coalesce(avg(CAST(premium < 0 AS DOUBLE)), 0), 6) AS share_under, round(coalesce(avg(CAST(premium = 0 AS DOUBLE)), 0), 6) AS share_at FROM p")
def listing_vs_sold(l: DataFrame) -> DataFrame:
    """Asking against sold prices over all sales with both, medians from counts in ranges."""
    p = l.where("listing_price > 0 and sold_price is not null").select("sold_price", "listing_price", M.premium_pct(F.col("sold_price"), F.col("listing_price")).alias("premium"))
    shares = p.agg(count().alias("sample_size"), *[F.round(F.coalesce(v, F.lit(0.0)), 6).alias(k) for k, v in A.shares(F.col("premium")).items()])
    for c, name in (("listing_price", "median_listing"), ("sold_price", "median_sold"), ("premium", "median_premium")):
        shares = shares.crossJoin(F.broadcast(A.overall_quantiles(p, c, [0.5]).select(F.col("q")[0].alias(name))))  # one row each
    return shares.withColumns({"median_listing": F.bround("median_listing", 0), "median_sold": F.bround("median_sold", 0), "median_premium": r4("median_premium")})


_CORR = ("sold_price", "listing_price", "living_area", "rooms", "monthly_fee", "construction_year", "days_on_market")
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]


@query(", c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM l" for a, b in _PAIRS) + ") SELECT a, b, round(r, 6) AS r FROM c WHERE abs(r) > 0.5")
def strong_correlations(l: DataFrame) -> DataFrame:
    """Pairs of columns with a correlation beyond a half, all from one pass."""
    return P.correlations(l, _CORR, 0.5).withColumn("r", F.round("r", 6))


_DRIFT = ("living_area", "sold_price", "rooms", "monthly_fee", "listing_price")
_CUT = "1997-01-01"


@query(", k AS (" + " UNION ALL ".join(
    f"SELECT max(abs(cb / tb - cn / tn)) AS ks, max(abs(cb / tb - cn / tn)) > 1.358 * sqrt((max(tb) + max(tn)) / (max(tb) * max(tn))) AS drifted FROM (SELECT sum(b) OVER o AS cb, sum(n) OVER o AS cn, sum(b) OVER () AS tb, sum(n) OVER () AS tn FROM (SELECT {c} AS v, count(*) FILTER (sold_date < DATE '{_CUT}') AS b, count(*) FILTER (sold_date >= DATE '{_CUT}') AS n FROM l WHERE {c} IS NOT NULL GROUP BY 1) WINDOW o AS (ORDER BY v))"
    for c in _DRIFT) + ") SELECT count(*) AS columns, count(*) FILTER (drifted) AS drifted, round(count(*) FILTER (drifted) / count(*), 6) AS share, count(*) FILTER (drifted) / count(*) >= 0.5 AS dataset_drift, round(avg(ks) + 1e-9, 6) AS mean_score FROM k")
def drift_report(l: DataFrame) -> DataFrame:
    """Drift of the whole table between the days before and from a cut: columns drifted, their share, the flag, the mean distance."""
    early = F.col("sold_date") < F.lit(_CUT).cast("date")
    return P.dataset_drift(P.ks_drift(l.where(early), l.where(~early), _DRIFT)).withColumns({"share": F.round("share", 6), "mean_score": F.round(F.col("mean_score") + 1e-9, 6)})


@query(_SCORED_SQL + " SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER () + 1e-9, 6) AS share FROM (SELECT * FROM t WHERE rankable UNION ALL BY NAME SELECT NULL AS tier WHERE FALSE) WHERE tier IS NOT NULL GROUP BY 1")
def value_tier_counts(l: DataFrame) -> DataFrame:
    t = scored(l).where("rankable").groupBy("tier").agg(count().alias("n"))
    total = t.agg(F.sum("n").alias("all"))
    return t.crossJoin(F.broadcast(total)).select("tier", "n", F.round(F.col("n") / F.col("all") + 1e-9, 6).alias("share"))


_VOL = ", ".join(f"CASE WHEN count(*) OVER w{n} > 0 THEN count(sold_price) OVER w{n} END AS v{n}" for n in _WINDOWS)


@query(f", x AS (SELECT listing_id, {_VOL} FROM l WINDOW " + ", ".join(f"w{n} AS (PARTITION BY area ORDER BY sold_date RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)" for n in _WINDOWS) + ") SELECT listing_id, CAST(coalesce(v30, v90, v180, v365, 0) AS BIGINT) AS volume_1m, CAST(coalesce(v90, v180, v365, 0) AS BIGINT) AS volume_3m, CAST(coalesce(v180, v365, 0) AS BIGINT) AS volume_6m, CAST(coalesce(v365, 0) AS BIGINT) AS volume_12m FROM x")
def temporal_volumes(l: DataFrame) -> DataFrame:
    """Sales of the area over 1, 3, 6 and 12 months before; a window without a row takes the next longer one, then 0."""
    t = T.trailing(written(l.select("listing_id", "area", "sold_date", "sold_price"), "listings"), "area", "sold_date", "sold_price", _WINDOWS)
    chain = [F.col(f"count_{n}") for n in _WINDOWS] + [F.lit(0)]
    return t.select("listing_id", *[F.coalesce(*chain[i:]).cast("long").alias(f"volume_{m}m") for i, m in enumerate((1, 3, 6, 12))])


_ERA_Q = "CASE WHEN construction_year <= 1929 THEN 7 WHEN construction_year <= 1945 THEN 8 WHEN construction_year <= 1965 THEN 6 WHEN construction_year <= 1975 THEN 4 WHEN construction_year <= 1990 THEN 7 WHEN construction_year <= 2005 THEN 8 WHEN construction_year <= 2015 THEN 9 ELSE 10 END"
_INTER_SQL = f""", b AS (SELECT listing_id, living_area, rooms, monthly_fee, listing_price, floor, days_on_market, construction_year, {_ERA_Q} AS quality, year(sold_date) - construction_year AS age, nullif(living_area, 0) AS a, 1 + listing_key % 5 AS distance, 0.5 + listing_key % 7 AS liquidity, listing_key % 6 - 3 AS timing FROM l),
  c AS (SELECT *, rooms / a AS rps, listing_price / a AS pps FROM b), m AS (SELECT median(pps) AS pm, median(living_area) FILTER (living_area IS NOT NULL) AS am, quantile_cont(liquidity, 0.95) AS lq FROM c),
  f AS (SELECT listing_id, monthly_fee / a AS fee_efficiency, floor / a AS floor_per_sqm, living_area * living_area AS area_squared, age, distance * quality AS area_location, timing * liquidity AS timing_location, living_area * quality AS size_era, living_area * age AS area_age, rooms * age AS rooms_age, CASE WHEN days_on_market <= 7 THEN 1 ELSE 0 END * (5 - distance) AS momentum_distance,
    pps / nullif(pm, 0) * (living_area / nullif(am, 0)) * (quality / 10) AS luxury, greatest(0, least(1, quality / 10 * 0.3::DOUBLE + (6 - distance) / 5 * 0.25::DOUBLE + 5 / 10 * 0.2::DOUBLE + liquidity / lq * 0.15::DOUBLE + (timing + 3) / 6 * 0.1::DOUBLE)) AS desirability,
    CASE WHEN construction_year <= 1945 THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS enhancement, a * 5 / nullif(listing_price + monthly_fee * 12 * 5, 0) AS cost_benefit, pps * 0.5::DOUBLE * (quality / 10) AS efficiency_premium FROM c, m)"""
_INTER = ("fee_efficiency", "floor_per_sqm", "area_squared", "age", "area_location", "timing_location", "size_era", "area_age", "rooms_age", "momentum_distance", "luxury", "desirability", "enhancement", "cost_benefit", "efficiency_premium")


@query(_INTER_SQL + " SELECT listing_id, " + ", ".join(f"round({c}::DOUBLE + 1e-8, 6) AS {c}" for c in _INTER) + " FROM f")
def interaction_features(l: DataFrame) -> DataFrame:
    """Ratios and interactions of size, age, quality, place and time, and the scores made of them."""
    key = F.col("listing_key")
    rows = l.withColumns({"distance": 1 + key % 5, "liquidity": 0.5 + key % 7, "timing": key % 6 - 3, "energy": F.lit(5.0), "volatility": F.lit(0.1)})
    made = N.with_interactions(rows.withColumns({"quality": C.quality(C.era(F.col("construction_year"))), "era": C.era(F.col("construction_year")), "property_age": F.year("sold_date") - F.col("construction_year")}))
    return made.select("listing_id", *[F.round(F.col(N.NAMES[c]).cast("double") + 1e-8, 6).alias(c) for c in _INTER])


_q = lambda w: f"{{'p50': quantile_cont(ppsqm, 0.5) OVER {w}, 'p75': quantile_cont(ppsqm, 0.75) OVER {w}, 'p90': quantile_cont(ppsqm, 0.9) OVER {w}, 'n': count(ppsqm) OVER {w}}}"
_BEFORE = "ORDER BY sold_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"
_CENTRAL = ("NATION_1", "NATION_2", "NATION_3")
_part = lambda x: f"CASE WHEN {x} IS NULL THEN 0 ELSE greatest(0, least(1, ({x} - 0.9::DOUBLE) / (1.35::DOUBLE - 0.9::DOUBLE))) END"


@query(_MICRO_SQL + f""", z0 AS (SELECT *, {_q('wc')} AS zc, {_q('wa')} AS za, {_q('wg')} AS zg, strftime(sold_date, '%Y-%m') AS mon FROM m WINDOW wc AS (PARTITION BY cx, cy, band {_BEFORE}), wa AS (PARTITION BY area, band {_BEFORE}), wg AS (PARTITION BY band {_BEFORE})),
  mk AS (SELECT median(ppsqm) AS market FROM l), z1 AS (SELECT *, mi.p50 / market AS rm, coalesce(CASE WHEN zc.n >= 5 THEN zc.p50 WHEN za.n >= 5 THEN za.p50 WHEN zg.n >= 1 THEN zg.p50 END, mi.p50) / market AS rz FROM z0, mk),
  s AS (SELECT listing_id, greatest(0, least(1, {_part('rm')} * 0.42::DOUBLE + {_part('rz')} * 0.22::DOUBLE + {_part('rm')} * 0.14::DOUBLE + CASE WHEN area IN {_CENTRAL} THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN living_area IS NULL THEN 0 ELSE greatest(0, least(1, (living_area - 70) / 70)) END * 0.1::DOUBLE)) AS score FROM z1)
  SELECT listing_id, round(score + 1e-9, 6) AS score, CASE WHEN score >= 0.65 THEN 1 ELSE 0 END AS flag, CASE WHEN score <= 0.25 THEN 'standard' WHEN score <= 0.5 THEN 'strong' WHEN score <= 0.75 THEN 'premium' ELSE 'luxury' END AS tier FROM s""")
def luxury_tiers(l: DataFrame) -> DataFrame:
    """The composite of micro area, same size, neighbours (here the micro area again), central areas and size; its flag and tiers."""
    l = written(l.select("listing_id", "area", "living_area", "sold_date", "ppsqm", "lat", "lon"), "listings")
    rows = same_size(micro_area(l), l)
    market = A.overall_quantiles(l, "ppsqm", [0.5]).select(F.col("q")[0].alias("market"))
    rows = rows.crossJoin(F.broadcast(market))  # one row
    got = N.luxury(F.col("micro_p50"), F.col("same_size_p50"), F.col("micro_p50"), F.col("market"), F.col("area").isin(*_CENTRAL), F.col("living_area"))
    return rows.select("listing_id", F.round(got["score"] + 1e-9, 6).alias("score"), got["flag"].alias("flag"), got["tier"].alias("tier"))


@query(", t AS (SELECT area, count(*) AS n, round(avg(days_on_market) FILTER (elevator), 3) AS mean_dom FROM l GROUP BY 1) SELECT area, n, mean_dom, CAST(row_number() OVER (ORDER BY mean_dom ASC NULLS LAST, area) AS INTEGER) AS up, CAST(row_number() OVER (ORDER BY mean_dom DESC NULLS LAST, area) AS INTEGER) AS down, CAST(row_number() OVER (ORDER BY lower(area), area) AS INTEGER) AS by_name FROM t")
def area_table_sorted(l: DataFrame) -> DataFrame:
    """The table of areas in the orders that a click on a column gives, unknown values last both ways."""
    t = l.groupBy("area").agg(count().alias("n"), F.round(F.avg(F.when(F.col("elevator"), F.col("days_on_market"))), 3).alias("mean_dom"))
    return A.sort_places(t, "area", {"up": ("mean_dom", False), "down": ("mean_dom", True), "by_name": ("area", False)})




_ROOM_STATS = {"median_price": "median(sold_price)", "mean_price": "avg(sold_price)", "median_ppsqm": "median(ppsqm)", "median_size": "median(living_area)", "median_dom": "median(days_on_market)", "mean_fee": "avg(monthly_fee)", "std_price": "stddev_samp(sold_price)"}
_ROOM_SQL = "CASE WHEN rooms >= 4 THEN '4+' WHEN rooms IN (1, 2, 3) THEN CAST(CAST(rooms AS INTEGER) AS VARCHAR) END"


@query(f", r AS (SELECT *, {_ROOM_SQL} AS room FROM l) SELECT area, CASE WHEN grouping(room) = 1 THEN 'all' ELSE room END AS room, " + ", ".join(f"round({v} + 1e-6, 3) AS {k}" for k, v in _ROOM_STATS.items())
  + ", count(*) AS n, count(*) FILTER (elevator) AS n_elevator, count(*) < 10 AS limited FROM r GROUP BY GROUPING SETS ((area, room), (area)) HAVING grouping(room) = 1 OR room IS NOT NULL")
def room_reports(l: DataFrame) -> DataFrame:
    """The report of each area over all its sales and over those of 1, 2, 3 and 4 or more rooms; sales of an unknown number count among all."""
    rows = l.withColumn("room", C.room_bucket(F.col("rooms")))
    g = rows.groupingSets([["area", "room"], ["area"]], "area", "room")
    value = {"median_price": A.median("sold_price"), "mean_price": F.avg("sold_price"), "median_ppsqm": A.median("ppsqm"), "median_size": A.median("living_area"), "median_dom": A.median("days_on_market"), "mean_fee": F.avg("monthly_fee"), "std_price": F.stddev_samp("sold_price")}
    t = g.agg(F.grouping("room").alias("_all"), *[F.round(v + 1e-6, 3).alias(k) for k, v in value.items()], count().alias("n"), F.count(F.when(F.col("elevator"), 1)).alias("n_elevator"))
    return t.where("_all = 1 or room is not null").select("area", F.when(F.col("_all") == 1, "all").otherwise(F.col("room")).alias("room"), *value, "n", "n_elevator", (F.col("n") < 10).alias("limited"))


#: Names that go together whatever their counts, names that take sparse ones, and rows below which a name is sparse.
_TOGETHER, _PARENTS, _SPARSE = {"STANDARD BRUSHED TIN": "STANDARD TIN", "PROMO PLATED TIN": "PROMO TIN"}, ("ECONOMY", "LARGE", "MEDIUM", "TIN"), 5


@query(f"""WITH s AS (SELECT p_type AS area, count(*) AS n FROM part GROUP BY 1)
  SELECT p_partkey, CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TOGETHER.items())} ELSE CASE WHEN n < {_SPARSE} THEN CASE {' '.join(f"WHEN contains(p_type, '{p}') AND p_type <> '{p}' THEN '{p}'" for p in _PARENTS)} ELSE p_type END ELSE p_type END END AS area FROM part JOIN s ON s.area = p_type""", on_listings=False)
def consolidated_areas(spark, d: str) -> DataFrame:
    """Names by an explicit map, then sparse ones to the first parent that they contain."""
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_type").alias("area"))
    return R.consolidated(part, "area", _TOGETHER, _PARENTS, _SPARSE).select("p_partkey", "area")
