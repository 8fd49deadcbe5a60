"""Registered queries over valued listings: scores, search, blends, metrics, drift, text and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.functions import dates as D
from parcelyard.functions import math as M
from parcelyard.functions import strings as S
from parcelyard.operators import aggregates as A
from parcelyard.operators import geo as G
from parcelyard.operators import models as P
from parcelyard.operators.search import Query, facets, similar
from parcelyard.plans.catalog import _ROOM, MILLION, count, query, r4
from parcelyard.sources.listings import LISTINGS_SQL, listings, table

#: A deterministic stand-in for a model: the area's median price per square metre times the size.
_PRED_SQL = ", am AS (SELECT area, median(ppsqm) AS am FROM l GROUP BY 1), v AS (SELECT l.*, am.am AS am, am.am * living_area AS predicted, 0.5 * am.am * living_area + 0.5 * listing_price AS other FROM l JOIN am USING (area) WHERE living_area IS NOT NULL)"


def predicted(l: DataFrame) -> DataFrame:
    m = l.groupBy("area").agg(A.median("ppsqm").alias("am"))
    v = l.where("living_area is not null").join(F.broadcast(m), "area").withColumn("predicted", F.col("am") * F.col("living_area"))
    return v.withColumn("other", 0.5 * F.col("predicted") + 0.5 * F.col("listing_price"))


@query()
def value_metrics(l: DataFrame) -> DataFrame:
    """Rows only: the normal quantile has no SQL twin."""
    v = P.value_metrics(predicted(l).select("listing_id", "area", "sold_price", "predicted"), "predicted", "sold_price", "listing_id")
    return v.select("listing_id", F.round("delta_pct", 4).alias("delta_pct"), "rank", "score", C.value_tier(F.col("score")).alias("tier"))


@query(_PRED_SQL + ", d AS (SELECT listing_id, (predicted - sold_price) * 100 / sold_price AS p FROM v) SELECT listing_id, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rank FROM d")
def rank_average(l: DataFrame) -> DataFrame:
    return P.value_metrics(predicted(l).select("listing_id", "sold_price", "predicted"), "predicted", "sold_price", "listing_id").select("listing_id", "rank")


_FIND = "area IN ('NATION_3', 'NATION_7', 'NATION_11') AND living_area BETWEEN 40 AND 160 AND predicted >= 50000 AND elevator IS NOT DISTINCT FROM TRUE AND (contains(lower(address), 'street1') OR contains(lower(listing_id), 'street1') OR contains(lower(area), 'street1'))"
_QUERY = Query(sets={"area": ["NATION_3", "NATION_7", "NATION_11"]}, ranges={"living_area": (40, 160), "predicted": (50000, None)}, flags={"elevator": True}, text="Street1", sort="days_on_market", descending=True, limit=20, offset=5)


@query(_PRED_SQL + f" SELECT listing_id, area, living_area FROM v WHERE {_FIND}")
def value_finder_search(l: DataFrame) -> DataFrame:
    return predicted(l).where(_QUERY.condition()).select("listing_id", "area", "living_area")


@query(_PRED_SQL + f" SELECT listing_id, days_on_market FROM v WHERE {_FIND} ORDER BY days_on_market DESC NULLS LAST, listing_id LIMIT 20 OFFSET 5")
def value_finder_page(l: DataFrame) -> DataFrame:
    return _QUERY.page(predicted(l), "listing_id").select("listing_id", "days_on_market")


@query(_PRED_SQL + f" SELECT count(*) AS total, CAST(1 AS INTEGER) AS page, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages FROM v WHERE {_FIND}")
def value_finder_totals(l: DataFrame) -> DataFrame:
    return _QUERY.totals(predicted(l))


@query("SELECT (SELECT string_agg(DISTINCT area, '|' ORDER BY area) FROM l) AS area_values, (SELECT string_agg(DISTINCT municipality, '|' ORDER BY municipality) FROM l) AS municipality_values, min(sold_price) AS sold_price_min, max(sold_price) AS sold_price_max, min(living_area) AS living_area_min, max(living_area) AS living_area_max FROM l")
def facets_of_listings(l: DataFrame) -> DataFrame:
    return facets(l, ["area", "municipality"], ["sold_price", "living_area"])


@query(", a AS (SELECT area, median(sold_price) AS p FROM l GROUP BY 1), t AS (SELECT area, p, CASE WHEN p > 160000 THEN 'high' WHEN p > 150000 THEN 'mid' ELSE 'low' END AS tier FROM a), s AS (SELECT x.area, y.area AS other, CASE WHEN x.tier = y.tier THEN 3 ELSE 0 END + CASE WHEN abs(y.p - x.p) / x.p < 0.1 THEN 2 WHEN abs(y.p - x.p) / x.p < 0.2 THEN 1 ELSE 0 END AS score FROM t x JOIN t y ON x.area <> y.area) SELECT area, other, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY area ORDER BY score DESC, other) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def similar_areas(l: DataFrame) -> DataFrame:
    a = l.groupBy("area").agg(A.median("sold_price").alias("p")).withColumn("tier", F.when(F.col("p") > 160000, "high").when(F.col("p") > 150000, "mid").otherwise("low"))
    return similar(a, "area", "tier", "p")


_EDGES = (50_000.0, 100_000.0, 150_000.0, 200_000.0, 300_000.0)
_BUCKET = " + ".join(f"CASE WHEN predicted >= {e} THEN 1 ELSE 0 END" for e in _EDGES)


_FACTORS_SQL = (f", r AS (SELECT {_BUCKET} AS bucket, sold_price / predicted AS r FROM v WHERE predicted > 0 AND sold_date >= (SELECT max(sold_date) - INTERVAL 3 MONTHS FROM v)), p AS (SELECT quantile_cont(r, 0.35) AS a, quantile_cont(r, 0.65) AS b FROM r), o AS (SELECT bucket, quantile_cont(r, 0.35) AS a, quantile_cont(r, 0.65) AS b, count(*) AS n FROM r GROUP BY 1),"
  " f AS (SELECT CAST(i AS INTEGER) AS bucket, round_even(CASE WHEN coalesce(n, 0) < 100 THEN p.a ELSE o.a END, 4) AS lower, round_even(CASE WHEN coalesce(n, 0) < 100 THEN p.b ELSE o.b END, 4) AS upper, coalesce(n, 0) AS sample_size, coalesce(n, 0) < 100 AS fallback FROM range(6) x(i), p LEFT JOIN o ON o.bucket = i)")  # fmt: skip


@query(_PRED_SQL + _FACTORS_SQL + " SELECT * FROM f")
def range_factors(l: DataFrame) -> DataFrame:
    return P.range_factors(predicted(l), "sold_date", "sold_price", "predicted", _EDGES)


@query(_PRED_SQL + _FACTORS_SQL + f" SELECT listing_id, floor(predicted / 1000 + 0.5) * 1000 AS center, floor(predicted * f.lower / 1000) * 1000 AS low, ceil(predicted * f.upper / 1000) * 1000 AS high FROM v JOIN f ON f.bucket = {_BUCKET}")
def estimate_range(l: DataFrame) -> DataFrame:
    """The prediction as a window of whole thousands by the factors of its bucket."""
    v = predicted(l)
    factors = P.range_factors(v, "sold_date", "sold_price", "predicted", _EDGES)
    return P.estimate_range(v, "predicted", factors, _EDGES, 1000.0).select("listing_id", "center", "low", "high")


_METRICS = "count(*) AS n, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(a), 6) AS mape, round(median(a), 6) AS median_ape, round(avg(e), 3) AS bias, round(avg(CASE WHEN a <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS within_10, round(avg(CASE WHEN a <= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS within_20"


def _metric_columns(v: DataFrame) -> list:
    digits = {"n": None, "mae": 3, "rmse": 3, "bias": 3}
    return [m.alias(k) if digits.get(k, 6) is None else F.round(m, digits.get(k, 6)).alias(k) for k, m in A.errors(F.col("sold_price"), F.col("predicted")).items()]


@query(_PRED_SQL + f", e AS (SELECT predicted - sold_price AS e, abs(predicted - sold_price) / abs(sold_price) AS a FROM v) SELECT {_METRICS} FROM e")
def regression_metrics(l: DataFrame) -> DataFrame:
    v = predicted(l).withColumn("ape", F.try_divide(F.abs(F.col("predicted") - F.col("sold_price")), F.abs(F.nullif("sold_price", F.lit(0.0)))))
    rest = v.agg(*[c for c, name in zip(_metric_columns(v), A.errors(F.col("sold_price"), F.col("predicted")), strict=True) if name != "median_ape"])
    return rest.crossJoin(F.broadcast(A.overall_medians(v, ["ape"]).select(F.round("ape", 6).alias("median_ape"))))  # one row


@query(_PRED_SQL + f", e AS (SELECT area, predicted - sold_price AS e, abs(predicted - sold_price) / abs(sold_price) AS a FROM v) SELECT area, {_METRICS} FROM e GROUP BY area HAVING count(*) >= 10")
def area_error(l: DataFrame) -> DataFrame:
    v = predicted(l)
    return v.groupBy("area").agg(*_metric_columns(v)).where("n >= 10")


@query(_PRED_SQL + ", g AS (SELECT i, avg(abs((1 - i / 20) * predicted + (i / 20) * listing_price - sold_price)) AS mae FROM v, range(21) x(i) GROUP BY 1) SELECT i / 20 AS weight, round(mae, 3) AS mae FROM g ORDER BY round(g.mae, 6), i LIMIT 1")
def weight_grid_argmin(l: DataFrame) -> DataFrame:
    return P.best_weight(predicted(l), "sold_price", "predicted", "listing_price").withColumn("mae", F.round("mae", 3))


@query(_PRED_SQL + " SELECT listing_id, CASE WHEN predicted < 100000 THEN 'low' WHEN predicted >= 200000 THEN 'high' ELSE 'mid' END AS gate, round(CASE WHEN predicted < 100000 THEN 0.75 * predicted + 0.25 * other WHEN predicted >= 200000 THEN 0.25 * predicted + 0.75 * other ELSE 0.5 * predicted + 0.5 * other END + 1e-7, 4) AS blended FROM v")
def gated_blend(l: DataFrame) -> DataFrame:
    v = predicted(l).withColumn("gate", P.gate(F.col("predicted"), 100_000.0, 200_000.0))
    base, other = F.col("predicted"), F.col("other")
    blended = F.when(F.col("gate") == "low", P.blend(base, other, 0.25)).when(F.col("gate") == "high", P.blend(base, other, 0.75)).otherwise(P.blend(base, other, 0.5))
    return v.select("listing_id", "gate", r4(blended).alias("blended"))


@query(_PRED_SQL + " SELECT listing_id, round(greatest(0, predicted + CASE WHEN predicted >= 150000 THEN greatest(-least(20000, 0.12 * abs(predicted)), least(least(20000, 0.12 * abs(predicted)), sold_price - predicted)) ELSE 0 END) + 1e-7, 4) AS calibrated FROM v")
def calibration_clip(l: DataFrame) -> DataFrame:
    c = P.calibrated(F.col("predicted"), F.col("sold_price") - F.col("predicted"), 20_000.0, 0.12, 150_000.0)
    return predicted(l).select("listing_id", r4(c).alias("calibrated"))


@query(_PRED_SQL + ", m AS (SELECT date_trunc('month', sold_date)::DATE AS month, median(ppsqm) AS idx FROM l GROUP BY 1), r AS (SELECT arg_max(idx, month) AS ref FROM m) SELECT listing_id, round(sold_price * ref / idx + 1e-7, 4) AS normalized, round(predicted * idx / ref + 1e-7, 4) AS denormalized FROM v JOIN m ON date_trunc('month', sold_date)::DATE = m.month, r")
def market_normalized(l: DataFrame) -> DataFrame:
    m = l.groupBy(F.trunc("sold_date", "MM").alias("month")).agg(A.median("ppsqm").alias("idx"))
    v = predicted(l).withColumn("month", F.trunc("sold_date", "MM")).join(F.broadcast(m), "month").crossJoin(F.broadcast(m.agg(F.max_by("idx", "month").alias("ref"))))
    idx, ref = F.col("idx"), F.col("ref")
    return v.select("listing_id", r4(P.market_normalized(F.col("sold_price"), idx, ref)).alias("normalized"), r4(P.denormalized(F.col("predicted"), idx, ref, F.col("predicted"))).alias("denormalized"))


@query(_PRED_SQL + ", q AS (SELECT quantile_cont(am, 0.25) AS a, quantile_cont(am, 0.5) AS b, quantile_cont(am, 0.75) AS c FROM v) SELECT listing_id, CASE WHEN am <= a THEN 'budget' WHEN am <= b THEN 'mid' WHEN am <= c THEN 'premium' ELSE 'luxury' END AS tier FROM v, q")
def qcut_tiers(l: DataFrame) -> DataFrame:
    v = predicted(l).select("listing_id", "am")
    q = A.overall_quantiles(v, "am", [0.25, 0.5, 0.75])
    x, e = F.col("am"), F.col("q")
    return v.crossJoin(F.broadcast(q)).select("listing_id", F.when(x <= e[0], "budget").when(x <= e[1], "mid").when(x <= e[2], "premium").otherwise("luxury").alias("tier"))


@query(""", b AS (SELECT living_area AS v FROM l WHERE sold_date < DATE '1998-01-01' AND living_area IS NOT NULL), n AS (SELECT living_area AS v FROM l WHERE sold_date >= DATE '1998-01-01' AND living_area IS NOT NULL), x AS (SELECT v, sum(b) OVER o AS cb, sum(n) OVER o AS cn, sum(b) OVER () AS tb, sum(n) OVER () AS tn FROM (SELECT v, sum(b) AS b, sum(n) AS n FROM (SELECT v, 1 AS b, 0 AS n FROM b UNION ALL SELECT v, 0, 1 FROM n) GROUP BY v) WINDOW o AS (ORDER BY v))
  SELECT 'living_area' AS column_name, round(max(abs(cb / tb - cn / tn)), 6) AS ks, max(abs(cb / tb - cn / tn)) > 1.358 * sqrt((max(tb) + max(tn)) / (max(tb) * max(tn))) AS drifted FROM x""")
def drift_ks(l: DataFrame) -> DataFrame:
    cut = F.lit("1998-01-01").cast("date")
    return P.ks_drift(l.where(F.col("sold_date") < cut), l.where(F.col("sold_date") >= cut), ["living_area"]).withColumn("ks", F.round("ks", 6))


@query(""", b AS (SELECT area, count(*) AS b FROM l WHERE sold_date < DATE '1998-01-01' GROUP BY 1), n AS (SELECT area, count(*) AS n FROM l WHERE sold_date >= DATE '1998-01-01' GROUP BY 1), x AS (SELECT coalesce(b, 0) / (SELECT sum(b) FROM b) AS p, coalesce(n, 0) / (SELECT sum(n) FROM n) AS q FROM b FULL JOIN n USING (area))
  SELECT round(sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))), 6) AS js FROM x""")
def drift_js(l: DataFrame) -> DataFrame:
    cut = F.lit("1998-01-01").cast("date")
    return P.js_drift(l.where(F.col("sold_date") < cut), l.where(F.col("sold_date") >= cut), "area").withColumn("js", F.round("js", 6))


_POIS = [(59.25 + i / 25, 17.95 + i / 20) for i in range(6)]
_HAVERSINE = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"


@query(", p(plat, plon) AS (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in _POIS) + f"), h AS (SELECT listing_id, pow(sin((radians(plat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin((radians(plon) - radians(lon)) / 2), 2) AS h FROM l, p), d AS (SELECT listing_id, {_HAVERSINE} AS d FROM h)"
  " SELECT listing_id, round(min(d), 3) AS nearest_m, CAST(count(*) FILTER (d <= 2500) AS INTEGER) AS within_2500, CAST(count(*) FILTER (d <= 8000) AS INTEGER) AS within_8000 FROM d GROUP BY 1")  # fmt: skip
def poi_nearest_within(l: DataFrame) -> DataFrame:
    return G.near_points(l.select("listing_id", "lat", "lon"), _POIS, [2500, 8000]).select("listing_id", F.round("nearest_m", 3).alias("nearest_m"), "within_2500", "within_8000")


# ---- text, casts, dates, classes --------------------------------------------------------------------------------------------


@query("""SELECT listing_id, lower(regexp_replace(replace(lower(area || ' Östra'), 'ö', 'o'), '[^a-z0-9_]+', '_', 'g')) AS slug, regexp_replace(lower(address), '\\s+\\d+\\w?.*$', '') AS street, replace(address, ' ', '') <> address AS spaced FROM l""")
def area_slug_street(l: DataFrame) -> DataFrame:
    # every space that doesn't break, as it is and escaped, and every kind of last part that names no area
    spaces, ends = [*S.NBSP, *S.NBSP_ESCAPED, " "], ["Stockholm", "Stockholms stad", "Stockholms kommun", "Stockholms län"]
    one = lambda given, step: F.get(F.array(*map(F.lit, given)), (F.floor(F.col("listing_key") / step) % len(given)).cast("int"))
    full = F.concat(F.lit("Lägenhet ·"), one(spaces, 1), F.col("area"), one(spaces, 9), F.lit("Östra · "), one(ends, 3))
    return l.select("listing_id", S.area_slug(full).alias("slug"), S.street_ml(F.col("address")).alias("street"), F.col("address").contains(" ").alias("spaced"))


@query("SELECT listing_id, address || ', ' || replace(lower(area), ' ', '_') AS geocode_key, regexp_replace(lower(address), '\\s+\\d+\\w?.*$', '') || '|' || area AS street_area FROM l")
def address_keys(l: DataFrame) -> DataFrame:
    return l.select("listing_id", S.geocode_key(F.col("address"), F.col("area")).alias("geocode_key"), S.compound_key(S.street_ml(F.col("address")), F.col("area")).alias("street_area"))


def _any_sql(phrases) -> str:
    return "CASE WHEN " + " OR ".join(f"contains(t, '{p}')" for p in phrases) + " THEN 1 ELSE 0 END"


_TEXT = {"renovated": S.RENOVATED, "modern_kitchen": S.KITCHEN, "modern_bathroom": S.BATH, "has_view": S.VIEW, "quiet": S.QUIET, "needs_renovation": S.NEEDS}


@query(f"""WITH t AS (SELECT doc_id, trim(regexp_replace(translate(lower(text), '{S.ACCENTED}', '{S.PLAIN}'), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents),
  f AS (SELECT doc_id, t, {', '.join(f'{_any_sql(p)} AS {k}' for k, p in _TEXT.items())}, {' + '.join(f"CASE WHEN contains(t, '{p}') THEN 1 ELSE 0 END" for p in S.LUXURY)} AS luxury_count FROM t)
  SELECT doc_id, length(t) AS length, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS BIGINT) AS words, * EXCLUDE (doc_id, t), CAST(greatest(0, least(5, renovated + modern_kitchen + modern_bathroom + 0.5 * quiet - 2 * needs_renovation)) AS DOUBLE) AS condition, CAST(greatest(0, least(8, luxury_count + has_view + 0.5 * (modern_kitchen + modern_bathroom + quiet))) AS DOUBLE) AS premium_text FROM f""", on_listings=False)
def text_features(spark: SparkSession, d: str) -> DataFrame:
    f = S.description_features(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in f.items()])


@query("""WITH v AS (SELECT o_orderkey, list_element(['ja', 'Nej', ' TRUE ', 'f', '1', '0', 'maybe', '', 'Y', 'no'], CAST(o_orderkey % 10 + 1 AS INTEGER)) AS raw FROM orders)
  SELECT o_orderkey, CASE WHEN lower(trim(raw)) IN ('true', 't', 'yes', 'y', 'ja', '1') THEN TRUE WHEN lower(trim(raw)) IN ('false', 'f', 'no', 'n', 'nej', '0') THEN FALSE END AS flag FROM v""", on_listings=False)
def bool_contract(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["ja", "Nej", " TRUE ", "f", "1", "0", "maybe", "", "Y", "no"])), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.to_bool(raw).alias("flag"))


@query("""WITH v AS (SELECT o_orderkey, list_element(['1 250,5', '12', ' 7.9 ', 'n/a', '', '-3,2'], CAST(o_orderkey % 6 + 1 AS INTEGER)) AS raw FROM orders)
  SELECT o_orderkey, TRY_CAST(replace(regexp_replace(raw, '\\s', '', 'g'), ',', '.') AS DOUBLE) AS number, CAST(trunc(TRY_CAST(regexp_replace(raw, '\\s', '', 'g') AS DOUBLE)) AS BIGINT) AS whole FROM v""", on_listings=False)
def dirty_numbers(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["1 250,5", "12", " 7.9 ", "n/a", "", "-3,2"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.to_float(raw).alias("number"), S.to_int(raw).alias("whole"))


@query("""SELECT listing_id, CAST(month(sold_date) AS INTEGER) AS month, CAST(quarter(sold_date) AS INTEGER) AS quarter, CAST(isodow(sold_date) - 1 AS INTEGER) AS weekday, CAST(CASE WHEN isodow(sold_date) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS weekend, round(sin(2 * pi() * month(sold_date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(sold_date) / 12), 6) AS month_cos,
  (date_trunc('month', sold_date) - INTERVAL 1 MONTH)::DATE AS lookup_month, CAST((year(sold_date) - 2020) * 12 + month(sold_date) - 1 AS INTEGER) AS months_since FROM l""")
def cyclic_dates(l: DataFrame) -> DataFrame:
    c = D.cyclic(F.col("sold_date"))
    return l.select("listing_id", c["month"].alias("month"), c["quarter"].alias("quarter"), c["weekday"].alias("weekday"), c["weekend"].alias("weekend"), F.round(c["month_sin"], 6).alias("month_sin"), F.round(c["month_cos"], 6).alias("month_cos"), D.lookup_month(F.col("sold_date"), F.col("scraped_at")).alias("lookup_month"), D.months_since(F.col("sold_date")).alias("months_since"))


_SEASON = "CASE WHEN m IN (12, 1, 2) THEN 'winter_slow' WHEN m IN (3, 4) THEN 'spring_awakening' WHEN m IN (5, 6, 7, 8) THEN 'summer_peak' WHEN m IN (9, 10) THEN 'autumn_rush' ELSE 'pre_winter' END"
_SCHOOL = "CASE WHEN m IN (6, 7) THEN 'summer_vacation' WHEN m IN (8, 9) THEN 'school_start' WHEN m IN (12, 1) THEN 'winter_break' WHEN m IN (3, 4) THEN 'spring_semester' ELSE 'regular_period' END"


@query(f""", x AS (SELECT *, month(sold_date) AS m, year(sold_date) AS y, year(sold_date) - construction_year AS age FROM l)
  SELECT listing_id, CASE WHEN construction_year <= 1929 THEN 'pre_war' WHEN construction_year <= 1945 THEN 'functionalism' WHEN construction_year <= 1965 THEN 'post_war_boom' WHEN construction_year <= 1975 THEN 'million_programme' WHEN construction_year <= 1990 THEN 'late_modern' WHEN construction_year <= 2005 THEN 'contemporary' WHEN construction_year <= 2015 THEN 'energy_efficient' ELSE 'newest' END AS era,
  CASE WHEN age BETWEEN 30 AND 50 THEN 'high' WHEN age BETWEEN 15 AND 70 THEN 'medium' ELSE 'low' END AS renovation, CASE WHEN age <= 10 THEN 'new' WHEN age <= 30 THEN 'modern' ELSE 'old' END AS age_bucket, {_SEASON} AS season, {_SCHOOL} AS school, list_element(['downturn', 'recovery', 'expansion', 'peak'], CAST(y % 4 + 1 AS INTEGER)) AS cycle,
  CASE WHEN days_on_market IS NULL THEN 'normal' WHEN days_on_market <= 7 THEN 'hot_market' WHEN days_on_market <= 21 THEN 'normal' WHEN days_on_market <= 60 THEN 'slow' ELSE 'stagnant' END AS dom_momentum, CASE WHEN floor <= 0 THEN 'ground' WHEN floor <= 2 THEN 'low' WHEN floor <= 5 THEN 'mid' ELSE 'high' END AS floor_tier,
  CASE WHEN sold_price > 350000 THEN 'ultra_premium' WHEN sold_price > 300000 THEN 'premium' WHEN sold_price > 250000 THEN 'upper' WHEN sold_price > 200000 THEN 'medium' ELSE 'affordable' END AS price_tier,
  CAST(CASE WHEN living_area IS NULL THEN 5.0 ELSE least(10, greatest(1, CASE WHEN construction_year >= 2010 THEN 9 WHEN construction_year >= 2000 THEN 7.5 WHEN construction_year >= 1990 THEN 6 WHEN construction_year >= 1980 THEN 5 WHEN construction_year >= 1970 THEN 4 ELSE 6 END + CASE WHEN living_area < 40 THEN 1 WHEN living_area < 60 THEN 0.5 WHEN living_area > 80 THEN -0.5 ELSE 0 END)) END AS DOUBLE) AS energy FROM x""")
def classifiers(l: DataFrame) -> DataFrame:
    y, year, month = F.col("construction_year"), F.year("sold_date"), F.month("sold_date")
    age = year - y
    return l.select(
        "listing_id", C.era(y).alias("era"), C.renovation(age).alias("renovation"), C.age_bucket(age).alias("age_bucket"), C.in_sets(month, C.SEASONS).alias("season"), C.in_sets(month, C.SCHOOL, "regular_period").alias("school"), C.cycle(year).alias("cycle"),
        C.dom_momentum(F.col("days_on_market")).alias("dom_momentum"), C.floor_tier(F.col("floor")).alias("floor_tier"), C.price_tier(F.col("sold_price"), MILLION).alias("price_tier"), C.energy(y, F.col("living_area")).alias("energy"),
    )


@query("""SELECT listing_id, round(rooms / nullif(living_area, 0), 6) AS rooms_per_sqm, round((monthly_fee * 12 + listing_price) / nullif(living_area, 0) + 1e-7, 4) AS total_cost_per_sqm, round(living_area / nullif(listing_price + monthly_fee * 12, 0), 9) AS value_score, round(monthly_fee / (listing_price + 1), 9) AS fee_price, round(1.5::DOUBLE * CASE WHEN elevator THEN 1 ELSE 0 END + CASE WHEN balcony THEN 1 ELSE 0 END - 0.8 * CASE WHEN floor > 3 AND NOT coalesce(elevator, FALSE) THEN 1 ELSE 0 END - 0.3 * CASE WHEN floor <= 2 AND elevator THEN 1 ELSE 0 END, 4) AS amenity_score, round(CASE WHEN floor > 0 THEN ln(1 + floor) ELSE 0 END, 6) AS floor_premium,
  CASE WHEN rooms / living_area <= 0.03 THEN 'luxury_spacious' WHEN rooms / living_area <= 0.06 THEN 'spacious' WHEN rooms / living_area <= 0.1 THEN 'efficient' WHEN rooms / living_area > 0.1 THEN 'cramped' END AS space_efficiency FROM l""")
def interactions(l: DataFrame) -> DataFrame:
    area, fee, listed = F.col("living_area"), F.col("monthly_fee"), F.col("listing_price")
    rooms = M.safe_divide(F.col("rooms"), area)
    return l.select(
        "listing_id", F.round(rooms, 6).alias("rooms_per_sqm"), r4(M.safe_divide(fee * 12 + listed, area)).alias("total_cost_per_sqm"), F.round(M.safe_divide(area, listed + fee * 12), 9).alias("value_score"), F.round(fee / (listed + 1), 9).alias("fee_price"),
        F.round(M.amenity_score(F.col("elevator"), F.col("balcony"), F.col("floor")), 4).alias("amenity_score"), F.round(M.floor_premium(F.col("floor")), 6).alias("floor_premium"), C.space_efficiency(rooms).alias("space_efficiency"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", on_listings=False)
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"SELECT listing_id, {_ROOM} AS room FROM l WHERE rooms >= 2 AND elevator IS NOT DISTINCT FROM TRUE ORDER BY sold_price DESC NULLS LAST, listing_id LIMIT 100")
def sort_nulls_last_both(l: DataFrame) -> DataFrame:
    return Query(ranges={"rooms": (2, None)}, flags={"elevator": True}, sort="sold_price", limit=100).page(l, "listing_id").select("listing_id", C.room_bucket(F.col("rooms")).alias("room"))


@query(""", s AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 45 DAYS))::DATE AS start) SELECT start, least(start + 44, DATE '1995-12-31') AS stop, count(listing_id) AS n FROM s LEFT JOIN l ON sold_date BETWEEN start AND least(start + 44, DATE '1995-12-31') GROUP BY ALL""")
def date_windows(l: DataFrame) -> DataFrame:
    last = F.lit("1995-12-31").cast("date")
    first = F.lit("1995-01-01").cast("date")
    s = l.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 45 days"))).alias("start")).withColumn("stop", F.least(F.date_add("start", 44), last))
    # the window follows from the day, so this is an equality join
    day = F.date_add(first, (F.floor(F.datediff("sold_date", first) / 45) * 45).cast("int")).alias("start")
    n = l.where(F.col("sold_date").between(first, last)).groupBy(day).agg(count().alias("n"))
    return s.join(n, "start", "left").select("start", "stop", F.coalesce("n", F.lit(0)).alias("n"))


__all__ = ["LISTINGS_SQL", "listings", "predicted"]
