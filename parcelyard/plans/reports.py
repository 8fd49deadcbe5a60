"""Registered queries of reports on areas and values, and of the small relational steps that serve them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.functions import math as M
from parcelyard.functions import strings as S
from parcelyard.operators import aggregates as A
from parcelyard.operators import models as P
from parcelyard.operators import relational as R
from parcelyard.plans.catalog import _ROOM, count, query, r4
from parcelyard.plans.insights import _VALUE_SQL, valued
from parcelyard.plans.valuation import _PRED_SQL, predicted
from parcelyard.sources.listings import LISTINGS_SQL, listings, table

ROOMS = ("1", "2", "3", "4+")
whole = lambda c: F.bround(c, 0).cast("long")


@query(f", x AS (SELECT area, nullif(living_area, 0) AS a, {_ROOM} AS room FROM l) SELECT area, CAST(round_even(median(a), 0) AS BIGINT) AS median_size, CAST(round_even(avg(a), 0) AS BIGINT) AS mean_size, CAST(round_even(min(a), 0) AS BIGINT) AS least_size, CAST(round_even(max(a), 0) AS BIGINT) AS most_size, "
  + ", ".join(f"count(*) FILTER (room = '{r}') AS rooms_{r[0]}" for r in ROOMS) + " FROM x GROUP BY 1")
def size_distribution(l: DataFrame) -> DataFrame:
    a = F.nullif("living_area", F.lit(0.0))
    room = C.room_bucket(F.col("rooms"))
    return l.groupBy("area").agg(whole(A.median(a)).alias("median_size"), whole(F.avg(a)).alias("mean_size"), whole(F.min(a)).alias("least_size"), whole(F.max(a)).alias("most_size"), *[F.count(F.when(room == r, 1)).alias(f"rooms_{r[0]}") for r in ROOMS])


TIERS = ("Excellent", "Great", "Good", "Fair", "Overvalued", "Highly Overvalued")
_TIER = "CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 65 THEN 'Great' WHEN score >= 55 THEN 'Good' WHEN score >= 45 THEN 'Fair' WHEN score >= 30 THEN 'Overvalued' ELSE 'Highly Overvalued' END"
_SCORED_SQL = _VALUE_SQL + f", sc AS (SELECT *, CASE WHEN rankable THEN greatest(1, least(100, 50 + pct)) END AS score FROM u), t AS (SELECT *, CASE WHEN rankable THEN {_TIER} END AS tier FROM sc)"


#: Premiums above this are errors of the source, fixed value.
MOST_PREMIUM = 75.0


def scored(l: DataFrame) -> DataFrame:
    """A score between 1 and 100 straight from the per cent, which SQL can state, and its tier; both null where a row isn't to be ranked."""
    v = valued(l).withColumn("score", F.when(F.col("rankable"), M.clip(50 + F.col("pct"), 1.0, 100.0)))
    return v.withColumn("tier", F.when(F.col("rankable"), C.value_tier(F.col("score"))))


@query(_SCORED_SQL + " SELECT area, count(*) FILTER (rankable) AS n, count(*) FILTER (undervalued) AS n_undervalued, coalesce(round_even(count(*) FILTER (undervalued) * 100.0::DOUBLE / nullif(count(*) FILTER (rankable), 0), 1), 0) AS undervalued_pct, coalesce(round_even(avg(score) FILTER (rankable), 1), 50.0) AS mean_score, coalesce(round_even(median(score) FILTER (rankable), 1), 50.0) AS median_score, CAST(coalesce(round_even(avg(delta) FILTER (rankable), 0), 0) AS BIGINT) AS mean_delta, "
  + ", ".join(f"count(*) FILTER (tier = '{t}') AS {t.lower().replace(' ', '_')}" for t in TIERS) + " FROM t GROUP BY 1")
def value_insights(l: DataFrame) -> DataFrame:
    rankable = F.col("rankable")
    n, low = F.count(F.when(rankable, 1)), F.count(F.when(F.col("undervalued"), 1))
    only = lambda c: F.when(rankable, F.col(c))
    return scored(l).groupBy("area").agg(
        n.alias("n"), low.alias("n_undervalued"), F.coalesce(F.bround(F.try_divide(low * 100.0, n), 1), F.lit(0.0)).alias("undervalued_pct"), F.coalesce(F.bround(F.avg(only("score")), 1), F.lit(50.0)).alias("mean_score"),
        F.coalesce(F.bround(A.median(only("score")), 1), F.lit(50.0)).alias("median_score"), F.coalesce(whole(F.avg(only("delta"))), F.lit(0)).alias("mean_delta"), *[F.count(F.when(F.col("tier") == t, 1)).alias(t.lower().replace(" ", "_")) for t in TIERS],
    )


@query(_SCORED_SQL + " SELECT 'best_value' AS record, arg_max(listing_id, (pct, -listing_key)) FILTER (rankable) AS listing_id FROM t UNION ALL SELECT 'biggest_bid_up', arg_max(listing_id, ((sold_price - listing_price) * 100 / listing_price, -listing_key)) FILTER (listing_price > 0 AND (sold_price - listing_price) * 100 / listing_price <= 75) FROM t")
def value_records(l: DataFrame) -> DataFrame:
    v = scored(l).withColumn("premium", F.when(F.col("listing_price") > 0, (F.col("sold_price") - F.col("listing_price")) * 100 / F.col("listing_price")))
    v = v.withColumn("premium", F.when(F.col("premium") <= MOST_PREMIUM, F.col("premium")))
    top = lambda ok, c: F.max_by("listing_id", F.when(ok, F.struct(F.col(c), -F.col("listing_key"))))
    got = v.agg(top(F.col("rankable"), "pct").alias("best_value"), top(F.col("premium").isNotNull(), "premium").alias("biggest_bid_up"))
    return got.unpivot([], list(got.columns), "record", "listing_id")


OUTPUT = ("listing_id", "address", "area", "municipality", "living_area", "rooms", "sold_price", "predicted", "delta", "pct", "undervalued", "score", "tier", "rankable", "sold_date", "days_on_market", "listing_price")


def value_output(df: DataFrame) -> DataFrame:
    """The report's columns that exist, in its order; NaN as null and numbers to two decimals."""
    kinds = dict(df.dtypes)
    number = lambda c: F.bround(F.when(~F.isnan(c), F.col(c)), 2).alias(c)
    return df.select(*[number(c) if kinds[c] in ("double", "float") else F.col(c) for c in OUTPUT if c in kinds])


_ROUNDED = ("living_area", "rooms", "sold_price", "predicted", "delta", "pct", "score", "listing_price")


@query(_SCORED_SQL + " SELECT " + ", ".join(f"round(round_even({c}, 2) + 1e-7, 0) + 0 AS {c}" if c in _ROUNDED else c for c in OUTPUT) + " FROM t")
def value_output_rows(l: DataFrame) -> DataFrame:
    """(To whole numbers after the report's two: binary halves at the third fall either way between engines.)"""
    out = value_output(scored(l))
    return out.select(*[(F.round(F.col(c) + 1e-7, 0) + 0).alias(c) if c in _ROUNDED else c for c in out.columns])


@query(_PRED_SQL + ", b AS (SELECT area, round_even(avg(predicted - sold_price), 0) AS mean_error, count(sold_price) AS n FROM v GROUP BY 1 HAVING count(sold_price) >= 10) SELECT area, mean_error, n, CASE WHEN mean_error > 5000 THEN 'over' WHEN mean_error < -5000 THEN 'under' ELSE 'neither' END AS side FROM b")
def bias_by_area(l: DataFrame) -> DataFrame:
    """Mean error of areas with at least 10 sales; beyond a threshold the model is said to over- or underpredict."""
    b = predicted(l).groupBy("area").agg(F.bround(F.avg(F.col("predicted") - F.col("sold_price")), 0).alias("mean_error"), F.count("sold_price").alias("n")).where("n >= 10")
    e = F.col("mean_error")
    return b.withColumn("side", F.when(e > 5000, "over").when(e < -5000, "under").otherwise("neither"))


@query(", a AS (SELECT area, count(*) AS n, round(median(ppsqm) + 1e-7, 4) AS median_ppsqm FROM l GROUP BY 1) SELECT area, n, median_ppsqm, CAST(row_number() OVER (ORDER BY median_ppsqm DESC) AS INTEGER) AS rank FROM a WHERE n >= 60 OR NOT EXISTS (FROM a WHERE n >= 60)")
def ranked_areas(l: DataFrame) -> DataFrame:
    a = l.groupBy("area").agg(count().alias("n"), r4(A.median("ppsqm")).alias("median_ppsqm"))
    return R.ranked_if_enough(a, "n", 60, F.desc("median_ppsqm"))


@query("SELECT listing_id, area FROM l ORDER BY md5(listing_id || '|42'), listing_id LIMIT 2000")
def sample_2000(l: DataFrame) -> DataFrame:
    return R.sample_rows(l.select("listing_id", "area"), "listing_id", 2000)


@query("SELECT DISTINCT area FROM (SELECT area FROM l WHERE elevator UNION ALL SELECT area FROM l WHERE balcony)")
def union_distinct_keys(l: DataFrame) -> DataFrame:
    return l.where("elevator").select("area").union(l.where("balcony").select("area")).distinct()


@query(", a AS (SELECT listing_id FROM l WHERE listing_key % 3 > 0), b AS (SELECT listing_id FROM l WHERE listing_key % 4 > 0) SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, count(*) FILTER (b.listing_id IS NULL) AS only_a, count(*) FILTER (a.listing_id IS NULL) AS only_b, count(*) FILTER (a.listing_id IS NULL OR b.listing_id IS NULL) = 0 AS same FROM a FULL JOIN b USING (listing_id)")
def sync_comparison(l: DataFrame) -> DataFrame:
    return R.equal_summary(l.where("listing_key % 3 > 0").select("listing_id"), l.where("listing_key % 4 > 0").select("listing_id"), ["listing_id"])


@query(", t AS (SELECT listing_id FROM l WHERE listing_key % 3 = 0), s AS (SELECT listing_id FROM l WHERE listing_key % 2 = 0 UNION ALL SELECT listing_id FROM l WHERE listing_key % 10 = 0) SELECT (SELECT count(*) FROM s WHERE listing_id NOT IN (FROM t)) AS inserted, (SELECT count(*) FROM t WHERE listing_id IN (FROM s)) AS updated, (SELECT count(*) FROM t WHERE listing_id NOT IN (FROM s)) AS kept, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM s GROUP BY listing_id HAVING count(*) > 1)) AS repeated")
def upsert_report(l: DataFrame) -> DataFrame:
    s = l.where("listing_key % 2 = 0").select("listing_id").unionAll(l.where("listing_key % 10 = 0").select("listing_id"))
    return R.upsert_counts(l.where("listing_key % 3 = 0").select("listing_id"), s, "listing_id")


@query(", q AS (SELECT DISTINCT 'Q' || quarter(sold_date) || ' ' || year(sold_date) AS label FROM l) SELECT label, CAST(row_number() OVER (ORDER BY CAST(substr(label, 4) AS INTEGER), CAST(substr(label, 2, 1) AS INTEGER)) AS INTEGER) AS place FROM q")
def quarters_in_order(l: DataFrame) -> DataFrame:
    """Labels like `Q3 1995` in order of year, then quarter: a row a quarter, so one window is small."""
    q = l.select(F.concat(F.lit("Q"), F.quarter("sold_date"), F.lit(" "), F.year("sold_date")).alias("label")).distinct()
    order = W.orderBy(F.substring("label", 4, 4).cast("int"), F.substring("label", 2, 1).cast("int"))
    return q.select("label", F.row_number().over(order).alias("place"))


@query(", r AS (SELECT coalesce(max(sold_date), max(scraped_at)) AS ref FROM l) SELECT listing_id, (scraped_at - CAST(days_on_market AS INTEGER))::DATE AS listed, CAST(date_diff('day', sold_date, ref) AS INTEGER) AS days_since_sold, CAST(date_diff('day', (scraped_at - CAST(days_on_market AS INTEGER))::DATE, ref) AS INTEGER) AS days_since_listed FROM l, r")
def listing_dates(l: DataFrame) -> DataFrame:
    """When a listing appeared, and days up to the reference date: the last sale, else the last scrape, else today."""
    ref = l.agg(F.coalesce(F.max("sold_date"), F.max("scraped_at"), F.current_date()).alias("ref"))
    rows = l.select("listing_id", "sold_date", F.date_sub("scraped_at", F.col("days_on_market").cast("int")).alias("listed")).crossJoin(F.broadcast(ref))
    return rows.select("listing_id", "listed", F.datediff("ref", "sold_date").alias("days_since_sold"), F.datediff("ref", "listed").alias("days_since_listed"))


@query("SELECT column_name, round(1 / (1 - pow(r, 2)), 5) AS vif FROM (SELECT corr(living_area, rooms) AS r FROM l WHERE living_area IS NOT NULL AND rooms IS NOT NULL), (VALUES ('living_area'), ('rooms')) c(column_name)")
def inflation_factors(l: DataFrame) -> DataFrame:
    return P.variance_inflation(l, ["living_area", "rooms"]).withColumn("vif", F.round("vif", 5))


@query(f"WITH {LISTINGS_SQL}" + " SELECT listing_id, coalesce(o.c_name, 'unknown') AS name, round(coalesce(own, geo) + 1e-9, 6) AS lat FROM (SELECT listing_id, CASE WHEN listing_key % 4 = 0 THEN lat END AS own, address || ', ' || replace(lower(area), ' ', '_') AS k, listing_key FROM l) x LEFT JOIN (SELECT address || ', ' || replace(lower(area), ' ', '_') AS k, min(lat) AS geo FROM l WHERE listing_key % 3 = 0 GROUP BY 1) g USING (k) LEFT JOIN (SELECT c_custkey, c_name FROM customer) o ON o.c_custkey = x.listing_key", on_listings=False)
def coordinates_own_first(spark: SparkSession, d: str) -> DataFrame:
    """A listing's own coordinates, else those of its geocode key; and a point lookup with a default."""
    l = listings(spark, d)
    key = S.geocode_key(F.col("address"), F.col("area")).alias("k")
    places = l.where("listing_key % 3 = 0").groupBy(key).agg(F.min("lat").alias("geo"))
    rows = l.select("listing_id", "listing_key", key, F.when(F.col("listing_key") % 4 == 0, F.col("lat")).alias("own")).join(places, "k", "left")
    rows = rows.join(table(spark, d, "customer").select(F.col("c_custkey").alias("listing_key"), "c_name"), "listing_key", "left")
    return rows.select("listing_id", F.coalesce("c_name", F.lit("unknown")).alias("name"), F.round(F.coalesce("own", "geo") + 1e-9, 6).alias("lat"))
