"""Registered queries on value tiers, sparse areas, composite scores and macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.functions import math as M
from parcelyard.operators import aggregates as A
from parcelyard.operators import temporal as T
from parcelyard.plans.catalog import count, query, r4
from parcelyard.plans.valuation import _PRED_SQL, predicted
from parcelyard.sources.listings import table

_VALUE_SQL = _PRED_SQL + ", d AS (SELECT *, predicted - sold_price AS delta, (predicted - sold_price) * 100 / sold_price AS pct, sold_price >= 3000 AND rooms IS NOT NULL AS rankable FROM v), u AS (SELECT *, rankable AND (pct >= 5 OR delta >= 20000) AS undervalued FROM d)"


def valued(l: DataFrame) -> DataFrame:
    """delta, its per cent, whether a row may be ranked, and whether it is undervalued: by 5 per cent or 20,000."""
    v = predicted(l).withColumn("delta", F.col("predicted") - F.col("sold_price"))
    v = v.withColumn("pct", M.safe_divide(F.col("delta") * 100, F.col("sold_price"))).withColumn("rankable", (F.col("sold_price") >= 3000) & F.col("rooms").isNotNull())
    return v.withColumn("undervalued", F.col("rankable") & ((F.col("pct") >= 5) | (F.col("delta") >= 20_000)))


@query(_VALUE_SQL + " SELECT listing_id, round(delta + 1e-7, 2) AS delta, round(pct + 1e-7, 4) AS pct, undervalued, array_to_string(list_filter([CASE WHEN sold_price < 3000 THEN 'low_price' END, CASE WHEN rooms IS NULL THEN 'rooms' END, CASE WHEN elevator IS NULL THEN 'elevator' END], lambda x: x IS NOT NULL), ',') AS missing FROM u")
def value_delta(l: DataFrame) -> DataFrame:
    missing = F.array_compact(F.array(F.when(F.col("sold_price") < 3000, F.lit("low_price")), F.when(F.col("rooms").isNull(), F.lit("rooms")), F.when(F.col("elevator").isNull(), F.lit("elevator"))))
    return valued(l).select("listing_id", F.round(F.col("delta") + 1e-7, 2).alias("delta"), r4("pct").alias("pct"), "undervalued", F.array_join(missing, ",").alias("missing"))


@query(_VALUE_SQL + " SELECT area, count(*) AS n, count(*) FILTER (undervalued) AS n_undervalued, round(count(*) FILTER (undervalued) / count(*) + 1e-9, 6) AS share FROM u WHERE rankable GROUP BY 1")
def undervalued_share(l: DataFrame) -> DataFrame:
    t = valued(l).where("rankable").groupBy("area").agg(count().alias("n"), F.count(F.when(F.col("undervalued"), 1)).alias("n_undervalued"))
    return t.withColumn("share", F.round(F.col("n_undervalued") / F.col("n") + 1e-9, 6))


@query(_VALUE_SQL + " SELECT count(*) AS n, round(avg(pct) + 1e-7, 4) AS mean, round(median(pct) + 1e-7, 4) AS median, round(min(pct) + 1e-7, 4) AS least, round(max(pct) + 1e-7, 4) AS most, round(stddev_samp(pct) + 1e-7, 4) AS std, count(DISTINCT area) AS n_areas FROM u WHERE rankable")
def value_summary(l: DataFrame) -> DataFrame:
    v = valued(l).where("rankable")
    middle = A.overall_medians(v, ["pct"]).select(r4("pct").alias("median"))
    stats = v.agg(count().alias("n"), r4(F.avg("pct")).alias("mean"), r4(F.min("pct")).alias("least"), r4(F.max("pct")).alias("most"), r4(F.stddev_samp("pct")).alias("std"), F.countDistinct("area").alias("n_areas"))
    return stats.crossJoin(F.broadcast(middle))  # one row


@query(_VALUE_SQL + " SELECT area, count(*) AS n FROM u WHERE rankable GROUP BY 1 ORDER BY n DESC, area LIMIT 10")
def top_areas(l: DataFrame) -> DataFrame:
    return valued(l).where("rankable").groupBy("area").agg(count().alias("n")).orderBy(F.desc("n"), "area").limit(10)


@query("""WITH s AS (SELECT p_type AS area, count(*) AS n FROM part GROUP BY 1), p AS (SELECT s.area, s.n, min(q.area) AS parent FROM s LEFT JOIN (SELECT DISTINCT split_part(p_type, ' ', 1) AS area FROM part) q ON contains(s.area, q.area) AND s.n < 20 GROUP BY ALL)
  SELECT p_partkey, coalesce(parent, p_type) AS area FROM part JOIN p ON p.area = p_type""", on_listings=False)
def consolidate_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Names with few rows go to the first parent, by name, that they contain."""
    part = table(spark, d, "part").select("p_partkey", "p_type")
    counts = part.groupBy("p_type").agg(count().alias("n"))
    parents = part.select(F.split("p_type", " ")[0].alias("parent")).distinct().agg(F.array_sort(F.collect_list("parent")).alias("parents"))  # a dozen major names
    sparse = counts.where("n < 20").crossJoin(F.broadcast(parents)).select("p_type", F.get(F.filter("parents", lambda p: F.contains("p_type", p)), F.lit(0)).alias("parent"))
    return part.join(sparse, "p_type", "left").select("p_partkey", F.coalesce("parent", "p_type").alias("area"))


@query(""", m AS (SELECT median(listing_price / living_area) AS pm, median(living_area) AS am FROM l WHERE living_area > 0), x AS (SELECT listing_id, living_area, listing_price / nullif(living_area, 0) AS pps, CASE WHEN construction_year <= 1929 THEN 7 WHEN construction_year <= 1945 THEN 8 WHEN construction_year <= 1965 THEN 6 WHEN construction_year <= 1975 THEN 4 WHEN construction_year <= 1990 THEN 7 WHEN construction_year <= 2005 THEN 8 WHEN construction_year <= 2015 THEN 9 ELSE 10 END AS q FROM l)
  SELECT listing_id, CAST(q AS INTEGER) AS quality, round(pps / pm * (living_area / am) * (q / 10) + 1e-9, 6) AS luxury_score, round(CASE WHEN living_area IS NULL THEN 0 ELSE greatest(0, least(1, (living_area - 70) / 70)) END + 1e-9, 6) AS size_score FROM x, m""")
def luxury_scores(l: DataFrame) -> DataFrame:
    x = l.select("listing_id", "living_area", M.safe_divide(F.col("listing_price"), F.col("living_area")).alias("pps"), C.quality(C.era(F.col("construction_year"))).alias("quality"))
    m = A.overall_medians(x.select("pps", F.when(F.col("living_area") > 0, F.col("living_area")).alias("am")), ["pps", "am"]).withColumnRenamed("pps", "pm")
    score = M.safe_divide(F.col("pps"), F.col("pm")) * M.safe_divide(F.col("living_area"), F.col("am")) * (F.col("quality") / 10)
    return x.crossJoin(F.broadcast(m)).select("listing_id", "quality", F.round(score + 1e-9, 6).alias("luxury_score"), F.round(F.coalesce(M.clip((F.col("living_area") - 70) / 70, 0.0, 1.0), F.lit(0.0)) + 1e-9, 6).alias("size_score"))


@query(""", r AS (SELECT date_trunc('month', ts)::DATE AS month, avg(value) AS rate, count(*) AS n FROM events GROUP BY 1) SELECT month, round(rate + 1e-9, 6) AS rate, n, round(rate - lag(rate, 3) OVER (ORDER BY month), 6) AS change_3 FROM r""".replace(", r AS", "WITH r AS", 1), on_listings=False)
def month_mean(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").groupBy(F.trunc("ts", "MM").alias("month")).agg(F.avg("value").alias("rate"), count().alias("n"))
    return r.select("month", F.round(F.col("rate") + 1e-9, 6).alias("rate"), "n", F.round(F.col("rate") - F.lag("rate", 3).over(W.orderBy("month")), 6).alias("change_3"))


@query(""", s AS (SELECT date_trunc('month', sold_date)::DATE AS month, median(sold_price) AS idx FROM l GROUP BY 1) SELECT l.listing_id, s.month AS index_month, round(s.idx + 1e-7, 4) AS idx FROM l ASOF LEFT JOIN s ON (date_trunc('month', l.sold_date) - INTERVAL 1 MONTH)::DATE >= s.month""")
def asof_market_month(l: DataFrame) -> DataFrame:
    """The latest month up to the one before the sale's: on a gap-free spine that is an equality join."""
    s = l.groupBy(F.trunc("sold_date", "MM").alias("month")).agg(A.median("sold_price").alias("idx")).withColumn("index_month", F.col("month"))
    spine = T.fill_forward(T.month_spine(l, "sold_date").join(s, "month", "left"), "month", ["idx", "index_month"])
    rows = l.select("listing_id", F.add_months(F.trunc("sold_date", "MM"), -1).alias("month"))
    return rows.join(F.broadcast(spine), "month", "left").select("listing_id", "index_month", r4("idx").alias("idx"))


@query("SELECT CAST(floor(sold_price / 50000) AS INTEGER) AS bucket, count(*) AS n, round(corr(sold_price, living_area) + 1e-9, 5) AS r FROM l GROUP BY 1")
def price_bands(l: DataFrame) -> DataFrame:
    return l.groupBy(F.floor(F.col("sold_price") / 50000).cast("int").alias("bucket")).agg(count().alias("n"), F.round(F.corr("sold_price", "living_area") + 1e-9, 5).alias("r"))
