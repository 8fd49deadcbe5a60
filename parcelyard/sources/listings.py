"""Schemas of listings, and listings made of order tables.

The order tables have no listings, so every query runs on one view of them, a
row for each order; LISTINGS_SQL is the same view in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _l, _d, _b = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
#: The raw listing table, partitioned by scraped_at_date.
RAW_LISTING = T.StructType([
    T.StructField("listing_id", _s, False), T.StructField("url", _s), T.StructField("scraped_at", T.TimestampNTZType(), False), T.StructField("scraped_at_date", T.DateType(), False),
    T.StructField("listing_price", _l), T.StructField("sold_price", _l), T.StructField("address", _s), T.StructField("area", _s), T.StructField("area_original", _s), T.StructField("municipality", _s),
    T.StructField("latitude", _d), T.StructField("longitude", _d), T.StructField("living_area", _d), T.StructField("rooms", _l), T.StructField("property_type", _s), T.StructField("construction_year", _l),
    T.StructField("monthly_fee", _l), T.StructField("price_per_sqm", _l), T.StructField("floor", _l), T.StructField("elevator", _b), T.StructField("balcony", _b), T.StructField("sold_date", T.DateType()),
    T.StructField("days_on_market", _l), T.StructField("price_change", _l), T.StructField("description", _s), T.StructField("images", T.ArrayType(_s)), T.StructField("source_page", _s),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing for each order: price, date, area, size and the rest as deterministic functions of the tables."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("living_area"), F.count(F.lit(1)).cast("double").alias("rooms"), F.round(F.sum("l_extendedprice"), 2).alias("listing_price"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_tax")) + 1e-7, 2).alias("monthly_fee"), F.min("l_shipdate").alias("ship"),
    )
    place = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customer = table(spark, sf_dir, "customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("area"), F.col("r_name").alias("municipality"))
    rows = table(spark, sf_dir, "orders").join(customer, "o_custkey").join(line, "o_orderkey", "left")
    sold, key, cust = F.to_date("o_orderdate"), F.col("o_orderkey"), F.col("o_custkey")
    return rows.select(
        key.cast("string").alias("listing_id"), key.alias("listing_key"), F.col("o_totalprice").alias("sold_price"), sold.alias("sold_date"), F.date_add(sold, 14).alias("scraped_at"), "area", "municipality",
        "living_area", "rooms", "listing_price", "monthly_fee", F.abs(F.datediff(F.to_date("ship"), sold)).cast("long").alias("days_on_market"),
        F.when(F.col("o_orderstatus") == "P", True).when(F.col("o_orderstatus") == "O", False).alias("elevator"),
        F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), True).when(F.col("o_orderpriority").startswith("3"), False).alias("balcony"),
        (1880 + cust % 141).cast("int").alias("construction_year"), (key % 9 - 1).cast("int").alias("floor"),
        F.concat(F.lit("Street"), (cust % 40).cast("string"), F.lit(" "), (cust % 17 + 1).cast("string")).alias("address"),
        (59.25 + (cust % 200) / 1000.0).alias("lat"), (17.95 + (cust % 300) / 1000.0).alias("lon"),
    ).withColumn("ppsqm", F.when(F.col("living_area") > 0, F.col("sold_price") / F.col("living_area")))


LISTINGS_SQL = """l AS (SELECT *, CASE WHEN living_area > 0 THEN sold_price / living_area END AS ppsqm FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS listing_id, o_orderkey AS listing_key, o_totalprice AS sold_price, CAST(o_orderdate AS DATE) AS sold_date, CAST(o_orderdate AS DATE) + 14 AS scraped_at,
    n_name AS area, r_name AS municipality, living_area, rooms, listing_price, monthly_fee, CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(ship AS DATE))) AS BIGINT) AS days_on_market,
    CASE o_orderstatus WHEN 'P' THEN TRUE WHEN 'O' THEN FALSE END AS elevator,
    CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN TRUE WHEN left(o_orderpriority, 1) = '3' THEN FALSE END AS balcony,
    CAST(1880 + o_custkey % 141 AS INTEGER) AS construction_year, CAST(o_orderkey % 9 - 1 AS INTEGER) AS floor,
    'Street' || (o_custkey % 40) || ' ' || (o_custkey % 17 + 1) AS address, 59.25 + (o_custkey % 200) / 1000.0::DOUBLE AS lat, 17.95 + (o_custkey % 300) / 1000.0::DOUBLE AS lon
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS living_area, CAST(count(*) AS DOUBLE) AS rooms, round(sum(l_extendedprice), 2) AS listing_price, round(sum(l_extendedprice * l_tax) + 1e-7, 2) AS monthly_fee, min(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey))"""
