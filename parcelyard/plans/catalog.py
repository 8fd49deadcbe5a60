"""Registered queries over listings, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.functions import dates as D
from parcelyard.functions import math as M
from parcelyard.functions import strings as S
from parcelyard.operators import aggregates as A
from parcelyard.operators import geo as G
from parcelyard.operators import models as P
from parcelyard.operators import relational as R
from parcelyard.operators import temporal as T
from parcelyard.operators.fallback import tiered
from parcelyard.operators.search import Query, facets, similar
from parcelyard.sources.listings import LISTINGS_SQL, listings, table
from parcelyard.tables import met, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Thresholds of the data's price scale, in which a thousand stands for a million.
LEAST_PRICE, MILLION = 3000.0, 50_000.0


def query(sql: str | None = None, on_listings: bool = True):
    """Register a query of (listings) or of (spark, sf_dir); sql starts after the listings' CTE."""

    def add(f):
        run = (lambda spark, sf_dir: f(listings(spark, sf_dir))) if on_listings else f
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {LISTINGS_SQL}{sql}" if sql.startswith(",") else f"WITH {LISTINGS_SQL}\n{sql}" if on_listings else sql
        return f

    return add


r4 = lambda c: F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, 4)
#: Quantiles may differ in their last bits between engines; the shift keeps values that end in 5 from rounding apart.
up4 = lambda c: F.round(F.col(c) + 1e-7, 4).alias(c)
count = lambda: F.count(F.lit(1))

# ---- strict-prior windows -------------------------------------------------------------------------------------------------


@query("""SELECT listing_id, area, sold_date, round(quantile_cont(ppsqm, 0.5) OVER w + 1e-7, 4) AS p50, round(quantile_cont(ppsqm, 0.75) OVER w + 1e-7, 4) AS p75, round(quantile_cont(ppsqm, 0.9) OVER w + 1e-7, 4) AS p90,
  CASE WHEN count(*) OVER w > 0 THEN count(ppsqm) OVER w END AS n FROM l WINDOW w AS (PARTITION BY area ORDER BY sold_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def prior_area_quad(l: DataFrame) -> DataFrame:
    l = written(l.select("listing_id", "area", "sold_date", "ppsqm"), "listings")
    stats = T.prior_quantiles(l, "area", "sold_date", "ppsqm")
    return met(l, stats, ["area", "sold_date"]).select("listing_id", "area", "sold_date", up4("p50"), up4("p75"), up4("p90"), F.col("n").cast("long").alias("n"))


@query("""SELECT listing_id, round(quantile_cont(ppsqm, 0.5) OVER w + 1e-7, 4) AS p50, CASE WHEN count(*) OVER w > 0 THEN count(ppsqm) OVER w END AS n
  FROM l WINDOW w AS (PARTITION BY area, address ORDER BY sold_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def prior_address_native(l: DataFrame) -> DataFrame:
    l = written(l.select("listing_id", "area", "address", "sold_date", "ppsqm"), "listings")
    t = T.prior_quantiles(l, ["area", "address"], "sold_date", "ppsqm")
    return met(l.drop("ppsqm"), t, ["area", "address", "sold_date"]).select("listing_id", up4("p50"), "n")


_WINDOWS = (30, 90, 180, 365)


@query("SELECT listing_id, " + ", ".join(f"round(median(sold_price) OVER w{n}, 4) AS median_{n}, CASE WHEN count(*) OVER w{n} > 0 THEN count(sold_price) OVER w{n} END AS count_{n}" for n in _WINDOWS)
  + " FROM l WINDOW " + ", ".join(f"w{n} AS (PARTITION BY area ORDER BY sold_date RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)" for n in _WINDOWS))
def trailing_30_90_180_365(l: DataFrame) -> DataFrame:
    t = T.trailing(written(l.select("listing_id", "area", "sold_date", "sold_price"), "listings"), "area", "sold_date", "sold_price", _WINDOWS)
    return t.select("listing_id", *[c for n in _WINDOWS for c in (r4(f"median_{n}").alias(f"median_{n}"), F.col(f"count_{n}"))])


@query("""SELECT listing_id, count(listing_price) OVER w AS inventory, round(median(listing_price) OVER w + 1e-7, 4) AS price_median, round(stddev_samp(listing_price) OVER w + 1e-5, 2) AS price_volatility, round(median(days_on_market) OVER w + 1e-7, 4) AS dom_median,
  round(avg(sold_price - listing_price) OVER w + 1e-5, 2) AS price_change_mean, count(sold_price - listing_price) OVER w AS price_change_count FROM l WINDOW w AS (PARTITION BY area ORDER BY sold_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def area_market_prior(l: DataFrame) -> DataFrame:
    rows = l.select("listing_id", "area", "sold_date", "listing_price", "days_on_market", (F.col("sold_price") - F.col("listing_price")).alias("change"))
    t = T.prior_market(written(rows, "listings"), "area", "sold_date", "listing_price", "days_on_market", "change")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    cents = lambda c: F.round(F.col(c) + 1e-5, 2).alias(c)
    return t.select("listing_id", zero("inventory"), up4("price_median"), cents("price_volatility"), up4("dom_median"), cents("price_change_mean"), zero("price_change_count"))


@query("""SELECT listing_id, round((coalesce(sum(sold_price) OVER w, 0) + 10 * (SELECT avg(sold_price) FROM l)) / (count(sold_price) OVER w + 10), 3) AS encoded
  FROM l WINDOW w AS (PARTITION BY area ORDER BY sold_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def target_mean_smoothed(l: DataFrame) -> DataFrame:
    return T.target_mean(l.select("listing_id", "area", "sold_date", "sold_price"), "area", "sold_date", "sold_price").select("listing_id", F.round("encoded", 3).alias("encoded"))


@query("""SELECT listing_id, count(*) OVER a - 1 AS area_rows, round(stddev_samp(sold_price) OVER a, 3) AS area_std, round(avg(sold_price) OVER a, 3) AS area_mean, round(median(sold_price) OVER a + 1e-7, 4) AS area_median FROM l WINDOW a AS (PARTITION BY area)""")
def group_transform(l: DataFrame) -> DataFrame:
    t = l.groupBy("area").agg((count() - 1).alias("area_rows"), F.round(F.stddev_samp("sold_price"), 3).alias("area_std"), F.round(F.avg("sold_price"), 3).alias("area_mean"), r4(A.median("sold_price")).alias("area_median"))
    return l.select("listing_id", "area").join(F.broadcast(t), "area").drop("area")


_BAND = "CASE WHEN living_area <= 0 OR living_area IS NULL THEN 'unknown' WHEN living_area <= 35 THEN '0_35' WHEN living_area <= 50 THEN '35_50' WHEN living_area <= 70 THEN '50_70' WHEN living_area <= 90 THEN '70_90' WHEN living_area <= 120 THEN '90_120' ELSE '120_plus' END"


_ALL_BEFORE = "ORDER BY sold_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"


@query(f""", b AS (SELECT *, {_BAND} AS band FROM l),
  x AS (SELECT listing_id, band, median(ppsqm) OVER s AS sm, count(ppsqm) OVER s AS sn, median(ppsqm) OVER a AS am, count(ppsqm) OVER a AS an, median(ppsqm) OVER g AS gm, count(ppsqm) OVER g AS gn FROM b
  WINDOW s AS (PARTITION BY address, band {_ALL_BEFORE}), a AS (PARTITION BY area, band {_ALL_BEFORE}), g AS (PARTITION BY band {_ALL_BEFORE}))
  SELECT listing_id, band, round(CASE WHEN sn >= 3 THEN sm WHEN an >= 5 THEN am WHEN gn >= 1 THEN gm END + 1e-7, 4) AS p50, CASE WHEN sn >= 3 THEN sn WHEN an >= 5 THEN an WHEN gn >= 1 THEN gn END AS n, CASE WHEN sn >= 3 THEN 'address_size' WHEN an >= 5 THEN 'area_size' WHEN gn >= 1 THEN 'size' END AS scope FROM x""")
def prior_area_size_fallback(l: DataFrame) -> DataFrame:
    facts = b = written(l.select("listing_id", "address", "area", "sold_date", "ppsqm", C.size_band(F.col("living_area")).alias("band")), "listings")
    levels = []
    for name, keys, least in (("address_size", ["address", "band"], 3), ("area_size", ["area", "band"], 5), ("size", ["band"], 1)):
        t = T.prior_quantiles(facts.select(*keys, "sold_date", "ppsqm"), keys, "sold_date", "ppsqm")
        b = met(b, t.select(*keys, "sold_date", F.struct("p50").alias(f"_{name}"), F.col("n").alias(f"_{name}_n")), [*keys, "sold_date"])
        levels.append((name, F.col(f"_{name}"), F.col(f"_{name}_n"), least))
    got = tiered(levels, ["p50"])
    return b.select("listing_id", "band", F.round(got["p50"] + 1e-7, 4).alias("p50"), got["count"].alias("n"), got["scope"].alias("scope"))


@query("""SELECT e.event_id, p.event_id AS previous_id, p.value AS previous_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts > p.ts""", on_listings=False)
def asof_event_previous(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    right = e.groupBy("user_id", "ts").agg(F.max("event_id").alias("previous_id"), F.max_by("value", "event_id").alias("previous_value"))
    return T.asof(e.select("user_id", "ts", "event_id"), right, ["user_id"], "ts", "ts", ["previous_id", "previous_value"]).select("event_id", "previous_id", "previous_value")


@query(""", m AS (SELECT unnest(generate_series(date_trunc('month', min(sold_date))::TIMESTAMP, date_trunc('month', max(sold_date))::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM l), k AS (SELECT DISTINCT area FROM l),
  s AS (SELECT area, date_trunc('month', sold_date)::DATE AS month, median(sold_price) AS p FROM l WHERE month(sold_date) % 3 <> 0 GROUP BY 1, 2),
  f AS (SELECT k.area, m.month, last_value(s.p IGNORE NULLS) OVER (PARTITION BY k.area ORDER BY m.month ROWS UNBOUNDED PRECEDING) AS price FROM m CROSS JOIN k LEFT JOIN s ON s.month = m.month AND s.area = k.area)
  SELECT area, month, price, price - lag(price, 3) OVER w AS change_3, round(price / lag(price, 3) OVER w - 1, 6) AS ratio_3 FROM f WINDOW w AS (PARTITION BY area ORDER BY month)""")
def month_spine_ffill_lag3(l: DataFrame) -> DataFrame:
    """A row a month and area, so a key's window has a row a month."""
    s = l.where(F.month("sold_date") % 3 != 0).groupBy("area", F.trunc("sold_date", "MM").alias("month")).agg(A.median("sold_price").alias("price"))
    spine = l.select("area").distinct().crossJoin(F.broadcast(T.month_spine(l, "sold_date")))
    f = T.fill_forward(spine.join(s, ["area", "month"], "left"), "month", ["price"], ["area"])
    before = F.lag("price", 3).over(W.partitionBy("area").orderBy("month"))
    return f.select("area", "month", "price", (F.col("price") - before).alias("change_3"), F.round(F.col("price") / before - 1, 6).alias("ratio_3"))


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) IS NOT NULL AS has_f, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS O, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS P FROM orders GROUP BY 1""", on_listings=False)
def pivot_indicator(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("month"), "o_orderstatus", "o_totalprice")
    p = o.groupBy("month").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    return p.select("month", F.col("F").isNotNull().alias("has_f"), "F", "O", "P")


@query(""", x AS (SELECT listing_id, sold_date, row_number() OVER (ORDER BY sold_date) AS r, count(*) OVER () AS n FROM l), e AS (SELECT min(sold_date) AS edge FROM x WHERE r = floor(n * 0.8) + 1)
  SELECT listing_id, sold_date < edge AS is_train FROM x, e""")
def temporal_split(l: DataFrame) -> DataFrame:
    return T.temporal_split(l.select("listing_id", "sold_date"), "sold_date").select("listing_id", "is_train")


@query("""SELECT listing_id, CAST(greatest(0, 3 - floor((n - r) / (n // 4))) AS INTEGER) AS fold FROM (SELECT listing_id, row_number() OVER (ORDER BY sold_date, listing_key) AS r, count(*) OVER () AS n FROM l)""")
def time_series_folds(l: DataFrame) -> DataFrame:
    return T.folds(written(l.select("listing_id", "listing_key", "sold_date"), "listings"), "sold_date", "listing_key", 3).select("listing_id", "fold")


def hex_sql(source: str, out: str, edge: float, q: str = "q", r: str = "r") -> str:
    """CTEs up to `out`: source with the axial coordinates of the hexagon of each place, as `geo.hex_cell` has them."""
    a, b, c = (f"CAST('{x!r}' AS DOUBLE)" for x in G.hex_factors(edge))
    return _rounded_sql(f"(SELECT *, lon * {a} - lat * {b} AS qf, lat * {c} AS rf FROM {source})", out, q, r)


def hex_parent_sql(source: str, out: str, q: str, r: str, to_q: str, to_r: str) -> str:
    return _rounded_sql(f"(SELECT *, (3 * {q} + {r}) / 7 AS qf, (2 * {r} - {q}) / 7 AS rf FROM {source})", out, to_q, to_r)


def _rounded_sql(source: str, out: str, q: str, r: str) -> str:
    near = f"(SELECT *, floor(qf + 0.5) AS rq, floor(rf + 0.5) AS rr, floor(-qf - rf + 0.5) AS rs FROM {source})"
    moved = f"(SELECT *, abs(rq - qf) AS dq, abs(rr - rf) AS dr, abs(rs + qf + rf) AS ds FROM {near})"
    by_q = "dq > dr AND dq > ds"
    return f"{out} AS (SELECT * EXCLUDE (qf, rf, rq, rr, rs, dq, dr, ds), CASE WHEN {by_q} THEN -rr - rs ELSE rq END AS {q}, CASE WHEN NOT ({by_q}) AND dr > ds THEN -rq - rs ELSE rr END AS {r} FROM {moved})"


AROUND_SQL = "o AS (SELECT * FROM (VALUES " + ", ".join(map(str, G.AROUND)) + ") x(dq, dr))"
#: Edges in metres of the cells whose neighbours are looked at.
NEIGHBOR_EDGE = 800.0


@query(f""", {hex_sql("l", "c", NEIGHBOR_EDGE)}, {AROUND_SQL},
  k AS (SELECT c.listing_key, n.q, n.r, median(n.ppsqm) AS p, count(n.ppsqm) AS n FROM c, o, c n WHERE n.q = c.q + dq AND n.r = c.r + dr AND n.sold_date < c.sold_date GROUP BY ALL HAVING count(n.ppsqm) > 0)
  SELECT l.listing_id, round(sum(p * n) / sum(n), 3) AS neighbor_p50, CAST(coalesce(sum(n), 0) AS BIGINT) AS neighbor_n FROM l LEFT JOIN k USING (listing_key) GROUP BY 1""")
def neighbor_cells(l: DataFrame) -> DataFrame:
    return G.neighbor_stats(l.select("listing_key", "listing_id", "lat", "lon", "sold_date", "ppsqm"), "sold_date", "ppsqm", NEIGHBOR_EDGE).select("listing_id", F.round("neighbor_p50", 3).alias("neighbor_p50"), "neighbor_n")


@query(f""", {hex_sql("l", "c", NEIGHBOR_EDGE)}, {hex_parent_sql("c", "p", "q", "r", "pq", "pr")}
  SELECT CAST(pq AS BIGINT) AS q, CAST(pr AS BIGINT) AS r, count(DISTINCT (q, r)) AS cells, count(*) AS n, round(median(ppsqm) + 1e-7, 4) AS p50 FROM p GROUP BY 1, 2""".replace("count(DISTINCT (q, r))", "count(DISTINCT (p.q, p.r))"))
def cell_parents(l: DataFrame) -> DataFrame:
    """Sales by the parents of their cells."""
    rows = l.withColumn("cell", G.hex_cell(F.col("lat"), F.col("lon"), NEIGHBOR_EDGE)).withColumn("parent", G.hex_parent(F.col("cell")))
    t = rows.groupBy("parent").agg(F.countDistinct("cell").alias("cells"), count().alias("n"), r4(A.median("ppsqm")).alias("p50"))
    _, q, r = G.hex_parts(F.col("parent"))
    return t.select(q.alias("q"), r.alias("r"), "cells", "n", "p50")


# ---- filters, deduplication, upserts, sets ----------------------------------------------------------------------------------


@query("SELECT listing_id, sold_price, listing_price FROM l WHERE sold_price >= 3000 AND listing_price >= 3000 AND living_area IS NOT NULL AND rooms IS NOT NULL")
def valid_listings(l: DataFrame) -> DataFrame:
    return R.valid_listings(l, LEAST_PRICE, True, ["living_area", "rooms"]).select("listing_id", "sold_price", "listing_price")


@query("SELECT listing_id FROM l WHERE area IN ('NATION_3', 'NATION_7') AND rooms >= 2 AND floor <> 0 AND elevator IS NOT NULL AND municipality NOT IN ('ASIA') AND living_area < 120")
def structured_filter(l: DataFrame) -> DataFrame:
    f = [R.Filter("area", "IN", ["NATION_3", "NATION_7"]), R.Filter("rooms", ">=", 2), R.Filter("floor", "!=", 0), R.Filter("elevator", "IS NOT NULL"), R.Filter("municipality", "NOT IN", ["ASIA"]), R.Filter("living_area", "<", 120)]
    return R.where_all(l, f).select("listing_id")


@query(""", q AS (SELECT quantile_cont(sold_price, 0.01) a, quantile_cont(sold_price, 0.99) b, quantile_cont(living_area, 0.01) c, quantile_cont(living_area, 0.99) d FROM l) SELECT listing_id FROM l, q WHERE sold_price BETWEEN a AND b AND (living_area IS NULL OR living_area BETWEEN c AND d)""")
def outlier_quantile(l: DataFrame) -> DataFrame:
    return R.within_quantiles(l, ["sold_price", "living_area"]).select("listing_id")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS FIRST, event_id DESC) = 1", on_listings=False)
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts").desc_nulls_first(), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query(""", o AS (SELECT listing_id, CASE WHEN listing_key % 3 > 0 THEN sold_price END AS p, CASE WHEN listing_key % 11 > 0 THEN scraped_at END AS t, 1 AS old FROM l), n AS (SELECT listing_id, CASE WHEN listing_key % 2 > 0 THEN sold_price + 1 END AS p, CASE WHEN listing_key % 7 > 0 THEN scraped_at + CAST(listing_key % 5 - 2 AS INTEGER) END AS t, 0 AS old FROM l WHERE listing_key % 4 < 3),
  x AS (SELECT o.listing_id, CASE WHEN n.listing_id IS NULL OR (o.p IS NOT NULL AND n.p IS NULL) THEN TRUE WHEN n.p IS NOT NULL AND o.p IS NULL THEN FALSE WHEN o.t IS NULL OR n.t IS NULL THEN TRUE ELSE o.t >= n.t END AS was_old, o.p AS op, n.p AS np FROM o LEFT JOIN n USING (listing_id))
  SELECT listing_id, CASE WHEN was_old THEN op ELSE np END AS price, was_old FROM x""")
def merge_newer(l: DataFrame) -> DataFrame:
    key = F.col("listing_key")
    old = l.select("listing_id", F.when(key % 3 > 0, F.col("sold_price")).alias("price"), F.when(key % 11 > 0, F.col("scraped_at")).alias("t"), F.lit(True).alias("was_old"))
    new = l.where(key % 4 < 3).select("listing_id", F.when(key % 2 > 0, F.col("sold_price") + 1).alias("price"), F.when(key % 7 > 0, F.date_add("scraped_at", (key % 5 - 2).cast("int"))).alias("t"), F.lit(False).alias("was_old"))
    return R.merge_newer(old, new, "listing_id", "price", "t").select("listing_id", "price", "was_old")


@query(""", t AS (SELECT listing_id, sold_price AS price FROM l WHERE listing_key % 3 = 0), s AS (SELECT listing_id, sold_price * 2 AS price FROM l WHERE listing_key % 2 = 0)
  SELECT 'merge' AS kind, coalesce(s.listing_id, t.listing_id) AS listing_id, coalesce(s.price, t.price) AS price FROM t FULL JOIN s USING (listing_id) UNION ALL SELECT 'insert', coalesce(t.listing_id, s.listing_id), coalesce(t.price, s.price) FROM t FULL JOIN s USING (listing_id)""")
def upsert_rewrite(l: DataFrame) -> DataFrame:
    t = l.where("listing_key % 3 = 0").select("listing_id", F.col("sold_price").alias("price"))
    s = l.where("listing_key % 2 = 0").select("listing_id", (F.col("sold_price") * 2).alias("price"))
    return R.upsert(t, s, "listing_id").select(F.lit("merge").alias("kind"), "*").unionByName(R.upsert(t, s, "listing_id", True).select(F.lit("insert").alias("kind"), "*"))


@query("SELECT DISTINCT address, area FROM l WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.address = l.address AND k.area = l.area AND k.listing_key % 5 = 0)")
def anti_missing_keys(l: DataFrame) -> DataFrame:
    known = l.where("listing_key % 5 = 0").select("address", "area")
    return l.select("address", "area").distinct().join(known, ["address", "area"], "left_anti")


@query("SELECT count(*) AS n_rows, count(DISTINCT listing_id) AS n_keys, CAST(sum(CAST('0x' || substr(sha256(listing_id), 1, 15) AS HUGEINT)) AS VARCHAR) AS digest, max(scraped_at) AS last_at FROM l")
def checksum(l: DataFrame) -> DataFrame:
    return R.checksum(l, "listing_id", "scraped_at")


@query("""SELECT 'append' AS kind, listing_id FROM l WHERE listing_key % 3 = 0 OR listing_key % 2 = 0 UNION ALL SELECT 'replace', listing_id FROM l WHERE listing_key % 3 = 0 OR listing_key % 2 = 0 UNION ALL
  SELECT 'intersect', listing_id FROM l WHERE listing_key % 3 = 0 AND listing_key % 2 = 0 UNION ALL SELECT 'except', listing_id FROM l WHERE listing_key % 3 = 0 AND listing_key % 2 <> 0""")
def set_ops_append_replace(l: DataFrame) -> DataFrame:
    a, b = l.where("listing_key % 3 = 0").select("listing_id"), l.where("listing_key % 2 = 0").select("listing_id")
    parts = {"append": R.append_unseen(a, b, ["listing_id"]), "replace": R.replace_overlap(a, b, ["listing_id"]), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    out = None
    for kind, df in parts.items():
        df = df.select(F.lit(kind).alias("kind"), "listing_id")
        out = df if out is None else out.unionByName(df)
    return out


@query("""SELECT count(*) AS total, count(*) FILTER (living_area IS NOT NULL AND elevator IS NOT NULL AND trim(address) <> '') AS valid, round(count(*) FILTER (living_area IS NOT NULL AND elevator IS NOT NULL AND trim(address) <> '') / count(*), 6) AS rate,
  array_to_string(list_filter([CASE WHEN bool_or(address IS NULL OR trim(address) = '') THEN 'address' END, CASE WHEN bool_or(elevator IS NULL) THEN 'elevator' END, CASE WHEN bool_or(living_area IS NULL) THEN 'living_area' END], lambda x: x IS NOT NULL), ',') AS missing FROM l""")
def required_fields(l: DataFrame) -> DataFrame:
    return R.required(l, ["living_area", "elevator", "address"]).withColumn("rate", F.round("rate", 6))


@query("SELECT area, municipality, count(*) AS n FROM l WHERE area IN (SELECT area FROM l GROUP BY 1 HAVING count(*) >= 30) GROUP BY 1, 2")
def semi_published(l: DataFrame) -> DataFrame:
    published = l.groupBy("area").count().where("count >= 30").select("area")
    return l.join(F.broadcast(published), "area", "left_semi").groupBy("area", "municipality").agg(count().alias("n"))


@query("""SELECT r_name AS municipality, n_name AS area, coalesce(n, 0) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON c_nationkey = n_nationkey""", on_listings=False)
def union_keys_left(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(count().alias("n"))
    return n.join(c, "n_nationkey", "left").select(F.col("r_name").alias("municipality"), F.col("n_name").alias("area"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- grouped statistics -----------------------------------------------------------------------------------------------------


@query("SELECT area, round(quantile_cont(ppsqm, 0.5) + 1e-7, 4) AS p50, round(quantile_cont(ppsqm, 0.75) + 1e-7, 4) AS p75, round(quantile_cont(ppsqm, 0.9) + 1e-7, 4) AS p90, count(ppsqm) AS n FROM l GROUP BY area")
def quad_by_area(l: DataFrame) -> DataFrame:
    return A.quad(l, ["area"], "ppsqm").select("area", *[r4(c).alias(c) for c in ("p50", "p75", "p90")], "n")


@query(f"SELECT area || '|' || {_BAND} AS size_key, round(quantile_cont(ppsqm, 0.5) + 1e-7, 4) AS p50, round(quantile_cont(ppsqm, 0.75) + 1e-7, 4) AS p75, round(quantile_cont(ppsqm, 0.9) + 1e-7, 4) AS p90, count(ppsqm) AS n FROM l GROUP BY 1")
def quad_by_composite(l: DataFrame) -> DataFrame:
    k = l.withColumn("size_key", F.concat_ws("|", F.coalesce("area", F.lit("unknown")), C.size_band(F.col("living_area"))))
    return A.quad(k, ["size_key"], "ppsqm").select("size_key", *[r4(c).alias(c) for c in ("p50", "p75", "p90")], "n")


@query("SELECT area, avg(listing_price) IS NOT NULL AS known, round(avg(listing_price), 3) AS mean_listing, count(*) AS size, round(avg(sold_price), 3) AS mean_sold, arg_max(ppsqm, (sold_date, listing_key)) FILTER (ppsqm IS NOT NULL) AS latest_ppsqm, round(median(sold_price) + 1e-7, 4) AS median_sold FROM l GROUP BY area")
def area_means_latest(l: DataFrame) -> DataFrame:
    latest = F.max_by("ppsqm", F.when(F.col("ppsqm").isNotNull(), F.struct("sold_date", "listing_key")))
    return l.groupBy("area").agg(F.avg("listing_price").isNotNull().alias("known"), F.round(F.avg("listing_price"), 3).alias("mean_listing"), count().alias("size"), F.round(F.avg("sold_price"), 3).alias("mean_sold"), latest.alias("latest_ppsqm"), r4(A.median("sold_price")).alias("median_sold"))


@query("""SELECT round(median(living_area) + 1e-7, 4) AS living_area, round(median(rooms) + 1e-7, 4) AS rooms, round(median(listing_price) + 1e-7, 4) AS listing_price, (SELECT area FROM l GROUP BY area ORDER BY count(*) DESC, area LIMIT 1) AS area FROM l""")
def fill_values(l: DataFrame) -> DataFrame:
    columns = ("living_area", "rooms", "listing_price")
    medians = A.overall_medians(l, columns)
    return medians.crossJoin(F.broadcast(l.agg(F.mode("area", True).alias("area")))).select(*[r4(c).alias(c) for c in columns], "area")


def _hist_sql(value: str, bins: int) -> str:
    return f""", q AS (SELECT quantile_cont({value}, 0.01) AS lo, quantile_cont({value}, 0.99) AS hi FROM l), h AS (SELECT least(CAST(floor(({value} - lo) / ((hi - lo) / {bins})) AS INTEGER), {bins - 1}) AS bin, count(*) AS n FROM l, q WHERE {value} BETWEEN lo AND hi GROUP BY 1)
  SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / {bins} + 1e-7, 4) AS edge, coalesce(n, 0) AS n FROM range({bins}) r(i), q LEFT JOIN h ON bin = i"""


@query(_hist_sql("sold_price", 60))
def hist_clipped_price(l: DataFrame) -> DataFrame:
    return A.histogram(l, "sold_price", 60).withColumn("edge", r4("edge"))


@query(_hist_sql("ppsqm", 50))
def hist_clipped_ppsqm(l: DataFrame) -> DataFrame:
    return A.histogram(l, "ppsqm", 50).withColumn("edge", r4("edge"))


@query(", m AS (SELECT strftime(sold_date, '%Y-%m') AS month, round(median(ppsqm) + 1e-7, 4) AS median_ppsqm, round(median(sold_price) + 1e-7, 4) AS median_price, count(*) AS n FROM l GROUP BY 1) SELECT *, month = max(month) OVER () AS is_partial FROM m")
def month_series(l: DataFrame) -> DataFrame:
    m = l.groupBy(F.substring(F.col("sold_date").cast("string"), 1, 7).alias("month")).agg(r4(A.median("ppsqm")).alias("median_ppsqm"), r4(A.median("sold_price")).alias("median_price"), count().alias("n"))
    return m.crossJoin(F.broadcast(l.agg(F.substring(F.max("sold_date").cast("string"), 1, 7).alias("_last")))).withColumn("is_partial", F.col("month") == F.col("_last")).drop("_last")


@query(", c AS (SELECT year(sold_date) y, month(sold_date) AS moy, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT moy, round_even(avg(n), 1) AS mean_count FROM c GROUP BY 1) SELECT CAST(moy AS INTEGER) AS moy, m AS median_price, mean_count FROM (SELECT month(sold_date) AS moy, round(median(sold_price) + 1e-7, 4) AS m FROM l GROUP BY 1) JOIN a USING (moy)")
def seasonality(l: DataFrame) -> DataFrame:
    moy = F.month("sold_date").alias("moy")
    counts = l.groupBy(F.year("sold_date").alias("y"), moy).count().groupBy("moy").agg(F.bround(F.avg("count"), 1).alias("mean_count"))
    return l.groupBy(moy).agg(r4(A.median("sold_price")).alias("median_price")).join(counts, "moy").select("moy", "median_price", "mean_count")


@query(", e AS (SELECT date_trunc('month', max(sold_date))::DATE AS last FROM l), s AS (SELECT area, CAST(i AS INTEGER) AS months_back, (last - to_months(CAST(i AS INTEGER)))::DATE AS month FROM e, range(1, 13) r(i), (SELECT DISTINCT area FROM l)) SELECT s.area, months_back, s.month, round(median(l.sold_price) + 1e-7, 4) AS median_price FROM s LEFT JOIN l ON date_trunc('month', l.sold_date)::DATE = s.month AND l.area = s.area GROUP BY ALL")
def last_12_months(l: DataFrame) -> DataFrame:
    s = l.agg(F.trunc(F.max("sold_date"), "MM").alias("last")).select("last", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("months_back")).select("months_back", F.add_months("last", -F.col("months_back")).alias("month"))
    m = l.groupBy("area", F.trunc("sold_date", "MM").alias("month")).agg(r4(A.median("sold_price")).alias("median_price"))
    return l.select("area").distinct().crossJoin(F.broadcast(s)).join(m, ["area", "month"], "left").select("area", "months_back", "month", "median_price")


_PREM = "CASE WHEN listing_price <> 0 THEN (sold_price - listing_price) * 100 / listing_price END"


def _premium(l: DataFrame) -> DataFrame:
    return l.withColumn("premium", M.premium_pct(F.col("sold_price"), F.col("listing_price")))


@query(f", p AS (SELECT strftime(sold_date, '%Y') AS year, {_PREM} AS premium FROM l) SELECT year, count(premium) AS n, round(avg(CAST(premium > 0 AS DOUBLE)), 6) AS share_over, round(avg(CAST(premium < 0 AS DOUBLE)), 6) AS share_under, round(avg(CAST(premium = 0 AS DOUBLE)), 6) AS share_at, round(median(premium) + 1e-7, 4) AS median_premium FROM p GROUP BY 1")
def bidding_shares(l: DataFrame) -> DataFrame:
    p = _premium(l).groupBy(F.substring(F.col("sold_date").cast("string"), 1, 4).alias("year"))
    return p.agg(F.count("premium").alias("n"), *[F.round(v, 6).alias(k) for k, v in A.shares(F.col("premium")).items()], r4(A.median("premium")).alias("median_premium"))


def _premium_rank(l: DataFrame, best: bool) -> DataFrame:
    p = _premium(l).where("abs(premium) <= 75").groupBy("area").agg(r4(F.avg("premium")).alias("mean_premium"), r4(A.median("premium")).alias("median_premium"), count().alias("n")).where("n >= 30")
    return p.orderBy(F.desc("mean_premium") if best else F.asc("mean_premium"), "area").limit(5)


_AREA_PREM = f", p AS (SELECT area, {_PREM} AS premium FROM l), a AS (SELECT area, round(avg(premium) + 1e-7, 4) AS mean_premium, round(median(premium) + 1e-7, 4) AS median_premium, count(*) AS n FROM p WHERE abs(premium) <= 75 GROUP BY 1 HAVING count(*) >= 30) SELECT * FROM a ORDER BY mean_premium "


@query(_AREA_PREM + "DESC, area LIMIT 5")
def area_premiums_top5(l: DataFrame) -> DataFrame:
    return _premium_rank(l, True)


@query(_AREA_PREM + ", area LIMIT 5")
def area_premiums_bottom5(l: DataFrame) -> DataFrame:
    return _premium_rank(l, False)


@query("SELECT area, round(median(ppsqm) + 1e-7, 4) AS median_ppsqm, round(median(sold_price) + 1e-7, 4) AS median_price, count(*) AS n, round(count(*) / (SELECT count(*) FROM l), 6) AS share FROM l GROUP BY 1 HAVING count(*) >= 2")
def geography(l: DataFrame) -> DataFrame:
    t = l.groupBy("area").agg(r4(A.median("ppsqm")).alias("median_ppsqm"), r4(A.median("sold_price")).alias("median_price"), count().alias("n"))
    total = t.agg(F.sum("n").alias("total"))
    return t.crossJoin(F.broadcast(total)).where("n >= 2").select("area", "median_ppsqm", "median_price", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def _case(x: str, edges, labels, closed: str = "left") -> str:
    out = []
    for a, b, name in zip(edges, edges[1:], labels, strict=False):
        low = [] if a == -C.INF else [f"{x} {'>=' if closed == 'left' else '>'} {a}"]
        high = [] if b == C.INF else [f"{x} {'<' if closed == 'left' else '<='} {b}"]
        out.append(f"WHEN {' AND '.join([f'{x} IS NOT NULL', *low, *high])} THEN '{name}'")
    return f"CASE {' '.join(out)} END"


def _bucket_sql(bucket: str, value: str, least: int) -> str:
    return f"SELECT {bucket} AS bucket, round(median({value}) + 1e-7, 4) AS median, count(*) AS n FROM l WHERE {value} IS NOT NULL AND {bucket} IS NOT NULL GROUP BY 1 HAVING count(*) >= {least}"


@query(_bucket_sql(_case("living_area", C.CURVE_EDGES, C.CURVE_SIZES), "ppsqm", 30))
def size_curve(l: DataFrame) -> DataFrame:
    return A.bucketed(l, C.bucketize(F.col("living_area"), C.CURVE_EDGES, C.CURVE_SIZES), "ppsqm", 30).withColumn("median", r4("median"))


@query(_bucket_sql(_case("living_area", *C.REPORT_SIZES), "sold_price", 1))
def price_by_size(l: DataFrame) -> DataFrame:
    return A.bucketed(l, C.bucketize(F.col("living_area"), *C.REPORT_SIZES), "sold_price").withColumn("median", r4("median"))


_ROOM = "CASE WHEN rooms >= 4 THEN '4+' WHEN rooms IN (1, 2, 3) THEN CAST(CAST(rooms AS INTEGER) AS VARCHAR) END"


@query(f"SELECT {_ROOM} AS room, round(median(ppsqm) + 1e-7, 4) AS median, round(avg(ppsqm) + 1e-7, 4) AS mean, round(min(ppsqm) + 1e-7, 4) AS least, round(max(ppsqm) + 1e-7, 4) AS most, count(ppsqm) AS n FROM l WHERE rooms IS NOT NULL GROUP BY 1")
def rooms_stats(l: DataFrame) -> DataFrame:
    return l.where("rooms is not null").groupBy(C.room_bucket(F.col("rooms")).alias("room")).agg(r4(A.median("ppsqm")).alias("median"), r4(F.avg("ppsqm")).alias("mean"), r4(F.min("ppsqm")).alias("least"), r4(F.max("ppsqm")).alias("most"), F.count("ppsqm").alias("n"))


@query(f"SELECT {_case('construction_year', *C.REPORT_ERAS)} AS era, count(*) AS n, round(count(*) / (SELECT count(*) FROM l WHERE construction_year IS NOT NULL), 6) AS share, round(median(ppsqm) + 1e-7, 4) AS median_ppsqm FROM l WHERE construction_year IS NOT NULL GROUP BY 1")
def era_share(l: DataFrame) -> DataFrame:
    t = l.where("construction_year is not null").groupBy(C.bucketize(F.col("construction_year"), *C.REPORT_ERAS).alias("era")).agg(count().alias("n"), r4(A.median("ppsqm")).alias("median_ppsqm"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("total")))).select("era", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "median_ppsqm")


_ARMS = "round(median(ppsqm) FILTER ({f}) + 1e-7, 4) AS median_with, round(median(ppsqm) FILTER (NOT {f}) + 1e-7, 4) AS median_without, count(ppsqm) FILTER ({f}) AS n_with, count(ppsqm) FILTER (NOT {f}) AS n_without"


@query("SELECT *, round((median_with - median_without) * 100 / nullif(median_without, 0) + 1e-7, 4) AS diff_pct FROM (SELECT 'elevator' AS amenity, " + _ARMS.format(f="elevator") + " FROM l UNION ALL SELECT 'balcony', " + _ARMS.format(f="balcony") + " FROM l)")
def amenity_effect(l: DataFrame) -> DataFrame:
    out = None
    for name in ("elevator", "balcony"):
        t = A.with_and_without(l, name, "ppsqm").select(F.lit(name).alias("amenity"), r4("median_with").alias("median_with"), r4("median_without").alias("median_without"), "n_with", "n_without")
        out = t if out is None else out.unionByName(t)
    return out.withColumn("diff_pct", r4(F.try_divide((F.col("median_with") - F.col("median_without")) * 100, F.nullif("median_without", F.lit(0.0)))))


_WITHIN = "SELECT '{f}' AS amenity, median((median_with - median_without) * 100 / median_without) AS d, count(*) AS n_areas FROM (SELECT area, " + _ARMS.replace("round(", "(").replace(" + 1e-7, 4)", ")") + " FROM l GROUP BY 1) WHERE n_with >= 20 AND n_without >= 20"


@query("SELECT amenity, round(d + 1e-7, 4) AS median_diff, n_areas FROM (" + " UNION ALL ".join(_WITHIN.format(f=f) for f in ("elevator", "balcony")) + ")")
def within_area_effect(l: DataFrame) -> DataFrame:
    """The median over areas with at least 20 in each arm; one area weighs as much as another."""
    out = None
    for name in ("elevator", "balcony"):
        t = A.with_and_without(l, name, "ppsqm", ["area"]).where("n_with >= 20 and n_without >= 20").agg(F.lit(name).alias("amenity"), r4(A.median("diff_pct")).alias("median_diff"), count().alias("n_areas"))
        out = t if out is None else out.unionByName(t)
    return out


@query(_bucket_sql("CASE WHEN floor >= 6 THEN '6+' WHEN floor BETWEEN 0 AND 5 THEN CAST(floor AS VARCHAR) END", "ppsqm", 30))
def floor_bucket(l: DataFrame) -> DataFrame:
    return A.bucketed(l, C.floor_bucket(F.col("floor")), "ppsqm", 30).withColumn("median", r4("median"))


@query(f"SELECT {_case('monthly_fee', C.FEE_EDGES, C.FEES)} AS bucket, round(median(ppsqm) + 1e-7, 4) AS median_ppsqm, round(median(monthly_fee / living_area) + 1e-7, 4) AS fee_per_sqm, count(*) AS n FROM l WHERE monthly_fee > 0 AND living_area > 0 GROUP BY 1")
def fee_bucket(l: DataFrame) -> DataFrame:
    rows = l.where("monthly_fee > 0 and living_area > 0")
    return rows.groupBy(C.bucketize(F.col("monthly_fee"), C.FEE_EDGES, C.FEES).alias("bucket")).agg(r4(A.median("ppsqm")).alias("median_ppsqm"), r4(A.median(F.col("monthly_fee") / F.col("living_area"))).alias("fee_per_sqm"), count().alias("n"))


@query(f", r AS (SELECT *, {_ROOM} AS room FROM l) SELECT area, coalesce(room, 'all') AS room, round(median(sold_price) + 1e-7, 4) AS median_price, round(avg(sold_price), 3) AS mean_price, count(*) AS n, n < 10 AS limited FROM (SELECT * FROM r WHERE room IS NOT NULL) GROUP BY GROUPING SETS ((area, room), (area))".replace("n < 10", "count(*) < 10"))
def room_rollup(l: DataFrame) -> DataFrame:
    rows = l.withColumn("room", C.room_bucket(F.col("rooms"))).where("room is not null").select("area", "room", "sold_price")
    g = rows.groupingSets([["area", "room"], ["area"]], "area", "room")
    return g.agg(r4(A.median("sold_price")).alias("median_price"), F.round(F.avg("sold_price"), 3).alias("mean_price"), count().alias("n")).select("area", F.coalesce("room", F.lit("all")).alias("room"), "median_price", "mean_price", "n", (F.col("n") < 10).alias("limited"))


@query("""SELECT area, round(median(CASE WHEN days_on_market > 0 THEN days_on_market END) + 1e-7, 4) AS median_dom, round(avg(sold_price - listing_price), 3) AS mean_change, round(stddev_samp(ppsqm), 3) AS std_ppsqm, count(*) AS inventory, round(count(*) / greatest(coalesce(median(CASE WHEN days_on_market > 0 THEN days_on_market END), 0), 1), 2) AS liquidity,
  round_even(count(*) FILTER (elevator) * 100.0::DOUBLE / count(*), 1) AS elevator_pct, round_even(count(*) FILTER (balcony) * 100.0::DOUBLE / count(*), 1) AS balcony_pct FROM l GROUP BY 1""")
def market_dynamics(l: DataFrame) -> DataFrame:
    dom = A.median(F.when(F.col("days_on_market") > 0, F.col("days_on_market")))
    pct = lambda c: F.bround(F.count(F.when(F.col(c), 1)) * 100.0 / count(), 1)
    return l.groupBy("area").agg(r4(dom).alias("median_dom"), F.round(F.avg(F.col("sold_price") - F.col("listing_price")), 3).alias("mean_change"), F.round(F.stddev_samp("ppsqm"), 3).alias("std_ppsqm"), count().alias("inventory"), F.round(count() / F.greatest(F.coalesce(dom, F.lit(0.0)), F.lit(1.0)), 2).alias("liquidity"), pct("elevator").alias("elevator_pct"), pct("balcony").alias("balcony_pct"))


@query(f""", r AS (SELECT area, {_ROOM} AS room, avg(sold_price) AS m, count(*) AS n FROM l WHERE rooms IS NOT NULL GROUP BY ALL) SELECT area, round(sum(m * n) / sum(n), 3) AS weighted FROM r WHERE room IS NOT NULL GROUP BY 1""")
def weighted_average(l: DataFrame) -> DataFrame:
    r = l.groupBy("area", C.room_bucket(F.col("rooms")).alias("room")).agg(F.avg("sold_price").alias("m"), count().alias("n")).where("room is not null")
    return r.groupBy("area").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 3).alias("weighted"))


@query("SELECT round(corr(sold_price, living_area), 6) AS price_area, round(corr(sold_price, rooms), 6) AS price_rooms, round(corr(living_area, rooms), 6) AS area_rooms, round(corr(listing_price, living_area), 6) AS listing_area FROM l")
def corr_pairs(l: DataFrame) -> DataFrame:
    pairs = {"price_area": ("sold_price", "living_area"), "price_rooms": ("sold_price", "rooms"), "area_rooms": ("living_area", "rooms"), "listing_area": ("listing_price", "living_area")}
    return l.agg(*[F.round(F.corr(a, b), 6).alias(k) for k, (a, b) in pairs.items()])


@query("""SELECT 'most_expensive' AS record, arg_max(listing_id, (sold_price, -listing_key)) AS listing_id FROM l UNION ALL SELECT 'cheapest', arg_min(listing_id, (sold_price, listing_key)) FROM l UNION ALL SELECT 'highest_ppsqm', arg_max(listing_id, (ppsqm, -listing_key)) FROM l WHERE ppsqm IS NOT NULL
  UNION ALL SELECT 'fastest', arg_min(listing_id, (days_on_market, listing_key)) FROM l WHERE days_on_market >= 1 UNION ALL SELECT 'largest', arg_max(listing_id, (living_area, -listing_key)) FROM l WHERE living_area IS NOT NULL""")
def records(l: DataFrame) -> DataFrame:
    up = lambda c, ok=True: F.max_by("listing_id", F.when(F.lit(ok) if ok is True else ok, F.struct(F.col(c), -F.col("listing_key"))))
    down = lambda c, ok=True: F.min_by("listing_id", F.when(F.lit(ok) if ok is True else ok, F.struct(F.col(c), F.col("listing_key"))))
    got = l.agg(up("sold_price").alias("most_expensive"), down("sold_price").alias("cheapest"), up("ppsqm", F.col("ppsqm").isNotNull()).alias("highest_ppsqm"), down("days_on_market", F.col("days_on_market") >= 1).alias("fastest"), up("living_area", F.col("living_area").isNotNull()).alias("largest"))
    return got.unpivot([], list(got.columns), "record", "listing_id")


@query("SELECT regexp_replace(address, '\\s+\\d+\\s*[A-Za-z]?$', '') AS street, count(*) AS n, round(median(sold_price) + 1e-7, 4) AS median_price FROM l GROUP BY 1 ORDER BY n DESC, street LIMIT 10")
def top_streets(l: DataFrame) -> DataFrame:
    return l.groupBy(S.street_report(F.col("address")).alias("street")).agg(count().alias("n"), r4(A.median("sold_price")).alias("median_price")).orderBy(F.desc("n"), "street").limit(10)


@query("SELECT area, listing_id, CAST(row_number() OVER (PARTITION BY area ORDER BY sold_date DESC, listing_key DESC) AS INTEGER) AS place FROM l QUALIFY place <= 10")
def recent_per_area(l: DataFrame) -> DataFrame:
    w = W.partitionBy("area").orderBy(F.desc("sold_date"), F.desc("listing_key"))
    return l.select("area", "listing_id", F.row_number().over(w).alias("place")).where("place <= 10")


@query(", t AS (SELECT area, min(sold_price) AS a, max(sold_price) AS b, arg_min(p, m) AS first, arg_max(p, m) AS last FROM (SELECT area, strftime(sold_date, '%Y-%m') AS m, median(sold_price) AS p, min(sold_price) AS sold_price FROM l GROUP BY 1, 2) GROUP BY 1) SELECT area, round((last - first) * 100 / first + 1e-7, 4) AS change_pct FROM t")
def trailing_change(l: DataFrame) -> DataFrame:
    m = l.groupBy("area", F.date_format("sold_date", "yyyy-MM").alias("m")).agg(A.median("sold_price").alias("p"))
    first, last = F.min_by("p", "m"), F.max_by("p", "m")
    return m.groupBy("area").agg(r4((last - first) * 100 / first).alias("change_pct"))


# ---- fallback chains --------------------------------------------------------------------------------------------------------


@query(", a AS (SELECT area, median(days_on_market) AS m FROM l WHERE days_on_market <= 1000 GROUP BY 1), o AS (SELECT coalesce(median(days_on_market), 30) AS m FROM l WHERE days_on_market <= 1000) SELECT listing_id, days_on_market AS original, CAST(CASE WHEN days_on_market > 1000 THEN round_even(coalesce(a.m, o.m), 0) ELSE days_on_market END AS BIGINT) AS days_on_market, coalesce(days_on_market > 1000, FALSE) AS imputed FROM l LEFT JOIN a USING (area), o")
def impute_dom(l: DataFrame) -> DataFrame:
    sane = l.where("days_on_market <= 1000")
    by_area = sane.groupBy("area").agg(A.median("days_on_market").alias("am"))
    overall = A.overall_medians(sane, ["days_on_market"]).select(F.coalesce("days_on_market", F.lit(30.0)).alias("om"))
    rows = l.select("listing_id", "area", "days_on_market").join(F.broadcast(by_area), "area", "left").crossJoin(F.broadcast(overall))
    high = F.col("days_on_market") > 1000
    return rows.select("listing_id", F.col("days_on_market").alias("original"), F.when(high, F.bround(F.coalesce("am", "om"), 0).cast("long")).otherwise(F.col("days_on_market")).alias("days_on_market"), F.coalesce(high, F.lit(False)).alias("imputed"))


@query(""", x AS (SELECT listing_id, median(sold_price) OVER w30 AS m1, median(sold_price) OVER w90 AS m3, median(sold_price) OVER w180 AS m6, median(sold_price) OVER w365 AS m12 FROM l WINDOW """ + ", ".join(f"w{n} AS (PARTITION BY area ORDER BY sold_date RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)" for n in _WINDOWS) + """), g AS (SELECT median(listing_price) AS m FROM l)
  SELECT listing_id, round(coalesce(m1, m3, m6, m12, g.m) + 1e-7, 4) AS m1, round(coalesce(m3, m6, m12, g.m) + 1e-7, 4) AS m3, round(coalesce(m6, m12, g.m) + 1e-7, 4) AS m6, round(coalesce(m12, g.m) + 1e-7, 4) AS m12 FROM x, g""")
def temporal_fallback(l: DataFrame) -> DataFrame:
    t = T.trailing(l.select("listing_id", "area", "sold_date", "sold_price"), "area", "sold_date", "sold_price", _WINDOWS)
    t = t.crossJoin(F.broadcast(l.agg(A.median("listing_price").alias("g"))))
    chain = ["median_30", "median_90", "median_180", "median_365", "g"]
    return t.select("listing_id", *[r4(F.coalesce(*chain[i:])).alias(f"m{n}") for i, n in enumerate((1, 3, 6, 12))])


@query(f""", {hex_sql("l", "s", NEIGHBOR_EDGE, "cx", "cy")}, c AS (SELECT cx, cy, median(ppsqm) AS m, count(ppsqm) AS n FROM s GROUP BY ALL), a AS (SELECT area, median(ppsqm) AS m, count(ppsqm) AS n FROM s GROUP BY ALL), g AS (SELECT median(ppsqm) AS m, count(ppsqm) AS n FROM s)
  SELECT listing_id, CASE WHEN c.n >= 20 THEN 'cell' WHEN a.n > 0 THEN 'area' ELSE 'global' END AS scope, round(CASE WHEN c.n >= 20 THEN c.m WHEN a.n > 0 THEN a.m ELSE g.m END + 1e-7, 4) AS p50, round(coalesce(CASE WHEN c.n >= 20 THEN c.m WHEN a.n > 0 THEN a.m ELSE g.m END / a.m - 1, 0), 6) AS premium FROM s JOIN c USING (cx, cy) JOIN a USING (area), g""")
def context_fit_apply(l: DataFrame) -> DataFrame:
    s = l.select("listing_id", "area", "ppsqm", G.hex_cell(F.col("lat"), F.col("lon"), NEIGHBOR_EDGE).alias("cell"))
    fit = lambda keys, p: s.groupBy(*keys).agg(F.struct(A.median("ppsqm").alias("p50")).alias(p), F.count("ppsqm").alias(f"{p}_n"))
    rows = s.join(fit(["cell"], "c"), "cell").join(F.broadcast(fit(["area"], "a")), "area").crossJoin(F.broadcast(fit([], "g")))
    got = tiered([("cell", F.col("c"), F.col("c_n"), 20), ("area", F.col("a"), F.col("a_n"), 1), ("global", F.col("g"), F.col("g_n"), 0)], ["p50"])
    return rows.select("listing_id", got["scope"].alias("scope"), r4(got["p50"]).alias("p50"), F.round(F.coalesce(M.safe_divide(got["p50"], F.col("a.p50")) - 1, F.lit(0.0)), 6).alias("premium"))
