"""Registered queries on what earlier sales nearby tell: cells, areas, streets, addresses, the market of a month."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.functions import math as M
from parcelyard.functions import strings as S
from parcelyard.operators import aggregates as A
from parcelyard.operators import geo as G
from parcelyard.operators import temporal as T
from parcelyard.operators.fallback import tiered
from parcelyard.plans.catalog import _BAND, AROUND_SQL, count, hex_parent_sql, hex_sql, query, r4, up4
from parcelyard.tables import met, written

STATS = ("p50", "p75", "p90")
#: Rows, the name of a level, and the columns that key it, to rows with a struct <name> of STATS and the count <name>_n.
Look = Callable[[DataFrame, str, list[str]], DataFrame]
#: The edge of a fine cell in metres (a coarse one is its parent), and earlier sales that a cell, a street, a street with a size, an address, and a place with a size need.
EDGE = 400.0
CELL_LEAST, STREET_LEAST, STREET_SIZE_LEAST, ADDRESS_LEAST, SAME_SIZE_LEAST = 20, 5, 3, 3, 5


def _level(rows: DataFrame, facts: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """rows with the statistics of earlier sales of the same keys in facts: structs <name> and counts <name>_n (0 where there are none).

    facts is not what rows has become: each level would double the plan.
    """
    t = T.prior_quantiles(facts.select(*keys, "sold_date", "ppsqm"), keys, "sold_date", "ppsqm")
    t = t.select(*keys, "sold_date", F.struct(*STATS).alias(name), F.coalesce("n", F.lit(0)).alias(f"{name}_n"))
    return met(rows, t, [*keys, "sold_date"])


def _complete(got: dict[str, Column]) -> dict[str, Column]:
    """A missing p75 is the median, a missing p90 the p75; the upper tail is p90 / p50."""
    p75 = F.coalesce(got["p75"], got["p50"])
    p90 = F.coalesce(got["p90"], p75)
    return {"p50": got["p50"], "p75": p75, "p90": p90, "n": F.coalesce(got["count"], F.lit(0)).cast("long"), "tail": F.coalesce(M.safe_divide(p90, got["p50"]), F.lit(1.0))}


def before(facts: DataFrame) -> Look:
    """Statistics of the earlier sales among facts."""
    return lambda rows, name, keys: _level(rows, facts, name, keys)


def micro_area(rows: DataFrame, look: Look | None = None) -> DataFrame:
    """micro_p50, p75, p90, n, tail, resolution and premium over the area: the fine cell, the coarse one, the area, all sales, whichever has enough earlier sales first.

    look tells what a key's sales say; without one, the earlier rows among rows do.
    """
    fine = G.hex_cell(F.col("lat"), F.col("lon"), EDGE)
    rows = rows.withColumns({"_fine_cell": fine, "_coarse_cell": G.hex_parent(fine), "_all": F.lit(0)})
    look = look or before(rows)
    keys = {"fine": ["_fine_cell"], "coarse": ["_coarse_cell"], "area_level": ["area"], "global": ["_all"]}
    for name, own in keys.items():
        rows = look(rows, f"_{name}", own)
    least = {"fine": CELL_LEAST, "coarse": CELL_LEAST, "area_level": 1, "global": 1}
    got = tiered([(name.removesuffix("_level"), F.col(f"_{name}"), F.col(f"_{name}_n"), least[name]) for name in keys], STATS)
    own = {f"micro_{k}": v for k, v in _complete(got).items()}
    area = F.coalesce(F.col("_area_level.p50"), got["p50"])
    return rows.withColumns({**own, "micro_resolution": got["scope"], "micro_premium": F.coalesce(M.safe_divide(got["p50"], area) - 1, F.lit(0.0))}).drop(*[c for c in rows.columns if c.startswith("_")])


def with_size(df: DataFrame) -> DataFrame:
    cell = G.hex_parent(G.hex_cell(F.col("lat"), F.col("lon"), EDGE))
    return df.withColumns({"_cell": cell, "_area": F.coalesce("area", F.lit("unknown")), "_band": C.size_band(F.col("living_area"))})


def same_size(rows: DataFrame, facts: DataFrame | None = None, look: Look | None = None) -> DataFrame:
    """Of homes of the same size band, same_size_p50, p75, p90, n, tail, scope and premium over the micro area.

    rows have been through `micro_area`. The coarse cell, then the area (either
    with SAME_SIZE_LEAST earlier sales), then all sales of the size; a size
    without any takes the micro area's median, with a count of 0.
    """
    look = look or before(with_size(facts))
    rows = with_size(rows)
    keys = {"cell_size": ["_cell", "_band"], "area_size": ["_area", "_band"], "size": ["_band"]}
    for name, own in keys.items():
        rows = look(rows, f"_{name}", own)
    least = {"cell_size": SAME_SIZE_LEAST, "area_size": SAME_SIZE_LEAST, "size": 1}
    got = tiered([(k, F.col(f"_{k}"), F.col(f"_{k}_n"), least[k]) for k in keys], STATS)
    got["p50"] = F.coalesce(got["p50"], "micro_p50")
    own = {f"same_size_{k}": v for k, v in _complete(got).items()}
    premium = F.coalesce(M.safe_divide(got["p50"], F.col("micro_p50")) - 1, F.lit(0.0))
    return rows.withColumns({**own, "same_size_scope": F.coalesce(got["scope"], F.lit("micro_area")), "same_size_premium": premium}).drop(*[c for c in rows.columns if c.startswith("_")])


def with_address_keys(rows: DataFrame) -> DataFrame:
    street, area = S.street_ml(F.col("address")), F.lower("area")
    key = S.compound_key(area, street)
    rows = rows.withColumns({"_k_street": key, "_k_street_size": F.concat_ws("|", key, C.size_band(F.col("living_area"))), "_k_address": S.compound_key(area, F.lower(F.trim(F.regexp_replace("address", r"\s+", " "))))})
    return rows.withColumn("_k_street_size", F.when(F.col("_k_street").isNotNull(), F.col("_k_street_size")))


def address_comparables(rows: DataFrame, facts: DataFrame | None = None, look: Look | None = None) -> DataFrame:
    """Of street, street with size and address: p50, p75, p90, n, tail and scope, each falling back on the one before, the street on micro_area; and premiums."""
    look = look or before(with_address_keys(facts))
    rows = with_address_keys(rows)
    micro = {c: F.col(f"micro_{c}") for c in STATS}
    for name, own, least, scope in (("street_area", "_k_street", STREET_LEAST, "micro_area"), ("street_size", "_k_street_size", STREET_SIZE_LEAST, "street_area"), ("address", "_k_address", ADDRESS_LEAST, "street_area")):
        rows = look(rows, f"_{name}", [own])
        ok = F.col(own).isNotNull() & (F.coalesce(F.col(f"_{name}_n"), F.lit(0)) >= least)
        base = micro if name == "street_area" else {c: F.col(f"street_area_{c}") for c in STATS}
        n = F.lit(0) if name == "street_area" else F.col("street_area_n")
        got = {c: F.when(ok, F.col(f"_{name}.{c}")).otherwise(base[c]) for c in STATS} | {"count": F.when(ok, F.col(f"_{name}_n")).otherwise(n)}
        rows = rows.withColumns({**{f"{name}_{k}": v for k, v in _complete(got).items()}, f"{name}_scope": F.when(ok, name).otherwise(scope)})
    over = lambda a, b: F.coalesce(M.safe_divide(F.col(a), F.col(b)) - 1, F.lit(0.0))
    rows = rows.withColumns({"street_premium": over("street_area_p50", "micro_p50"), "size_premium": over("street_size_p50", "street_area_p50"), "address_premium": over("address_p50", "street_area_p50")})
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


_BEFORE = "ORDER BY sold_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"
_q = lambda w: f"{{'p50': quantile_cont(ppsqm, 0.5) OVER {w}, 'p75': quantile_cont(ppsqm, 0.75) OVER {w}, 'p90': quantile_cont(ppsqm, 0.9) OVER {w}, 'n': count(ppsqm) OVER {w}}}"
_MICRO_SQL = f""", {hex_sql("l", "hf", EDGE, "fx", "fy")}, {hex_parent_sql("hf", "hc", "fx", "fy", "cx", "cy")}, s0 AS (SELECT *, lower(area) || '|' || regexp_replace(lower(address), '\\s+\\d+\\w?.*$', '') AS street, lower(area) || '|' || lower(address) AS addr, {_BAND} AS band FROM hc),
  s1 AS (SELECT *, {_q('wf')} AS f, {_q('wc')} AS c, {_q('wa')} AS a, {_q('wg')} AS g, {_q('ws')} AS st, {_q('wz')} AS sz, {_q('wx')} AS ad FROM s0
  WINDOW wf AS (PARTITION BY fx, fy {_BEFORE}), wc AS (PARTITION BY cx, cy {_BEFORE}), wa AS (PARTITION BY area {_BEFORE}), wg AS ({_BEFORE}), ws AS (PARTITION BY street {_BEFORE}), wz AS (PARTITION BY street, band {_BEFORE}), wx AS (PARTITION BY addr {_BEFORE})),
  m AS (SELECT *, CASE WHEN f.n >= 20 THEN f WHEN c.n >= 20 THEN c WHEN a.n > 0 THEN a WHEN g.n > 0 THEN g END AS mi, CASE WHEN f.n >= 20 THEN 'fine' WHEN c.n >= 20 THEN 'coarse' WHEN a.n > 0 THEN 'area' WHEN g.n > 0 THEN 'global' END AS resolution FROM s1)"""


@query(_MICRO_SQL + " SELECT listing_id, resolution, round(mi.p50 + 1e-7, 4) AS p50, round(mi.p75 + 1e-7, 4) AS p75, round(mi.p90 + 1e-7, 4) AS p90, coalesce(mi.n, 0) AS n, round(coalesce(mi.p90 / mi.p50, 1) + 1e-9, 6) AS tail, round(coalesce(mi.p50 / coalesce(a.p50, mi.p50) - 1, 0) + 1e-9, 6) AS premium FROM m")
def micro_area_chain(l: DataFrame) -> DataFrame:
    t = micro_area(written(l.select("listing_id", "area", "sold_date", "ppsqm", "lat", "lon"), "listings"))
    return t.select("listing_id", F.col("micro_resolution").alias("resolution"), *[r4(f"micro_{c}").alias(c) for c in STATS], F.col("micro_n").alias("n"), F.round(F.col("micro_tail") + 1e-9, 6).alias("tail"), F.round(F.col("micro_premium") + 1e-9, 6).alias("premium"))


_CHOSEN_SQL = ", k AS (SELECT *, CASE WHEN st.n >= 5 THEN st ELSE {'p50': mi.p50, 'p75': mi.p75, 'p90': mi.p90, 'n': CAST(0 AS BIGINT)} END AS s FROM m), k2 AS (SELECT *, CASE WHEN sz.n >= 3 THEN sz ELSE s END AS z, CASE WHEN ad.n >= 3 THEN ad ELSE s END AS x FROM k)"


@query(_MICRO_SQL + _CHOSEN_SQL + """ SELECT listing_id, CASE WHEN st.n >= 5 THEN 'street_area' ELSE 'micro_area' END AS street_scope, CASE WHEN sz.n >= 3 THEN 'street_size' ELSE 'street_area' END AS size_scope, CASE WHEN ad.n >= 3 THEN 'address' ELSE 'street_area' END AS address_scope,
  round(s.p50 + 1e-7, 4) AS street_p50, s.n AS street_n, round(z.p50 + 1e-7, 4) AS size_p50, z.n AS size_n, round(x.p50 + 1e-7, 4) AS address_p50, round(x.p90 + 1e-7, 4) AS address_p90, x.n AS address_n,
  round(coalesce(s.p50 / mi.p50 - 1, 0) + 1e-9, 6) AS street_premium, round(coalesce(z.p50 / s.p50 - 1, 0) + 1e-9, 6) AS size_premium, round(coalesce(x.p50 / s.p50 - 1, 0) + 1e-9, 6) AS address_premium FROM k2""")
def address_comps(l: DataFrame) -> DataFrame:
    l = written(l.select("listing_id", "area", "address", "living_area", "sold_date", "ppsqm", "lat", "lon"), "listings")
    t = address_comparables(micro_area(l), l)
    return t.select(
        "listing_id", F.col("street_area_scope").alias("street_scope"), F.col("street_size_scope").alias("size_scope"), "address_scope", r4("street_area_p50").alias("street_p50"), F.col("street_area_n").alias("street_n"), r4("street_size_p50").alias("size_p50"), F.col("street_size_n").alias("size_n"),
        up4("address_p50"), up4("address_p90"), "address_n", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("street_premium", "size_premium", "address_premium")],
    )


@query(_MICRO_SQL + f""", z0 AS (SELECT *, {_q('wc')} AS zc, {_q('wa')} AS za, {_q('wg')} AS zg FROM m WINDOW wc AS (PARTITION BY cx, cy, band {_BEFORE}), wa AS (PARTITION BY area, band {_BEFORE}), wg AS (PARTITION BY band {_BEFORE})),
  z1 AS (SELECT *, CASE WHEN zc.n >= 5 THEN zc WHEN za.n >= 5 THEN za WHEN zg.n >= 1 THEN zg END AS z, CASE WHEN zc.n >= 5 THEN 'cell_size' WHEN za.n >= 5 THEN 'area_size' WHEN zg.n >= 1 THEN 'size' ELSE 'micro_area' END AS scope FROM z0),
  z2 AS (SELECT *, coalesce(z.p50, mi.p50) AS p50 FROM z1)
  SELECT listing_id, scope, round(p50 + 1e-7, 4) AS p50, round(coalesce(z.p75, p50) + 1e-7, 4) AS p75, round(coalesce(z.p90, z.p75, p50) + 1e-7, 4) AS p90, coalesce(z.n, 0) AS n, round(coalesce(coalesce(z.p90, z.p75, p50) / p50, 1) + 1e-9, 6) AS tail, round(coalesce(p50 / mi.p50 - 1, 0) + 1e-9, 6) AS premium FROM z2""")
def same_size_chain(l: DataFrame) -> DataFrame:
    l = written(l.select("listing_id", "area", "living_area", "sold_date", "ppsqm", "lat", "lon"), "listings")
    t = same_size(micro_area(l), l)
    return t.select("listing_id", F.col("same_size_scope").alias("scope"), *[r4(f"same_size_{c}").alias(c) for c in STATS], F.col("same_size_n").alias("n"), *[F.round(F.col(f"same_size_{c}") + 1e-9, 6).alias(c) for c in ("tail", "premium")])


@query(f"SELECT listing_id, round(quantile_cont(ppsqm, 0.5) OVER w + 1e-7, 4) AS p50, round(quantile_cont(ppsqm, 0.75) OVER w + 1e-7, 4) AS p75, round(quantile_cont(ppsqm, 0.9) OVER w + 1e-7, 4) AS p90, count(ppsqm) OVER w AS n FROM l WINDOW w AS ({_BEFORE})")
def prior_global(l: DataFrame) -> DataFrame:
    """All earlier sales: one key, which is cut into ranges of values where it is too large for a task."""
    l = written(l.select("listing_id", "sold_date", "ppsqm"), "listings")
    t = T.prior_quantiles(l.select(F.lit(0).alias("all"), "sold_date", "ppsqm"), ["all"], "sold_date", "ppsqm")
    return met(l.drop("ppsqm"), t, ["sold_date"]).select("listing_id", *[up4(c) for c in STATS], F.coalesce("n", F.lit(0)).alias("n"))


@query(", a AS (SELECT lower(area) || '|' || regexp_replace(lower(address), '\\s+\\d+\\w?.*$', '') AS street, lower(area) || '|' || lower(address) AS addr, " + f"{_BAND} AS band, ppsqm FROM l), k AS (SELECT 'street' AS level, street AS key, ppsqm FROM a UNION ALL SELECT 'street_size', street || '|' || band, ppsqm FROM a UNION ALL SELECT 'address', addr, ppsqm FROM a)"
  " SELECT level, key, round(quantile_cont(ppsqm, 0.5) + 1e-7, 4) AS p50, round(quantile_cont(ppsqm, 0.75) + 1e-7, 4) AS p75, round(quantile_cont(ppsqm, 0.9) + 1e-7, 4) AS p90, count(ppsqm) AS n FROM k GROUP BY ALL")  # fmt: skip
def address_context(l: DataFrame) -> DataFrame:
    """The same keys over all sales, as served: one pass over a row for each level."""
    area, street = F.lower("area"), S.street_ml(F.col("address"))
    keys = {"street": S.compound_key(area, street), "street_size": F.concat_ws("|", S.compound_key(area, street), C.size_band(F.col("living_area"))), "address": S.compound_key(area, F.lower("address"))}
    rows = l.select("ppsqm", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), v.alias("key")) for k, v in keys.items()])).alias("x")).select("x.*", "ppsqm").where("key is not null")
    return A.quad(rows, ["level", "key"], "ppsqm").select("level", "key", *[up4(c) for c in STATS], "n")


@query(_MICRO_SQL + f""", {AROUND_SQL},
  nb AS (SELECT s0.listing_key, n.fx, n.fy, median(n.ppsqm) AS p, count(n.ppsqm) AS n FROM s0, o, s0 n WHERE n.fx = s0.fx + dq AND n.fy = s0.fy + dr AND n.sold_date < s0.sold_date GROUP BY ALL HAVING count(n.ppsqm) > 0),
  nn AS (SELECT listing_key, sum(p * n) / sum(n) AS p, sum(n) AS n FROM nb GROUP BY 1) SELECT listing_id, round(coalesce(nn.p, mi.p50), 3) AS neighbor_p50, CAST(coalesce(nn.n, 0) AS BIGINT) AS neighbor_n FROM m LEFT JOIN nn USING (listing_key)""")
def neighbors_or_micro_area(l: DataFrame) -> DataFrame:
    """The neighbouring cells' median, or that of the micro area."""
    l = written(l.select("listing_key", "listing_id", "area", "sold_date", "ppsqm", "lat", "lon"), "listings")
    t = micro_area(l)
    near = G.neighbor_stats(l.select("listing_key", "lat", "lon", "sold_date", "ppsqm"), "sold_date", "ppsqm", EDGE)
    t = t.join(near.select("listing_key", "neighbor_p50", "neighbor_n"), "listing_key")
    return t.select("listing_id", F.round(F.coalesce("neighbor_p50", "micro_p50"), 3).alias("neighbor_p50"), "neighbor_n")


#: What an area's market is taken for without any row, fixed values in the order of MARKET.
MARKET = ("inventory", "price_volatility", "price_median", "dom_median", "price_change_mean")
MARKET_DEFAULTS = (50.0, 500000.0, 5000000.0, 20.0, 350000.0)
CHANGES_DEFAULT = 10.0


@query(f""", x AS (SELECT listing_id, listing_price, CASE WHEN count(*) OVER w > 0 THEN count(listing_price) OVER w END AS inventory, stddev_samp(listing_price) OVER w AS price_volatility, median(listing_price) OVER w AS price_median, median(days_on_market) OVER w AS dom_median, avg(sold_price - listing_price) OVER w AS price_change_mean,
  CASE WHEN count(*) OVER w > 0 THEN count(sold_price - listing_price) OVER w END AS price_change_count FROM l WINDOW w AS (PARTITION BY area {_BEFORE})), d AS (SELECT {', '.join(f'coalesce(median({c}), {v}) AS d{i}' for i, (c, v) in enumerate(zip(MARKET, MARKET_DEFAULTS, strict=True)))} FROM x),
  y AS (SELECT listing_id, listing_price, {', '.join(f'coalesce({c}, d{i}) AS {c}' for i, c in enumerate(MARKET))}, coalesce(price_change_count, {CHANGES_DEFAULT}) AS price_change_count FROM x, d)
  SELECT listing_id, {', '.join(f'round({c} + 1e-5, 2) AS {c}' for c in (*MARKET, 'price_change_count'))}, round(inventory / nullif(dom_median, 0) + 1e-7, 4) AS liquidity, round(listing_price / nullif(price_median, 0) + 1e-9, 6) AS relative_price, round(price_volatility / nullif(price_median, 0) + 1e-9, 6) AS volatility_score FROM y""")
def area_market_filled(l: DataFrame) -> DataFrame:
    """Unknown market figures are the median over all rows, or the default; and the indicators that follow."""
    rows = l.select("listing_id", "area", "sold_date", "listing_price", "days_on_market", (F.col("sold_price") - F.col("listing_price")).alias("change"))
    t = T.prior_market(written(rows, "listings"), "area", "sold_date", "listing_price", "days_on_market", "change")
    t = written(t, "area-market")  # five medians read it
    medians = A.overall_medians(t, MARKET).select(*[F.col(c).alias(f"_{c}") for c in MARKET])
    t = t.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), f"_{c}", F.lit(d)) for c, d in zip(MARKET, MARKET_DEFAULTS, strict=True)})
    t = t.withColumn("price_change_count", F.coalesce(F.col("price_change_count").cast("double"), F.lit(CHANGES_DEFAULT)))
    shares = {"liquidity": (M.safe_divide(F.col("inventory"), F.col("dom_median")), 4), "relative_price": (M.safe_divide(F.col("listing_price"), F.col("price_median")), 6), "volatility_score": (M.safe_divide(F.col("price_volatility"), F.col("price_median")), 6)}
    return t.select("listing_id", *[F.round(F.col(c) + 1e-5, 2).alias(c) for c in (*MARKET, "price_change_count")], *[F.round(v + (1e-7 if d == 4 else 1e-9), d).alias(k) for k, (v, d) in shares.items()])


@query(""", p AS (SELECT date_trunc('month', sold_date)::DATE AS month, median(ppsqm) AS ppsqm, count(*) AS sales FROM l GROUP BY 1), e AS (SELECT date_trunc('month', scraped_at)::DATE AS month, avg(days_on_market) AS dom FROM l WHERE month(scraped_at) % 2 = 0 GROUP BY 1), r AS (SELECT date_trunc('month', sold_date)::DATE AS month, avg(monthly_fee) AS fee FROM l WHERE month(sold_date) % 3 = 1 GROUP BY 1),
  s AS (SELECT unnest(generate_series(date_trunc('month', min(sold_date))::TIMESTAMP, date_trunc('month', max(sold_date))::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM l),
  j AS (SELECT s.month, ppsqm, sales, dom, fee FROM s LEFT JOIN p USING (month) LEFT JOIN e USING (month) LEFT JOIN r USING (month)),
  f AS (SELECT month, coalesce(last_value(ppsqm IGNORE NULLS) OVER w, 0) AS ppsqm, coalesce(last_value(sales IGNORE NULLS) OVER w, 0) AS sales, coalesce(last_value(dom IGNORE NULLS) OVER w, 20) AS dom, coalesce(last_value(fee IGNORE NULLS) OVER w, 0) AS fee FROM j WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT *, fee - lag(fee, 3) OVER (ORDER BY month) AS fee_change_3 FROM f)
  SELECT listing_id, round(coalesce(g.ppsqm, 0) + 1e-7, 4) AS ppsqm, coalesce(sales, 0) AS sales, round(coalesce(dom, 20) + 1e-7, 4) AS dom, round(coalesce(fee, 0) + 1e-7, 3) AS fee, round(coalesce(fee_change_3, 0) + 1e-7, 3) AS fee_change_3 FROM l LEFT JOIN g ON g.month = (date_trunc('month', l.sold_date) - INTERVAL 1 MONTH)::DATE""")
def market_table_asof(l: DataFrame) -> DataFrame:
    """Four monthly series with gaps on one spine, carried forward, with defaults before their first month; a sale sees the month before its own."""
    month = lambda c: F.trunc(c, "MM").alias("month")
    p = l.groupBy(month("sold_date")).agg(A.median("ppsqm").alias("ppsqm"), count().alias("sales"))
    e = l.where(F.month("scraped_at") % 2 == 0).groupBy(month("scraped_at")).agg(F.avg("days_on_market").alias("dom"))
    r = l.where(F.month("sold_date") % 3 == 1).groupBy(month("sold_date")).agg(F.avg("monthly_fee").alias("fee"))
    spine = T.month_spine(l, "sold_date").join(p, "month", "left").join(e, "month", "left").join(r, "month", "left")
    filled = T.fill_forward(spine, "month", ["ppsqm", "sales", "dom", "fee"]).na.fill({"ppsqm": 0.0, "sales": 0, "dom": 20.0, "fee": 0.0})
    filled = filled.withColumn("fee_change_3", F.col("fee") - F.lag("fee", 3).over(W.orderBy("month")))
    rows = l.select("listing_id", F.add_months(F.trunc("sold_date", "MM"), -1).alias("month")).join(F.broadcast(filled), "month", "left")
    at = lambda c, d, n: F.round(F.coalesce(F.col(c), F.lit(d)) + 1e-7, n).alias(c)
    return rows.select("listing_id", at("ppsqm", 0.0, 4), F.coalesce("sales", F.lit(0)).alias("sales"), at("dom", 20.0, 4), at("fee", 0.0, 3), at("fee_change_3", 0.0, 3))

