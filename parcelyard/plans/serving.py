"""Prices for homes that come one by one or in batches: statistics of all sales frozen in one table, features looked up there.

A frozen table says of each area, cell, street, address and size what a sale on
the day after the last would see, so rows served through it equal rows of the
batch chain dated after all others, and no window is worked out again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.operators import aggregates as A
from parcelyard.operators import geo as G
from parcelyard.operators import quantiles as Q
from parcelyard.operators import temporal as T
from parcelyard.plans import comparables as K
from parcelyard.plans import features as X
from parcelyard.plans import registry as R
from parcelyard.plans import tiers
from parcelyard.plans.catalog import _BAND, hex_parent_sql, hex_sql, query
from parcelyard.sources.sinks import Versions
from parcelyard.tables import written

#: Levels of the frozen table, and the columns that key them.
LEVELS: Mapping[str, Sequence[str]] = {
    "fine": ["_fine_cell"], "coarse": ["_coarse_cell"], "area_level": ["area"], "global": ["_all"],
    "street_area": ["_k_street"], "street_size": ["_k_street_size"], "address": ["_k_address"],
    "cell_size": ["_cell", "_band"], "area_size": ["_area", "_band"], "size": ["_band"],
}
MARKET = ("area_p50", "area_n", "price_median", "price_volatility", "dom_median", "encoded_area")
#: The area that stands for those without a sale, the day of all sales, and the day that asks for them.
UNSEEN, SOLD, ASKED = "\u0000", dt.date(1970, 1, 1), dt.date(1970, 1, 2)


def _key(columns: Sequence[str]) -> Column:
    return F.when(~sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)).cast("boolean"), F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def _keyed(rows: DataFrame) -> DataFrame:
    fine = G.hex_cell(F.col("lat"), F.col("lon"), K.EDGE)
    return K.with_address_keys(K.with_size(rows.withColumns({"_fine_cell": fine, "_coarse_cell": G.hex_parent(fine), "_all": F.lit(0)})))


def _levels(l: DataFrame) -> DataFrame:
    """level, key, v of all levels at once: a row a level and key, however many sales a key has."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _key(c).alias("key")) for k, c in LEVELS.items()]))
    l = written(l.select("area", "address", "living_area", "lat", "lon", "ppsqm"), "listings")
    tall = _keyed(l).select("ppsqm", each.alias("x")).select("x.level", "x.key", F.lit(SOLD).alias("day"), F.col("ppsqm").cast("double").alias("ppsqm")).where("key is not null")
    asked = tall.select("level", "key", F.lit(ASKED).alias("day"), F.lit(None).cast("double").alias("ppsqm")).distinct()
    t = Q.window_quantiles(tall.unionByName(asked), ["level", "key"], "day", "ppsqm", {"p": None}, [0.5, 0.75, 0.9]).where(F.col("day") == F.lit(ASKED))
    return t.select("level", "key", _values({"p50": F.col("p_q0"), "p75": F.col("p_q1"), "p90": F.col("p_q2"), "n": F.col("p_n").cast("double")}))


def _values(named: Mapping[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named.values())).alias("v")


def _market(l: DataFrame) -> DataFrame:
    """level, key, v of the areas: what the chain's priors say after the last sale."""
    facts = X.basic(l).select("area", F.lit(SOLD).alias("sold_date"), "observed_ppsqm", "listing_price", F.col("sold_price").cast("double").alias("sold_price"), "days_on_market")
    known = facts.select("area").where("area is not null").distinct().unionByName(l.sparkSession.createDataFrame([(UNSEEN,)], "area string"))
    asked = known.select("area", F.lit(ASKED).alias("sold_date"), *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns[2:]])
    t = X.priors(facts.unionByName(asked)).where(F.col("sold_date") == F.lit(ASKED))
    return t.select(F.lit("market").alias("level"), F.col("area").alias("key"), _values({c: F.col(c).cast("double") for c in MARKET}))


def _months(l: DataFrame) -> DataFrame:
    """level, key, v of the months: the market's median price per square metre, carried forward."""
    made = X.basic(l)
    m = made.groupBy(F.trunc("sold_date", "MM").alias("month")).agg(A.median("observed_ppsqm").alias("ppsqm"))
    filled = T.fill_forward(T.month_spine(made, "sold_date").join(m, "month", "left"), "month", ["ppsqm"])
    return filled.select(F.lit("month").alias("level"), F.col("month").cast("string").alias("key"), _values({"ppsqm": F.col("ppsqm")}))


def freeze(l: DataFrame, path: str) -> Versions:
    """Write the frozen table of all sales of l as the current version under a path; readers of the one before aren't disturbed."""
    store = Versions(l.sparkSession, path)
    store.commit(_levels(l).unionByName(_market(l)).unionByName(_months(l)).repartition("level").sortWithinPartitions("level", "key"))
    return store


def frozen(table: DataFrame) -> K.Look:
    """A lookup of levels in a frozen table, for `micro_area`, `same_size` and `address_comparables`."""

    def look(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
        level = name.removeprefix("_")
        own = table.where(F.col("level") == level).select(F.col("key").alias("_at"), F.struct(*[F.col("v")[s].alias(s) for s in K.STATS]).alias(name), F.coalesce(F.col("v")["n"], F.lit(0.0)).cast("long").alias(f"{name}_n"))
        return rows.withColumn("_at", _key(LEVELS[level])).join(own, "_at", "left").drop("_at")

    return look


def comparables(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with what the micro area, homes of the same size, the street and the address say."""
    look = frozen(table)
    return K.address_comparables(K.same_size(K.micro_area(rows, look), look=look), look=look)


def served_features(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the feature chain's columns and the month's market index idx."""
    made = X.calendar(X.basic(rows))
    market = table.where("level = 'market'").select(F.col("key").alias("area"), *[F.col("v")[c].alias(c) for c in MARKET])
    unseen = market.where(F.col("area") == UNSEEN).select(F.col("encoded_area").alias("_unseen"))
    made = made.join(market, "area", "left").crossJoin(F.broadcast(unseen)).withColumn("encoded_area", F.coalesce("encoded_area", "_unseen")).drop("_unseen")  # one row
    months = table.where("level = 'month'").select(F.to_date("key").alias("_month"), F.col("v")["ppsqm"].alias("idx"))
    last = months.agg(F.max("_month").alias("_last"))
    made = made.crossJoin(F.broadcast(last)).withColumn("_month", F.least(F.add_months(F.trunc("sold_date", "MM"), -1), "_last"))
    return made.join(F.broadcast(months), "_month", "left").drop("_month", "_last")  # a row a month


def predict(rows: DataFrame, table: DataFrame, models: Mapping[str, tiers.Tiered], model: str = "auto", key: str = "listing_key") -> DataFrame:
    """key, model and predicted of each row; rows need a sold_date, which is the day that the price is asked for.

    models: by the name of their spec. `auto` takes the model with asking prices
    for rows that have one and the other for the rest. A model that isn't there,
    and a model with asking prices for a row without, are errors.
    """
    no_list, with_list = R.NO_LIST.name, R.WITH_LIST.name
    if model != "auto" and model not in (no_list, with_list):
        raise ValueError(f"unknown model {model!r}; known: auto, {no_list}, {with_list}")
    has = F.col("listing_price").isNotNull()
    chosen = F.when(has, with_list).otherwise(no_list) if model == "auto" else F.lit(model)
    if model == with_list:
        chosen = F.when(has, with_list).otherwise(F.raise_error(F.lit(f"the model {with_list} requires listing_price")))
    rows = rows.withColumns({"_model": chosen, "_listing": F.col(key)})
    if missing := [m for m in ((no_list, with_list) if model == "auto" else (model,)) if m not in models]:
        raise ValueError(f"not loaded: {', '.join(missing)}")
    out = None
    for name in (no_list, with_list) if model == "auto" else (model,):
        t = models[name]
        own = rows.where(F.col("_model") == name)
        made = served_features(own if t.spec.asking else own.withColumn("listing_price", F.lit(None).cast("double")), table)
        made = made if t.spec.asking else X.mask_asking(made)
        got = tiers.apply(t, tiers.prepared(made.withColumn("listing_key", F.col("_listing")), t.prepare, t.spec, t.context))
        got = got.select(F.col("listing_key").alias(key), F.lit(name).alias("model"), "predicted")
        out = got if out is None else out.unionByName(got)
    return out


_id = lambda level, q, r: f"CAST({level} * 72057594037927936 + CAST({q} + 134217728 AS BIGINT) * 268435456 + CAST({r} + 134217728 AS BIGINT) AS VARCHAR)"
_STREET = "lower(area) || '|' || regexp_replace(lower(address), '\\s+\\d+\\w?.*$', '')"
_KEYS_SQL = {
    "fine": _id(0, "fx", "fy"), "coarse": _id(1, "cx", "cy"), "area_level": "area", "global": "'0'", "street_area": _STREET, "street_size": f"{_STREET} || '|' || band", "address": "lower(area) || '|' || lower(address)",
    "cell_size": _id(1, "cx", "cy") + " || '|' || band", "area_size": "area || '|' || band", "size": "band",
}


@query(f", {hex_sql('l', 'hf', K.EDGE, 'fx', 'fy')}, {hex_parent_sql('hf', 'hc', 'fx', 'fy', 'cx', 'cy')}, b AS (SELECT *, {_BAND} AS band FROM hc), k AS ({' UNION ALL '.join(f"SELECT '{level}' AS level, {key} AS key, ppsqm FROM b" for level, key in _KEYS_SQL.items())})"
  " SELECT level, key, round(quantile_cont(ppsqm, 0.5) + 1e-7, 4) AS p50, round(quantile_cont(ppsqm, 0.75) + 1e-7, 4) AS p75, round(quantile_cont(ppsqm, 0.9) + 1e-7, 4) AS p90, CAST(count(ppsqm) AS BIGINT) AS n FROM k GROUP BY ALL")  # fmt: skip
def frozen_levels(l: DataFrame) -> DataFrame:
    """What is frozen of every cell, area, street, address and size: statistics of all their sales."""
    t = _levels(l)
    return t.select("level", "key", *[F.round(F.col("v")[c] + 1e-7, 4).alias(c) for c in K.STATS], F.col("v")["n"].cast("long").alias("n"))
