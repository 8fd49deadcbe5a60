"""Scalar functions and rules at the values where they change."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.functions import dates as D
from parcelyard.functions import interactions as N
from parcelyard.functions import math as M
from parcelyard.functions import strings as S
from parcelyard.operators import relational as R
from parcelyard.plans import features as X
from parcelyard.sources import files


def told(spark, f, values, kind):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_districts(spark):
    codes = ["10000", "11499", "11500", "11799", "11800", "12599", "12600", "12799", "13000", "16999", "17000", "9999", "abc", None]
    c, s, k, n, o, e, u = "central_stockholm", "inner_south", "kungsholmen_vasastan", "inner_north", "outer_stockholm", "other_sweden", "unknown"
    assert told(spark, C.district, codes, "string") == [c, c, s, s, k, k, n, n, o, o, e, e, u, u]


def test_price_momentum(spark):
    changes = [None, -1.0, 0.0, 249_999.0, 250_000.0, 499_999.0, 500_000.0, 749_999.0, 750_000.0, 999_999.0, 1_000_000.0]
    assert told(spark, C.price_momentum, changes, "double") == ["normal", "below_asking", "normal", "normal", "hot", "hot", "very_hot", "very_hot", "extreme", "extreme", "bidding_war"]


def test_distance_to_center(spark):
    got = told(spark, C.distance_to_center, ["Östermalm", "vasastan", "Nowhere", None, ""], "string")
    assert got[0] < 5.0 and got[1] < 5.0 and got[2:] == [5.0, 5.0, 5.0]


def test_transit_score(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 3, 5), (2000.0, 5000.0, 0, 0), (9000.0, 9000.0, 9, 9), (1000.0, 2500.0, 0, 0), (None, 0.0, 0, 0)], "a double, b double, c int, d int")
    got = [r[0] for r in rows.select(M.transit_score(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[:4] == [pytest.approx(x) for x in (1.0, 0.0, 0.3, 0.35)] and got[4] is None


def test_dates(spark):
    assert told(spark, D.date10, ["2024-01-02T10:00:00Z", "2024-01-02", None, "x"], "string") == ["2024-01-02", "2024-01-02", None, "x"]
    texts = ["2024-01-02T10:00:00+02:00", "2024-01-02T10:00:00Z", "2024-01-02T23:30:00-0100", "2024-01-02 10:00:00", "2024-01-02", "bad", None]
    t = lambda *a: dt.datetime(2024, 1, *a)
    want = [t(2, 8), t(2, 10), t(3, 0, 30), t(2, 10), t(2), None, None]
    for zone in ("UTC", "America/New_York"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert told(spark, D.utc_naive, texts, "string") == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)


def test_asking_prices_are_masked(spark):
    r = X.mask_asking(spark.createDataFrame([(1.0, 2.0, 3)], "listing_price double, price_per_sqm double, rooms int")).first()
    assert tuple(r) == (None, None, 3)


def test_names_that_are_safe():
    assert R.safe_reference("my-project-1", "data_set", "t_20240115", quote=True) == "`my-project-1.data_set.t_20240115`" and R.quoted("a_1") == "`a_1`"
    bad = [("x", "d", "t"), ("-project", "d", "t"), ("project-", "d", "t"), ("Project1", "d", "t"), ("project1", "d-s", "t"), ("project1", "", "t"), ("project1", "d", "t;drop"), ("project1", "d", "tå"), (None, "d", "t"), ("p" * 31, "d", "t")]
    for names in bad:
        with pytest.raises(ValueError, match="unsafe"):
            R.safe_reference(*names)
    for name in ("1a", "a b", "a`b", "", None, "a" * 301):
        with pytest.raises(ValueError, match="unsafe"):
            R.quoted(name)


def test_valid_listings_normalise_the_area_first(spark):
    df = spark.createDataFrame([("Solna kommun", 10.0, None), ("Stockholm", 10.0, 1.0), (None, 1.0, 1.0)], "area string, sold_price double, rooms double")
    assert [r.area for r in R.valid_listings(df, 5.0, area=S.clean_area).orderBy("rooms").collect()][0] == "Solna"
    with pytest.raises(KeyError):
        R.valid_listings(df, 5.0, require_listing=True)


def test_a_record_without_a_url_has_one_of_its_id(spark):
    raw = spark.createDataFrame([('{"id": 7}',), ('{"id": 8, "url": "/a/8"}',), ('{"id": 9, "url": "https://x/9"}',)], "value string")
    got = {r.listing_id: r.url for r in files.map_record(raw, site="https://site").collect()}
    assert got == {"7": "https://site/bostad/7", "8": "https://site/a/8", "9": "https://x/9"}


def test_luxury_tiers_at_their_edges(spark):
    rows = [(1.35, 1.35, 1.35, True, 140.0), (0.9, 0.9, 0.9, False, 70.0), (1.35, 0.9, 0.9, True, 140.0), (None, None, None, False, None), (1.35, 1.35, 0.9, False, 70.0), (1.35, 1.35, 0.9, False, 77.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, central boolean, area double")
    got = N.luxury(F.col("a"), F.col("b"), F.col("c"), F.lit(1.0), F.col("central"), F.col("area"))
    out = [tuple(r) for r in df.select(F.round(got["score"], 6), got["flag"], got["tier"]).collect()]
    assert out == [(1.0, 1, "luxury"), (0.0, 0, "standard"), (0.64, 0, "premium"), (0.0, 0, "standard"), (0.64, 0, "premium"), (0.65, 1, "premium")]


def test_interactions_of_what_is_missing_are_null(spark):
    df = spark.createDataFrame([(50.0, 2.0, 3, 1000.0, 2e6, 5, 30), (0.0, None, None, None, None, None, None)], "living_area double, rooms double, floor int, monthly_fee double, listing_price double, days_on_market int, property_age int")
    a, b = N.with_interactions(df).orderBy(F.desc("living_area")).collect()
    assert (a.rooms_per_sqm, a.fee_efficiency, a.area_squared, a.area_age_interaction) == (0.04, 20.0, 2500.0, 1500.0)
    assert a.total_cost_per_sqm == (12_000 + 2e6) / 50 and a.property_desirability_score is None and a.luxury_score is None and a.enhancement_potential == 0
    assert b.rooms_per_sqm is None and b.value_score is None and "_price_norm" not in df.columns


def test_sparse_areas_go_to_their_parents(spark):
    names = ["Nytorget", "Alvik", "Vasastan Norra", "Bromma Vasastan", "Nowhere", "Bromma", *["Södermalm Sofia"] * 5, *["Södermalm Katarina"] * 4]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, area string")
    got = [r.area for r in R.consolidated(df, "area", S.TOGETHER, S.PARENTS).orderBy("i").collect()]
    assert got == ["Södermalm", "Bromma", "Vasastan", "Vasastan", "Nowhere", "Bromma", *["Södermalm Sofia"] * 5, *["Södermalm"] * 4]
