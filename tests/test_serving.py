"""Rows served through the frozen table equal rows of the batch chain dated after all others."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelyard.plans import comparables as K
from parcelyard.plans import features as X
from parcelyard.plans import registry as G
from parcelyard.plans import serving, tiers
from parcelyard.sources.listings import listings

DATA = "/root/testdata/sf0.001"
KEYS = (-1, -2, -3)


@pytest.fixture(scope="module")
def sales(spark):
    return tiers.written(listings(spark, DATA), "sales")


@pytest.fixture(scope="module")
def asked(sales):
    """Homes asked for on the day after the last sale: like an old one, in an unknown area, without an asking price or a place."""
    day = sales.agg(F.max("sold_date")).first()[0] + dt.timedelta(1)
    one = sales.where("living_area > 0").orderBy("listing_key").limit(1).withColumns({"sold_price": F.lit(None).cast("double"), "ppsqm": F.lit(None).cast("double"), "days_on_market": F.lit(None).cast("long"), "sold_date": F.lit(day)})
    two = one.withColumns({"area": F.lit("NOWHERE"), "address": F.lit("Nowhere 1")})
    three = one.withColumns({"listing_price": F.lit(None).cast("double"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    rows = [t.withColumns({"listing_key": F.lit(k).cast("long"), "listing_id": F.lit(str(k))}) for k, t in zip(KEYS, (one, two, three), strict=True)]
    return tiers.written(rows[0].unionByName(rows[1]).unionByName(rows[2]), "asked")


@pytest.fixture(scope="module")
def table(sales, tmp_path_factory):
    return serving.freeze(sales, f"file://{tmp_path_factory.mktemp('frozen')}").read()


def by_key(df, columns):
    return {r.listing_key: tuple(r[c] for c in columns) for r in df.where(F.col("listing_key") < 0).select("listing_key", *columns).collect()}


def test_served_features_equal_the_batch(sales, asked, table):
    batch = X.features(sales.unionByName(asked)).withColumn("month", F.trunc("sold_date", "MM"))
    batch = batch.join(F.broadcast(tiers.market_index(X.basic(sales.unionByName(asked)))), "month", "left")
    columns = [*X.NUMERIC, *X.CATEGORICAL, "idx"]
    want, got = by_key(batch, columns), by_key(serving.served_features(asked, table), columns)
    assert set(got) == set(KEYS)
    for k in KEYS:
        assert [pytest.approx(g, rel=1e-12) if isinstance(g, float) else g for g in got[k]] == list(want[k])


def test_served_comparables_equal_the_batch(sales, asked, table):
    both = sales.unionByName(asked)
    batch = K.address_comparables(K.same_size(K.micro_area(both), both), both)
    served = serving.comparables(asked, table)
    columns = [c for c in served.columns if c.startswith(("micro_", "same_size_", "street_", "address_", "size_"))]
    assert len(columns) > 25 and by_key(served, columns) == by_key(batch, columns)


def test_predictions_choose_their_model(spark, sales, asked, table):
    models = {}
    for spec in (G.NO_LIST, G.WITH_LIST):
        models[spec.name] = tiers.fit(sales.where("listing_key % 2 = 0"), spec, k=2, trees=1)
    got = {r.listing_key: r for r in serving.predict(asked, table, models).collect()}
    assert {k: r.model for k, r in got.items()} == {-1: "with_list", -2: "with_list", -3: "no_list"} and all(r.predicted >= 0 for r in got.values())
    alone = serving.predict(asked.where("listing_key = -1"), table, models).first()
    assert alone.predicted == got[-1].predicted
    assert {r.model for r in serving.predict(asked, table, models, "no_list").collect()} == {"no_list"}
    with pytest.raises(Exception, match="requires listing_price"):
        serving.predict(asked, table, models, "with_list").collect()
    with pytest.raises(ValueError, match="unknown model"):
        serving.predict(asked, table, models, "other")
    with pytest.raises(ValueError, match="not loaded: with_list"):
        serving.predict(asked, table, {"no_list": models["no_list"]})
    assert serving.predict(asked.limit(0), table, models).count() == 0
