"""What keeps the tiered model's steps in proportion to their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.operators import aggregates as A
from parcelyard.operators import models as P
from parcelyard.operators import temporal as T
from parcelyard.plans import features as X
from parcelyard.plans import registry as G
from parcelyard.plans import tiers
from parcelyard.sources.listings import listings

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_sets_open_their_own_folds(spark):
    rows, _, _ = tiers.table(listings(spark, DATA), G.NO_LIST, 2)
    every = set(rows.inputFiles())
    own = [{f for f in every if f"fold={i}/" in f} for i in range(3)]
    assert all(own) and set().union(*own) == every  # no file holds rows of two folds
    assert "PartitionFilters: [isnotnull(fold" in plan(rows.where("fold < 1").select("_x"))


def test_large_models_are_fitted_alone():
    assert [tiers._at_once(n) for n in (0, 1000, 6_600_000, 40_000_000)] == [tiers.AT_ONCE, tiers.AT_ONCE, 3, 1]


def test_folds_cut_days_by_place(spark):
    rng = np.random.default_rng(3)
    days = sorted(rng.choice(np.arange(40), 500).tolist() + [17] * 300)
    order = sorted((d, f"k{i:04d}") for i, d in enumerate(rng.permutation(days).tolist()))
    df = spark.createDataFrame(order, "d int, tie string").select(F.date_add(F.lit("2020-01-01").cast("date"), "d").alias("day"), "tie").repartition(3)
    for k in (1, 3, 7):
        n = len(order)
        want = {tie: max(0, k - (n - p - 1) // max(n // (k + 1), 1)) for p, (_, tie) in enumerate(order)}
        assert {r.tie: r.fold for r in T.folds(df, "day", "tie", k).collect()} == want


def test_weights_are_tried_once(spark):
    df = spark.createDataFrame([(10.0, 9.0, 12.0, "low"), (20.0, 21.0, 19.0, None)], "y double, a double, b double, gate string")
    best = P.best_experts(df, "y", ["a", "b"], "gate", units=4, least=1)
    assert "MapInArrow" not in plan(best) and {r.gate: list(r.units) for r in best.collect()}["low"] == [3, 1]


def test_middles_equal_sorting(spark):
    rng = np.random.default_rng(5)
    columns = {"a": rng.normal(size=4001), "b": rng.integers(0, 7, 4001).astype(float), "c": np.where(rng.random(4001) < 0.5, np.nan, rng.random(4001))}
    df = spark.createDataFrame([(*(float(x) if x == x else None for x in row), None) for row in zip(*columns.values(), strict=True)], "a double, b double, c double, d double").repartition(4)
    got = {r.column_name: r.middle for r in A.middles(df, ["a", "b", "c", "d"]).collect()}
    known = {c: np.sort(x[~np.isnan(x)]) for c, x in columns.items()}
    assert got == {c: x[(len(x) - 1) // 2] for c, x in known.items()}


def test_errors_of_all_rows_equal_errors(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(a), float(a + e)) for a, e in zip(rng.integers(0, 50, 999), rng.normal(size=999), strict=True)] + [(None, 1.0), (2.0, None)], "y double, p double")
    got = A.overall_errors(df, "y", "p")
    want = df.agg(*[c.alias(k) for k, c in A.errors(F.col("y"), F.col("p")).items()])
    assert got.columns == want.columns and list(got.first()) == pytest.approx(list(want.first()))
    assert list(A.overall_errors(df.limit(0), "y", "p").first())[:2] == [0, None]


def test_quality_by_one_ladder(spark):
    df = spark.createDataFrame([(y,) for y in (None, *range(1880, 2030))], "y int")
    assert df.where(~C.quality_of_year(F.col("y")).eqNullSafe(C.quality(C.era(F.col("y"))))).count() == 0


def test_chain_keeps_what_is_asked_for(spark):
    whole, kept = X.features(listings(spark, DATA)), X.features(listings(spark, DATA), ["listing_key", "season", "quality"])
    assert "address" not in kept.columns and {"listing_key", "season", "quality", "area_p50", "encoded_area", "dom_median"} <= set(kept.columns)
    names = ["listing_key", "season", "quality", "area_p50", "area_n", "price_median", "dom_median"]
    assert kept.select(names).exceptAll(whole.select(names)).count() == 0
