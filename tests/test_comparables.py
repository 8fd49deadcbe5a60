"""Quantiles over earlier days, what builds on them, and the rules whose cases the order tables don't reach."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.functions import strings as S
from parcelyard.operators import aggregates as A
from parcelyard.operators import models as P
from parcelyard.operators import quantiles as Q
from parcelyard.operators import relational as R
from parcelyard.operators.search import similar
from parcelyard.plans import tiers
from parcelyard.sources import files, sinks

DAY = dt.date(2020, 1, 1)


def test_ranked_equals_sorting():
    rng = np.random.default_rng(3)
    values, weights = rng.integers(0, 9, 60).astype(float), rng.integers(1, 4, 60)
    ranked = Q.Ranked(values, weights)
    for _ in range(200):
        a, b = sorted(rng.integers(0, 61, 2).tolist())
        own = np.sort(np.repeat(values[a:b], weights[a:b]))
        if len(own):
            k = int(rng.integers(0, len(own)))
            assert ranked.at(np.array([a]), np.array([b]), np.array([k]))[0] == own[k]


@pytest.mark.parametrize("split", [None, 5])
def test_window_quantiles_equal_brute_force(spark, split):
    rng = np.random.default_rng(5)
    rows = [("a" if rng.random() < 0.7 else None if rng.random() < 0.3 else "b", DAY + dt.timedelta(int(rng.integers(0, 90))), None if rng.random() < 0.1 else float(rng.integers(0, 40))) for _ in range(300)]
    rows.append(("a", None, 1.0))
    df = spark.createDataFrame(rows, "k string, d date, v double")
    windows, qs = {"all": None, "w30": 30}, [0.5, 0.9]
    got = Q.window_quantiles(df, ["k"], "d", "v", windows, qs, split).collect()
    assert len(got) == len({(k, d) for k, d, _ in rows if d})
    for r in got:
        for name, back in windows.items():
            own = [v for k, d, v in rows if d and k == r.k and d < r.d and (back is None or (r.d - d).days <= back)]
            known = [v for v in own if v is not None]
            assert (r[f"{name}_rows"], r[f"{name}_n"]) == (len(own), len(known))
            for i, q in enumerate(qs):
                assert r[f"{name}_q{i}"] == (pytest.approx(np.quantile(known, q)) if known else None)


def test_overall_quantiles(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(0, 50, 3000), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    assert A.overall_quantiles(df, "v", [0.0, 0.01, 0.5, 0.777, 1.0]).first()[0] == pytest.approx(np.quantile(x, [0.0, 0.01, 0.5, 0.777, 1.0]).tolist())
    assert A.overall_quantiles(df.where("v is null"), "v", [0.5]).first()[0] == [None]


def test_area_tokens(spark):
    cases = {
        "Lägenhet · Kista · Stockholms stad": "Kista", "Lägenhet · Vasastan﻿ · Stockholm": "Vasastan", "Villa ·&nbsp;Täby kyrkby \\u202f": "Täby kyrkby",
        "Sverige · Lägenhet": "Sverige", "Lägenhet · Villa · Stockholm": "Villa", "Solna  centrum": "Solna centrum",
    }
    df = spark.createDataFrame(list(cases.items()), "x string, want string")
    assert df.where(~S.area_token(F.col("x")).eqNullSafe(F.col("want"))).collect() == []


def test_merge_newer_keeps_the_old_row_where_a_date_is_unknown(spark):
    day = lambda n: DAY + dt.timedelta(n)
    old = spark.createDataFrame([("a", 1.0, None, "o"), ("b", 1.0, day(5), "o"), ("c", None, None, "o"), ("d", 1.0, day(1), "o"), ("e", 1.0, day(1), "o")], "k string, v double, t date, w string")
    new = spark.createDataFrame([("a", 2.0, day(9), "n"), ("b", 2.0, None, "n"), ("c", 2.0, day(1), "n"), ("d", 2.0, day(2), "n"), ("e", 2.0, day(1), "n"), ("f", None, None, "n")], "k string, v double, t date, w string")
    assert {r.k: r.w for r in R.merge_newer(old, new, "k", "v", "t").collect()} == {"a": "o", "b": "o", "c": "n", "d": "n", "e": "o", "f": "n"}


def test_estimate_range_takes_the_buckets_factors(spark):
    factors = spark.createDataFrame([(0, 0.94, 0.99), (1, 0.96, 1.04)], "bucket int, lower double, upper double")
    got = P.estimate_range(spark.createDataFrame([(1, 950.0), (2, 1250.0)], "id int, p double"), "p", factors, [1000.0], 100.0).collect()
    assert sorted((r.id, r.center, r.low, r.high) for r in got) == [(1, 1000.0, 800.0, 1000.0), (2, 1300.0, 1200.0, 1300.0)]


def test_similar_meets_by_tier_and_price(spark):
    rows = [(f"k{i:02d}", "t" + str(i % 7), 100.0 * 1.13**i) for i in range(30)]
    got = similar(spark.createDataFrame(rows, "k string, t string, p double"), "k", "t", "p").collect()
    for k, t, p in rows:
        score = lambda o, t=t, p=p: 3 * (o[1] == t) + (2 if abs(o[2] - p) / p < 0.1 else 1 if abs(o[2] - p) / p < 0.2 else 0)
        want = sorted(((-score(o), o[0]) for o in rows if o[0] != k))[:3]
        assert [(-r.score, r.other) for r in sorted((r for r in got if r.k == k), key=lambda r: r["rank"])] == want


def test_acceptance_and_retraining(spark):
    m = spark.createDataFrame([(0.07,), (0.09,), (None,)], "median_ape double")
    assert [r.accepted for r in tiers.accepted(m).orderBy(F.desc_nulls_last("median_ape")).collect()] == [False, True, False]
    d = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "column_name string, drifted boolean")
    assert tiers.retrain_wanted(False, d).first().asDict() == {"drifted": 2, "retrain": False, "reason": "none"}
    assert tiers.retrain_wanted(True, d).first().reason == "degraded"


def test_small_steps(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert R.with_defaults(df, {"b": 0, "c": 5}).first().asDict() == {"a": 1, "b": "x", "c": 5}
    assert R.shared_columns(df, spark.range(1).selectExpr("id b", "id z")) == ["b"]
    got = spark.createDataFrame([("https://www.site.se/bostad/123?x",), ("https://evil.org/bostad/123",)], "u string").select(S.listing_id_of(F.col("u"), ("site.se",)).alias("i")).collect()
    assert [r.i for r in got] == ["123", None]
    assert spark.range(1).select(S.display_name(F.lit("gamla_stan")).alias("a"), S.display_name(F.lit("x"), {"x": "Øx"}).alias("b")).first()[:] == ("Gamla Stan", "Øx")


def test_missing_csv_is_an_empty_frame(spark, tmp_path):
    got = files.csv_reference(spark, str(tmp_path / "none.csv"), {"a": "int", "b": "string"})
    assert got.columns == ["a", "b"] and got.isEmpty()


def test_records_are_mapped(spark):
    one = '{"listingId": "7", "size": "54,5", "sold": {"price": 3000000}, "listPrice": {"raw": 2900000}, "location": {"namedAreas": [{"name": "Kista"}]}, "address": "", "streetAddress": "Gatan 1"}'
    r = files.map_record(spark.createDataFrame([(one,), ('{"id": "None"}',)], "value string")).collect()
    assert len(r) == 1 and (r[0].listing_id, r[0].living_area, r[0].sold_price, r[0].area, r[0].address, r[0].price_per_sqm, r[0].price_change) == ("7", 54.5, 3000000.0, "Kista", "Gatan 1", 55046, 100000.0)


def test_first_of_repeated_lines_and_counts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"listing_id": "1", "sold_date": "2020-01-02", "v": 1}\n{"listing_id": "2", "sold_date": "2020-02-02", "v": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"listing_id": "1", "sold_date": "2020-01-02", "v": 3}\n{"listing_id": "3", "sold_date": null, "v": 4}\n')
    rows, by_source, by_month = sinks.merged_lines(spark, str(tmp_path), "listing_id string, sold_date string, v int", "listing_id", "sold_date")
    assert sorted((r.listing_id, r.v) for r in rows.collect()) == [("1", 1), ("2", 2), ("3", 4)]
    assert sorted((r.source, r.n) for r in by_source.collect()) == [("a.jsonl", 2), ("b.jsonl", 1)]
    assert sorted(((r.month, r.n) for r in by_month.collect()), key=repr) == [("2020-01", 1), ("2020-02", 1), (None, 1)]


def test_report_is_nested_json(spark, tmp_path):
    import json

    df = spark.createDataFrame([("a", 1, 2.0)], "area string, n int, m double").select("area", F.struct("n", "m").alias("stats"))
    sinks.report_json(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"area": "a", "stats": {"n": 1, "m": 2.0}}]
