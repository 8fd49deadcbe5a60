"""Boundaries that the tables don't reach."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.functions import math as M
from parcelyard.functions import strings as S
from parcelyard.operators import aggregates as A
from parcelyard.operators import models as P
from parcelyard.operators import relational as R
from parcelyard.operators import temporal as T
from parcelyard.operators.search import Query


def one(spark, column, **row):
    types = {str: "string", int: "long", float: "double", bool: "boolean"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[type(v)] if v is not None else 'double'}" for k, v in row.items())).select(column.alias("x")).first().x


def test_same_day_rows_never_see_each_other(spark):
    day = dt.date(2024, 1, 10)
    rows = [("a", dt.date(2024, 1, 1), 10.0), ("a", day, 50.0), ("a", day, 500.0)]
    swapped = [rows[0], ("a", day, 500.0), ("a", day, 50.0)]
    got = []
    for r in (rows, swapped):
        df = spark.createDataFrame(r, "k string, d date, v double")
        got.append(sorted(tuple(x) for x in T.prior_quantiles(df, "k", "d", "v").collect() if x.d == day))
    assert got[0] == got[1] == [("a", day, 10.0, 10.0, 10.0, 1)]


def test_grouped_quantiles_equal_the_window(spark):
    rows = [(f"k{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=i * 7 % 40), float(i * 37 % 101) if i % 5 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    native = {(r.k, r.d): (r.p50, r.p75, r.p90, r.n) for r in T.native_prior_quantiles(df, ["k"], "d", "v").collect()}
    for r in T.prior_quantiles(df, "k", "d", "v").collect():
        for x, y in zip((r.p50, r.p75, r.p90, r.n), native[r.k, r.d], strict=True):
            assert (x is None and y is None) or math.isclose(x, y)


def test_trailing_edge_includes_day_30_not_31(spark):
    d = dt.date(2024, 3, 31)
    df = spark.createDataFrame([("a", d - dt.timedelta(days=31), 1.0), ("a", d - dt.timedelta(days=30), 2.0), ("a", d, 9.0)], "k string, d date, v double")
    r = T.trailing(df, "k", "d", "v", [30]).where(F.col("d") == F.lit(d)).first()
    assert (r.median_30, r.count_30) == (2.0, 1)


def test_first_row_has_no_count(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "k string, d date, v double")
    assert T.trailing(df, "k", "d", "v", [30]).first().count_30 is None


@pytest.mark.parametrize(("a", "b", "want"), [(1.0, 0.0, None), (None, 2.0, None), (1.0, 4.0, 0.25), (float("inf"), 2.0, None), (float("nan"), 2.0, None)])
def test_safe_divide(spark, a, b, want):
    assert one(spark, M.safe_divide(F.col("a"), F.col("b")), a=a, b=b) == want


def test_normal_quantile(spark):
    for p, want in ((0.5, 0.0), (0.975, 1.959963985), (0.001, -3.090232306)):
        assert abs(one(spark, M.interpolated_normal_quantile(F.col("p")), p=p) - want) < 1e-7


@pytest.mark.parametrize(("x", "band"), [(35.0, "0_35"), (35.1, "35_50"), (120.0, "90_120"), (121.0, "120_plus"), (0.0, "unknown"), (None, "unknown")])
def test_size_band_is_right_closed(spark, x, band):
    assert one(spark, C.size_band(F.col("x")), x=x) == band


@pytest.mark.parametrize(("x", "bucket"), [(39.9, "0-40"), (40.0, "40-50"), (120.0, "120+")])
def test_report_sizes_are_left_closed(spark, x, bucket):
    assert one(spark, C.bucketize(F.col("x"), *C.REPORT_SIZES), x=x) == bucket


@pytest.mark.parametrize(("x", "want"), [("ja", True), ("NEJ", False), (" 1 ", True), ("maybe", None), ("", None)])
def test_bool_words(spark, x, want):
    assert one(spark, S.to_bool(F.col("x")), x=x) is want


@pytest.mark.parametrize(("x", "want"), [("Lägenhet · Södermalm · Stockholm", "sodermalm"), ("Vasastan", "vasastan"), ("", "unknown"), ("Villa · Täby kommun", "taby_kommun")])
def test_area_slug(spark, x, want):
    assert one(spark, S.area_slug(F.col("x")), x=x) == want


@pytest.mark.parametrize(("x", "want"), [("Söder", "Södermalm"), ("Kungholmen", "Kungsholmen"), ("Sundbyberg/Duvbo", "Sundbyberg"), ("Vasastan/Norrmalm", "Norrmalm"), ("Södermalm", "Södermalm")])
def test_clean_area(spark, x, want):
    assert one(spark, S.clean_area(F.col("x")), x=x) == want


def test_street_and_postal(spark):
    assert one(spark, S.street_ml(F.col("x")), x="Storgatan  12B, lgh 3") == "storgatan"
    assert one(spark, S.street_report(F.col("x")), x="Storgatan 12 B") == "Storgatan"
    assert one(spark, S.postal_code(F.col("x")), x="Box 1, 113 46 Stockholm") == "11346"
    assert one(spark, S.swedish_month(F.col("x")), x="maj -22") == dt.date(2022, 5, 1)


def test_filters_refuse_what_is_unsafe(spark):
    for bad in (R.Filter("a; drop", "=", 1), R.Filter("a", "LIKE", "x"), R.Filter("a", "IN", [])):
        with pytest.raises(ValueError):
            bad.condition()
    with pytest.raises(TypeError):
        R.Filter("a", "=", [1]).condition()


def test_latest_lets_null_win_when_asked(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("a", None, 2)], "k string, t string, v int")
    assert R.latest(df, ["k"], [F.col("t").desc_nulls_first()]).first().v == 2


def test_histogram_keeps_the_last_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 0, 10)], "v double")
    assert [r.n for r in A.histogram(df, "v", 5, 0.0, 1.0).orderBy("bin").collect()] == [3, 0, 0, 0, 1]


def test_value_metrics_ties_and_single(spark):
    df = spark.createDataFrame([("a", 110.0, 100.0), ("b", 110.0, 100.0), ("c", 90.0, 100.0)], "id string, p double, s double")
    got = {r.id: (r.rank, r.score) for r in P.value_metrics(df, "p", "s", "id").collect()}
    assert got["a"] == got["b"] and got["a"][0] == 2.5 and got["c"][0] == 1.0
    assert P.value_metrics(df.limit(1), "p", "s", "id").first().score == 50.0


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        Query(limit=0).page(spark.range(1), "id")


def test_schema_evolution(spark):
    from pyspark.sql import types as Ty

    df = spark.createDataFrame([(1,)], "a int")
    schema = Ty.StructType([Ty.StructField("a", Ty.IntegerType(), False), Ty.StructField("b", Ty.StringType())])
    assert R.evolve(df, schema).columns == ["a", "b"]
    with pytest.raises(ValueError):
        R.evolve(df, Ty.StructType([Ty.StructField("z", Ty.StringType(), False)]))
