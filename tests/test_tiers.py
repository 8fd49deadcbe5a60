"""The tiered model, its weights and calibrator, the feature registry, and the search for parameters."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.operators import models as P
from parcelyard.operators import tuning
from parcelyard.plans import registry as G
from parcelyard.plans import tiers
from parcelyard.sources.listings import listings

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    rows, prepare, context = tiers.table(listings(spark, DATA), G.NO_LIST, 2)
    return rows, *tiers.fit_table(rows, prepare, context, G.NO_LIST, None, 2, trees=2)


def test_no_row_is_predicted_by_a_model_that_saw_it(spark, made):
    rows, _, oof = made
    edges = {r.fold: (r.a, r.b) for r in rows.groupBy("fold").agg(F.min(F.struct("sold_date", "listing_key")).alias("a"), F.max(F.struct("sold_date", "listing_key")).alias("b")).collect()}
    assert sorted(edges) == [0, 1, 2] and all(edges[i][1] < edges[i + 1][0] for i in (0, 1))
    got = oof.groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in got} == {r.fold: r["count"] for r in rows.where("fold > 0").groupBy("fold").count().collect()}
    # prices of a fold and later ones don't reach the models that predict it
    moved = rows.withColumn("sold_price", F.when(F.col("fold") == 2, F.col("sold_price") * 9).otherwise(F.col("sold_price")))
    segments = tiers.Segments.of(rows)
    told = []
    for source in (rows, moved):
        fitted = tiers._fit_all(source, segments, {2: F.col("fold") < 2}, 1)
        told.append({r.listing_key: r.by_base for r in tiers.experts(rows.where("fold = 2"), *fitted[2]).collect()})
    assert told[0] == told[1] and told[0]


def test_model_predicts_and_calibrates(made):
    rows, t, oof = made
    assert sum(t.weights["all"]) == tiers.UNITS and set(t.weights) == {"all", "low", "mid", "high"}
    got = tiers.apply(t, rows)
    r = got.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("predicted") >= 0, 1)).alias("ok"), F.avg(F.abs(F.col("predicted") - F.col("sold_price"))).alias("mae"), F.avg(F.abs(F.lit(0) - F.col("sold_price"))).alias("zero")).first()
    assert r.n == r.ok == rows.count() and r.mae < r.zero


def test_calibrator_isnt_worse_on_rows_that_it_hasnt_seen(spark):
    # a blend that is a tenth too low in one gate
    rng = np.random.default_rng(1)
    prices = rng.uniform(50, 150, 900)
    rows = [(float(p), float(p * (0.9 if p > 100 else 1.0)), "high" if p > 100 else "low", "a", "b", 50.0, 2.0, i % 3 + 1) for i, p in enumerate(prices)]
    oof = spark.createDataFrame(rows, "sold_price double, blended double, gate string, area string, size_band string, living_area double, area_p50 double, fold int")
    segments = tiers.Segments(most=50.0, share=0.2, least=0.0)
    model = tiers.proven_calibrator(oof.where("fold < 3"), segments, 2)
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("sold_price")))
    r = tiers.corrected(model, segments, oof.where("fold = 3")).agg(mae("predicted").alias("a"), mae("blended").alias("b")).first()
    assert model is not None and r.a < 0.7 * r.b
    assert tiers.fit_calibrator(oof.withColumn("blended", F.col("sold_price"))) is None
    noise = oof.withColumn("blended", F.col("sold_price") + F.when(F.col("fold") == 3, -5.0).otherwise(5.0))
    assert tiers.proven_calibrator(noise, segments, 3) is None


def test_weights_equal_trying_all(spark):
    rng = np.random.default_rng(4)
    rows = [(int(y), *(int(y + e) for e in rng.integers(-30, 31, 4)), ["low", "mid", None][i % 3]) for i, y in enumerate(rng.integers(100, 999, 60))]
    df = spark.createDataFrame(rows, "y long, a long, b long, c long, d long, gate string").repartition(3)
    got = {r.gate: r for r in P.best_experts(df, "y", ["a", "b", "c", "d"], "gate", units=4, least=15).collect()}
    for gate, own in (("all", rows), ("low", [r for r in rows if r[5] == "low"])):
        errors = {w: sum(abs(sum(u * x for u, x in zip(w, r[1:5], strict=True)) - 4 * r[0]) for r in own) for w in itertools.product(range(5), repeat=4) if sum(w) == 4}
        best = min(errors, key=lambda w: (errors[w], w))
        assert tuple(got[gate].units) == best and got[gate].mae == pytest.approx(errors[best] / len(own) / 4) and not got[gate].fallback
    assert got["high"].fallback and got["high"].units == got["all"].units and got["high"].n == 0 and got["high"].mae is None


def test_compositions():
    assert len(P.compositions(20, 4)) == math.comb(23, 3) and P.compositions(2, 2) == [(0, 2), (1, 1), (2, 0)]


@pytest.mark.parametrize(
    ("config", "name", "says"),
    [
        ({"a": {"numeric": ["nope"], "categorical": []}}, "a", "unknown numeric features: nope"),
        ({"a": {"numeric": ["rooms", "rooms"], "categorical": []}}, "a", "repeats: rooms"),
        ({"a": {"numeric": "rooms", "categorical": []}}, "a", "must have a list"),
        ({"a": {"numeric": [1], "categorical": []}}, "a", "names only"),
        ({"a": {"numeric": [" rooms"], "categorical": []}}, "a", "names only"),
        ({"a": {"numeric": [], "categorical": []}}, "a", "empty"),
        ({"a": []}, "a", "must have a list"), ({}, "b", "unknown subset"), ({}, None, "no default"), ([], "a", "must be a mapping"),
    ],
)
def test_subsets_are_checked(config, name, says):
    with pytest.raises(ValueError, match=says):
        G.subset(name, config)


def test_subsets_and_specs():
    assert G.subset() == G.subset("no_list_price") and G.subset("full")[0] == list(G.NUMERIC)
    assert "listing_price" in G.subset("with_list_price")[0] and not G.ASKING.intersection(G.subset()[0])
    with pytest.raises(ValueError, match="signals of the asking price"):
        G.Spec("x", "with_list_price", False).check()
    with pytest.raises(ValueError, match="lacks listing_price"):
        G.Spec("x", "compact", True).check()


def test_matrix_fills_with_the_contexts_medians(spark):
    df = spark.createDataFrame([("1", 2.0, "x"), ("3", None, None), ("bad", float("nan"), "y"), ("5", 8.0, "x")], "rooms string, floor double, area string")
    context = G.fit_context(df, ["rooms", "floor", "energy"], ["area", "era"])
    rows = [tuple(r) for r in G.matrix(df, ["rooms", "floor", "energy"], ["area", "era"], context).collect()]
    assert context.numeric == {"rooms": 3.0, "floor": 2.0}
    assert rows == [(1.0, 2.0, 0.0, "x", "unknown"), (3.0, 2.0, 0.0, "unknown", "unknown"), (3.0, 2.0, 0.0, "y", "unknown"), (5.0, 8.0, 0.0, "x", "unknown")]
    assert G.matrix(df.limit(0), ["rooms"], [], G.fit_context(df.limit(0), ["rooms"], [])).count() == 0


def test_search_is_repeatable_and_finds_low_ground():
    space = {"x": tuning.Range(0.01, 10, log=True), "y": tuning.Range(-5, 5), "k": tuning.Range(1, 9, whole=True)}
    hill = lambda v: (math.log(v["x"]) - 1) ** 2 + (v["y"] - 2) ** 2 + (v["k"] - 3) ** 2
    a, b = tuning.search(hill, space, 60, 3, seed=5), tuning.search(hill, space, 60, 3, seed=5)
    assert a == b and a != tuning.search(hill, space, 60, 3, seed=6)
    assert all(0.01 <= v["x"] <= 10 and isinstance(v["k"], int) and 1 <= v["k"] <= 9 for v, _ in a)
    late, early = np.mean([s for _, s in a[-20:]]), np.mean([s for _, s in a[:6]])
    assert late < 0.5 * early and min(s for _, s in a) < 2


def test_tuning_trees_over_folds(made):
    rows = made[0]
    space = {"maxDepth": tuning.Range(1, 3, whole=True), "maxIter": tuning.Range(1, 2, whole=True)}
    values, error = tuning.tune(rows, 2, space, trials=5, at_once=5, seed=3)
    assert set(values) == set(space) and 0 < error < math.inf and tuning.fold_error(rows, values, 2) == pytest.approx(error)


def test_mutual_information_is_near_what_counts_of_all_rows_give(spark):
    rng = np.random.default_rng(2)
    x, noise = rng.normal(size=(2, 20_000))
    rows = [(float(a), float(0.8 * a + 0.6 * b), "u" if a > 0 else "v", float(b)) for a, b in zip(x, noise, strict=True)] + [(None, 1.0, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, s string, z double")
    got = {r.column_name: r for r in P.mutual_information(df, ["x", "s", "z"], "y", 64).collect()}
    exact = -0.5 * math.log(1 - 0.8**2)  # of two normal variables with that correlation
    assert got["x"].n == 20_000 and abs(got["x"].mi - exact) < 0.02 * exact
    flag = np.digitize(0.8 * x + 0.6 * noise, np.quantile(0.8 * x + 0.6 * noise, np.linspace(0, 1, 65)[1:-1]))
    joint = np.histogram2d(x > 0, flag, bins=(2, 64))[0] / 20_000
    brute = np.nansum(joint * np.log(np.where(joint > 0, joint, 1) / np.outer(joint.sum(1), joint.sum(0)))) - 63 / 40_000
    assert abs(got["s"].mi - brute) < 0.02 * brute
    assert P.mutual_information(df.limit(0), ["x"], "y").first().mi in (None, 0.0)
