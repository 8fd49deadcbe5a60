"""What keeps tasks small and jobs few on large tables."""

import datetime as dt
import tracemalloc

import numpy as np
import pytest

from parcelyard.operators import quantiles as Q
from parcelyard.plans import catalog, comparables, features, market, reports, serving, tiers  # noqa: F401
from parcelyard.sources.listings import listings

DATA = "/root/testdata/sf0.001"


def test_ranks_hold_one_level_at_a_time():
    rng = np.random.default_rng(1)
    values, weights = rng.random(200_000), np.ones(200_000, np.int64)
    tracemalloc.start()
    ranked = Q.Ranked(values, weights)
    assert ranked.at(np.array([0]), np.array([len(values)]), np.array([10]))[0] == np.sort(values)[10]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * 8 * len(values)


@pytest.mark.parametrize("name", ["prior_area_quad", "prior_address_native", "prior_global", "temporal_volumes", "area_market_prior", "prior_area_size_fallback", "mutual_information", "expert_weights_by_gate"])
def test_listings_are_made_once(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_chain_reads_what_it_has_written(spark):
    plan = features.features(listings(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_many_large_keys_of_two_columns(spark, monkeypatch):
    """Keys cut into ranges, several in a batch and some in more than one; a key without values among them."""
    monkeypatch.setattr(Q, "BATCH", 7)
    rng = np.random.default_rng(2)
    day = dt.date(2020, 1, 1)
    rows = [(f"k{i % 3}", i % 2, day + dt.timedelta(int(rng.integers(0, 30))), None if i % 3 == 2 and i % 2 else float(rng.integers(0, 900)) / 7) for i in range(1500)]
    df = spark.createDataFrame(rows, "d string, v int, q date, n double")
    got = Q.window_quantiles(df, ["d", "v"], "q", "n", {"all": None, "w9": 9}, [0.1, 0.75], 40).collect()
    assert len(got) == len({r[:3] for r in rows})
    for r in got:
        for name, back in {"all": None, "w9": 9}.items():
            own = [x for d, v, q, x in rows if (d, v) == (r.d, r.v) and q < r.q and (back is None or (r.q - q).days <= back)]
            known = [x for x in own if x is not None]
            assert (r[f"{name}_rows"], r[f"{name}_n"]) == (len(own), len(known))
            for i, p in enumerate((0.1, 0.75)):
                assert r[f"{name}_q{i}"] == (pytest.approx(np.quantile(known, p)) if known else None)


@pytest.mark.parametrize("most", [0, 10_000])
def test_ranges_of_large_keys_are_found_and_written_once(spark, monkeypatch, most):
    """Ties, nulls, a NaN and a key without values, by edges that tasks hold or that go with the rows."""
    monkeypatch.setattr(Q, "BROADCAST_KEYS", most)
    rows = [(k, i, None if k == "c" or i % 50 == 0 else float("nan") if i == 7 else float(i % 600) / 3) for k in "abc" for i in range(2_000)]
    counted = spark.createDataFrame(rows, "k0 string, d int, v double").selectExpr("struct(k0) k", "d", "v", "1L n")
    edges = {"a": [1.0, 5.0, 5.0, 90.0], "b": [i / 3 for i in range(255)], "c": None}
    table = spark.createDataFrame([(k, e, i * 7) for i, (k, e) in enumerate(edges.items())], "k0 string, edges array<double>, id long").selectExpr("struct(k0) k", "edges", "id")
    cut = Q._ranged(counted, table, "k0 string", 3)
    assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k0, r.d): (r.v, r.r) for r in cut.collect()}
    assert len(got) == len(rows)
    for k, d, v in rows:
        r = got[k, d][1]
        assert r == (-1 if v is None else sum(e <= v or v != v for e in edges[k])), (k, d, v)


def test_tasks_give_arrows_reserve_back(monkeypatch):
    calls = []
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(1)})()
    monkeypatch.setattr(Q.pa, "default_memory_pool", lambda: pool)
    batches = [Q.pa.RecordBatch.from_pydict({"k0": [k] * 10, "d": list(range(10))}) for k in "aabbc"]
    monkeypatch.setattr(Q, "BATCH", 15)
    assert sum(t.num_rows for t, _ in Q._whole_groups(iter(batches), ["k0"])) == 50
    assert len(calls) >= 2
