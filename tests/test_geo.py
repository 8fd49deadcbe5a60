"""Hexagonal cells against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from parcelyard.operators import geo as G

EDGE = 300.0


def centre(q, r):
    """Metres east and north of a cell's middle."""
    return EDGE * math.sqrt(3) * (q + r / 2), EDGE * 1.5 * r


def test_a_place_is_in_the_cell_with_the_nearest_middle(spark):
    rng = random.Random(1)
    places = [(59.2 + rng.random() / 5, 17.9 + rng.random() / 5) for _ in range(400)] + [(-33.9, -151.2), (0.0, 0.0), (None, 18.0)]
    level, q, r = G.hex_parts(G.hex_cell(F.col("lat"), F.col("lon"), EDGE))
    rows = spark.createDataFrame(places, "lat double, lon double").select("lat", "lon", level.alias("level"), q.alias("q"), r.alias("r")).collect()
    for x in rows:
        if x.lat is None:
            assert x.q is None
            continue
        east, north = x.lon * G.EAST, x.lat * G.NORTH
        near = {(x.q + a, x.r + b): math.dist(centre(x.q + a, x.r + b), (east, north)) for a in range(-2, 3) for b in range(-2, 3)}
        assert x.level == 0 and min(near, key=near.get) == (x.q, x.r) and near[x.q, x.r] <= EDGE * 1.0001


def test_rings_are_the_six_nearest_and_parents_hold_seven(spark):
    own = [(q, r) for q in range(-12, 13) for r in range(-12, 13)]
    cells = spark.createDataFrame(own, "q long, r long").withColumn("cell", G._numbered(0, F.col("q"), F.col("r")))
    parent = G.hex_parent(F.col("cell"))
    rows = cells.select("q", "r", "cell", G.hex_ring(F.col("cell")).alias("ring"), parent.alias("parent"), G.hex_parent(F.col("cell"), 2).alias("grand"), G.hex_parent(parent).alias("twice")).collect()
    number = {x.cell: (x.q, x.r) for x in rows}
    middles = np.array([centre(*p) for p in own])
    for x in rows:
        if max(abs(x.q), abs(x.r)) <= 6:
            away = np.hypot(*(middles - centre(x.q, x.r)).T)
            nearest = {own[i] for i in np.argsort(away)[1:7]}
            assert {number[c] for c in x.ring} == nearest and len(set(x.ring)) == 6
            assert abs(np.sort(away)[6] - EDGE * math.sqrt(3)) < 1e-6
        assert x.grand == x.twice
    families = {}
    for x in rows:
        families.setdefault(x.parent, []).append((x.q, x.r))
    whole = [v for v in families.values() if all(max(abs(q), abs(r)) <= 9 for q, r in v)]
    assert len(whole) > 20
    for v in whole:
        hub = [m for m in v if all(abs(math.dist(centre(*m), centre(*o)) - EDGE * math.sqrt(3)) < 1e-6 for o in v if o != m)]
        assert len(v) == 7 and len(hub) == 1  # a cell and the six around it
    levels = {x.level for x in spark.createDataFrame([(rows[0].parent,)], "c long").select(G.hex_parts(F.col("c"))[0].alias("level")).collect()}
    assert levels == {1}


def test_neighbours_see_earlier_days_only(spark):
    import datetime as dt

    d = lambda n: dt.date(2024, 1, n)
    step = EDGE * math.sqrt(3) / G.EAST  # one cell to the east
    rows = [(1, 59.3, 18.0, d(5), 10.0), (2, 59.3, 18.0 + step, d(1), 40.0), (3, 59.3, 18.0 + step, d(2), 60.0), (4, 59.3, 18.0 - step, d(3), 20.0), (5, 59.3, 18.0 + step, d(5), 999.0), (6, 59.3, 18.0, d(1), 7.0), (7, None, None, d(5), 3.0)]
    got = {r.listing_key: r for r in G.neighbor_stats(spark.createDataFrame(rows, "listing_key int, lat double, lon double, day date, v double"), "day", "v", EDGE).collect()}
    assert (got[1].neighbor_p50, got[1].neighbor_n) == ((50.0 * 2 + 20.0) / 3, 3)
    assert (got[6].neighbor_p50, got[6].neighbor_n) == (None, 0) and got[7].neighbor_n == 0 and len(got) == 7
