"""The divergence audit and delta Lloyd against their SQL and brute force, on edge cases too."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from parcelyard.llm import delta_lloyd, divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n long, p long, value long, rank int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2, 3, 4) for i, (t, lang, s) in enumerate(rows)], DOCS)


def by_sql(query, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con.sql(query)


def audited(spark, rows):
    got = divergence.audit(documents(spark, rows))
    table = pa.table({"text": pa.array([r[0] for r in rows], pa.string()), "lang": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string())})
    want = by_sql(divergence.ORACLE, documents=table)
    assert got.columns == want.columns
    a, b = sorted(map(tuple, got.collect())), sorted(want.fetchall())
    assert a == b
    return a


def test_audit_equals_sql_on_edges(spark):
    rng = random.Random(5)
    words = ["the", "The", "été", "x", "日本", "ab", "Q", "don", "İ", "ß", "zz"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", ".", "1", "\x00", "_"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "é", None])) for _ in range(90)]
    rows += [(None, "en", "a"), ("", "en", "quiet"), (None, None, None), ("alone alone", "xx", "only"), ("one two", "yy", "s1"), ("three", "yy", "s2")]
    rows += [("same text here", "zz", "s")] * 4 + [("same same " * 60_000, "zz", "t")] + [("long text " * 30_000, "en", "b")] * 2
    got = audited(spark, rows)
    assert {r[4] for r in got if r[0] == "yy"} == {0} and sum(r[0] == "yy" for r in got) == 2  # no kept term: pairs of value 0
    assert not [r for r in got if r[0] == "xx"]  # a source alone has no pair
    assert any(r[2] == "pair" and r[1] == "quiet" and r[4] > 0 for r in got)


def test_audit_ranks_at_most_top_terms_and_no_rows(spark):
    rows = [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)), "en", "many")] * 3 + [("other words", "en", "few")] * 3
    got = audited(spark, rows)
    assert max(r[5] for r in got if r[1] == "many" and r[2] == "term") == 200
    assert divergence.audit(documents(spark, [])).count() == 0


def test_texts_are_counted_alike_in_any_batches(spark, monkeypatch):
    rows = [(f"a b c{'d' * (i % 3)} a", "en", f"s{i % 4}") for i in range(40)]
    whole = sorted(map(tuple, divergence.audit(documents(spark, rows)).collect()))
    parts = [b for b in pa.Table.from_pylist([{"text": t, "lang": lang, "source": s} for t, lang, s in rows]).to_batches()]
    monkeypatch.setattr(divergence, "BATCH_CHARS", 20)
    counted = pa.Table.from_batches(list(divergence._count_terms(iter(parts)))).to_pylist()
    assert len(whole) == len(audited(spark, rows)) and sum(r["n"] for r in counted if r["term"] == "a") == 80


VECTORS = "vec_id long, embedding array<float>, key string, v int, cluster int, distance string"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1, 2, "d") for i, v in rows], VECTORS)


def lloyd(rows):
    """Plain Lloyd over whole vectors with Python's integers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:40]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(5):
        owners = [nearest(v)[1] for _, v in kept]
        means = [[v for (_, v), o in zip(kept, owners, strict=True) if o == j] for j in range(len(centers))]
        centers = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else centers[j] for j, m in enumerate(means)]
    final = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, o, d in final if o == j) for j in range(len(centers))}
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[o])).encode()).hexdigest()) for i, o, d in final), key=repr)


def test_clusters_equal_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.05, (50, 64))
    rows = [(i, (middle[i % 50] + rng.normal(0, 0.03, 64)).tolist()) for i in range(220)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (None, [0.0] * 64)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None, *[1.0] * 63]), (405, [float("nan"), *[1.0] * 63]), (406, [float("inf"), *[1.0] * 63]), (407, [1e5, *[-1e5] * 63])]
    got = delta_lloyd.cluster(embeddings(spark, rows).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows)


def test_few_equal_or_no_vectors(spark):
    assert delta_lloyd.cluster(embeddings(spark, [])).count() == 0
    assert delta_lloyd.cluster(embeddings(spark, [(1, None)])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same = [(i, [0.5] * 64) for i in range(60)]
    rows = delta_lloyd.cluster(embeddings(spark, same)).collect()
    assert len(rows) == 60 and {(r.cluster, r.distance, r.inertia) for r in rows} == {(0, 0, 0)}
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted((tuple(r) for r in delta_lloyd.cluster(embeddings(spark, few)).collect()), key=repr) == lloyd(few)


def test_reassigning_equals_comparing_with_all():
    rng = np.random.default_rng(9)
    for _ in range(30):
        x, old = rng.integers(-4, 5, (200, 3)), rng.integers(-4, 5, (12, 3))
        new = np.where((rng.random(12) < 0.5)[:, None], rng.integers(-4, 5, (12, 3)), old)
        d = delta_lloyd._distances(x, old)
        now, far = delta_lloyd.reassign(x, d.argmin(1), d.min(1), new, (new != old).any(1))
        full = delta_lloyd._distances(x, new)
        assert (now == full.argmin(1)).all() and (far == full.min(1)).all()


def test_a_component_too_large_for_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="fit a long"):
        delta_lloyd.cluster(embeddings(spark, [(1, [1e30] * 64)])).collect()
