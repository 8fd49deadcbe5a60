"""What joins broadcast unasked, which the driver has to hold."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from parcelyard.llm import common, line_dedup, simhash

DATA = "/root/testdata/sf0.001"
MEASURED = "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def guesses(spark):
    """A session in which what a shuffle has measured is large, so that Spark's guesses alone may broadcast."""
    spark.conf.set(MEASURED, "1")
    yield spark
    spark.conf.unset(MEASURED)


def ran(df):
    """df's rows and the plan that ran."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_signatures_are_not_broadcast(guesses, tmp_path):
    """64 rows for each fingerprint of a table whose file is small."""
    fps = [i * 0x9E3779B97F4A7C15 % 2**62 for i in range(1, 301)]
    fps += [x ^ 0b1011 for x in fps[:20]]
    guesses.createDataFrame([(x,) for x in fps], "fp long").write.parquet(f"{tmp_path}/fps")
    links, plan = ran(simhash.links(guesses.read.parquet(f"{tmp_path}/fps")))
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
    assert {frozenset(r) for r in links} == {frozenset((x, x ^ 0b1011)) for x in fps[:20]}


def test_rows_are_not_broadcast_for_their_components(guesses):
    docs = guesses.read.parquet(f"{DATA}/documents.parquet")
    rows, plan = ran(simhash.near_duplicates(docs))
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
    assert len(rows) == docs.count()


def plans_of(monkeypatch, module, name):
    """The plans, before they run, of tables of that name which the module writes."""
    found, write = [], module.saved

    def saved(df, called):
        if called == name:
            found.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, called)

    monkeypatch.setattr(module, "saved", saved)
    return found


def test_lines_are_not_broadcast_for_their_pairs(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lines = plans_of(monkeypatch, line_dedup, "unequal-middles")
    pipeline.lines(spark, docs, DATA)
    assert [x.count("Broadcast") for x in lines] == [0]


def test_a_table_counted_as_large_is_shuffled(guesses, monkeypatch, tmp_path):
    """And so are the exploded rows that meet it."""
    guesses.range(50).withColumn("ks", F.sequence("id", F.col("id") + 40)).write.parquet(f"{tmp_path}/rows")
    guesses.range(20, 40).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/wanted")
    rows, wanted = guesses.read.parquet(f"{tmp_path}/rows").select("id", F.explode("ks").alias("k")), guesses.read.parquet(f"{tmp_path}/wanted")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 19)
    met, plan = ran(common.looked_up(rows, wanted, "k"))
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, met)) == sorted((k, i) for i in range(50) for k in range(i, i + 41) if 20 <= k < 40)


def test_lines_counted_as_many_are_shuffled(guesses, monkeypatch):
    """Those that are everywhere alone are broadcast, for the rows that have them and for the others."""
    docs = guesses.createDataFrame([(i, f"one line\nother {i // 2}") for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "KNOWN_ROWS", 0)
    monkeypatch.setattr(line_dedup, "HOT", 0.3)
    places, known = line_dedup._classes(line_dedup.lines_of(docs), "doc_id", 2, 15, 30)
    told, plan = ran(line_dedup._told(places, known))
    assert plan.count("SortMergeJoin") == 1
    assert sorted((r.doc_id, r.line_no, r.n) for r in told) == sorted((i, k, [40, 2][k]) for i in range(40) for k in range(2))


def test_a_stage_that_keeps_nothing_drops_what_was_kept():
    common.kept_in_worker(("parser", 1), lambda: "a parser")
    common.keep_nothing()
    assert common.kept_in_worker(("parser", 1), lambda: "another") == "another"
    common.keep_nothing()
