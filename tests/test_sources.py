"""Files in and out, and the stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelyard.functions import strings
from parcelyard.operators import relational
from parcelyard.operators.relational import Filter
from parcelyard.sources import files, paged, sinks
from parcelyard.streaming.prior import prior_means


def test_concatenated_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}{"id": 2}\n[{"id": 3}, 4] {"id": 5')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jsonl").write_text('{"id": 6}\n')
    got = files.json_concatenated(spark, str(tmp_path)).select(F.get_json_object("value", "$.id").alias("i")).collect()
    assert sorted(r.i for r in got) == ["1", "2", "3", "6"]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}]', '{"a": 1}\nnot json\n{"a": 2}\n'])
def test_array_or_lines(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    got = files.json_array_or_lines(spark, str(tmp_path / "x.json"), T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r.a for r in got.collect()) == [1, 2]


def test_csv_coercion(spark, tmp_path):
    (tmp_path / "x.csv").write_text("m,v\n2024-01,1.5\n2024-02,n/a\n")
    got = files.csv_reference(spark, str(tmp_path / "x.csv"), {"m": "string", "v": "double", "w": "int"}).orderBy("m").collect()
    assert [tuple(r) for r in got] == [("2024-01", 1.5, None), ("2024-02", None, None)]


def test_filters_reach_the_reader(spark):
    df = files.table_filtered(spark, "/root/testdata/sf0.001/orders.parquet", [Filter("o_totalprice", ">", 1000.0)])
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in df._jdf.queryExecution().toString()


def test_map_record(spark):
    raw = spark.createDataFrame([('{"booliId": 7, "soldPrice": {"raw": 300}, "listPrice": 250, "livingArea": {"raw": 50}}',), ('{"id": "none"}',)], "value string")
    (r,) = files.map_record(raw).collect()
    assert (r.listing_id, r.price_per_sqm, r.price_change) == ("7", 6.0, 50.0)


def test_recent_falls_back(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 29)], "d date")
    as_of = F.lit("2024-01-28").cast("date")
    assert files.recent_or_more(df, "d", as_of, 20).count() == 21 and files.recent_or_more(df, "d", as_of, 3, most=12).count() == 12


def test_staged_swap(spark):
    assert sinks.staged_swap(spark.range(5), "swap_target", 5) == 5 and spark.table("swap_target").count() == 5
    with pytest.raises(ValueError):
        sinks.staged_swap(spark.range(4), "swap_target", 5)
    assert spark.table("swap_target").count() == 5 and len([t for t in spark.catalog.listTables() if "staging" in t.name]) == 0


def test_feature_rows(spark):
    df = spark.createDataFrame([(float("nan"), "nan", dt.date(2024, 1, 2))], "x double, s string, d date")
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("d", T.DateType()), T.StructField("z", T.LongType())])
    assert tuple(sinks.feature_rows(df, schema).first()) == (None, None, "2024-01-02", None)


def test_checksum_sidecar(tmp_path):
    p = tmp_path / "m.bin"
    p.write_bytes(b"model")
    sinks.write_sha256(str(p))
    assert sinks.verify_sha256(str(p))
    p.write_bytes(b"other")
    assert not sinks.verify_sha256(str(p))


def test_stream_never_sees_its_own_day(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    spark.createDataFrame([("a", t(1, 1), 10.0), ("a", t(2, 1), 50.0), ("a", t(2, 2), 70.0), ("a", t(3, 1), 1.0)], "k string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = prior_means(stream, "k", "ts", "v").writeStream.format("memory").queryName("prior_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ts.day, r.v): (r.prior_n, r.prior_mean) for r in spark.table("prior_out").collect()}
    assert got[2, 50.0] == got[2, 70.0] == (1, 10.0) and got[3, 1.0][0] == 3 and got[1, 10.0][0] == 0


def test_swap_keeps_the_table_when_a_rename_fails(spark, monkeypatch):
    sinks.staged_swap(spark.range(5), "swap_kept")
    real = sinks._rename
    for fails in (1, 2):
        calls = []

        def rename(s, a, b):
            calls.append(a)
            if len(calls) == fails:
                raise RuntimeError("lost")
            real(s, a, b)

        monkeypatch.setattr(sinks, "_rename", rename)
        with pytest.raises(RuntimeError):
            sinks.staged_swap(spark.range(9), "swap_kept")
        assert spark.table("swap_kept").count() == 5
    monkeypatch.setattr(sinks, "_rename", real)
    assert sinks.staged_swap(spark.range(9), "swap_kept") == 9 and spark.table("swap_kept").count() == 9
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("swap_kept_")]


def test_versions_show_one_whole_table_whatever_fails(spark, tmp_path, monkeypatch):
    t = sinks.Versions(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.commit(spark.range(5), 5) == 5
    before = t.read()
    with pytest.raises(ValueError):
        t.commit(spark.range(4), 5)
    for step in ("_write", "_point"):
        with monkeypatch.context() as m:
            m.setattr(t, step, lambda *a: (_ for _ in ()).throw(RuntimeError(step)))
            with pytest.raises(RuntimeError):
                t.commit(spark.range(6))
        assert t.read().count() == 5
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1
    real = t._write

    def read_in_between(df, version):
        real(df, version)
        assert t.read().count() == 5  # a reader between write and pointer

    monkeypatch.setattr(t, "_write", read_in_between)
    assert t.commit(spark.range(7), 7) == 7 and t.read().count() == 7
    assert before.count() == 5  # one that had begun
    monkeypatch.setattr(t, "_write", real)
    t.commit(spark.range(8))
    t.commit(spark.range(9), keep=1)
    assert t.read().count() == 9 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1


def test_upsert_refuses_repeated_keys(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    source = spark.createDataFrame([("b", 20), ("c", 30), (None, 40)], "k string, v int")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(relational.upsert(target, source, "k")) == sorted([("a", 1), ("b", 20), ("c", 30), (None, 3), (None, 40)], key=repr)
    assert rows(relational.upsert(target, source, "k", insert_only=True)) == sorted([("a", 1), ("b", 2), ("c", 30), (None, 3), (None, 40)], key=repr)
    for only in (False, True):
        with pytest.raises(Exception, match="the source has a k twice: b"):
            relational.upsert(target, source.union(source.where("k = 'b'")), "k", only).collect()


RECORDS = [{"booliId": i, "soldDate": f"2024-01-{1 + i % 20:02d}", "soldPrice": 100 + i} for i in range(53)]


def test_paged_source_reads_windows_to_the_short_page(spark, tmp_path):
    records = RECORDS

    def pages(asked):
        import json
        import pathlib

        own = [r for r in records if asked["first"] <= r["soldDate"] <= asked["last"]]
        pathlib.Path(asked["log"]).joinpath(f"{asked['first']}-{asked['offset']}").write_text(json.dumps(asked))
        return [*own[asked["offset"] : asked["offset"] + asked["limit"]]]

    first, last = dt.date(2024, 1, 1), dt.date(2024, 1, 20)
    df = paged.read_paged(spark, pages, first, last, days=8, limit=7, log=str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    got = sorted(int(r.listing_id) for r in files.map_record(df).collect())
    assert got == list(range(53)) and {(r.first.day, r.last.day) for r in rows} == {(1, 8), (9, 16), (17, 20)}
    for start in (1, 9, 17):  # pages of a window: up to the short one, and an empty one after a full last one
        own = sum(r.first.day == start for r in rows)
        asked = sorted(int(p.name.rsplit("-", 1)[1]) for p in tmp_path.iterdir() if p.name.startswith(f"2024-01-{start:02d}"))
        assert own == sum(1 for r in RECORDS if start <= int(r["soldDate"][-2:]) <= start + (7 if start < 17 else 3)) and asked == [7 * i for i in range(own // 7 + 1)]
    with pytest.raises(Exception, match="more than 1 pages"):
        paged.read_paged(spark, pages, first, last, days=8, limit=7, name="paged_short", pages=1, log=str(tmp_path)).collect()
    odd = paged.read_paged(spark, lambda asked: [1, None, {"a": 1}], first, first, name="paged_odd").collect()
    assert [r.value for r in odd] == ['{"a": 1}']
    with pytest.raises(Exception, match="isn't a list"):
        paged.read_paged(spark, lambda asked: {"a": 1}, first, first, name="paged_bad").collect()


def test_csv_file(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "x", y'), (1, None), (3, "a\nb")], "i int, s string")
    assert sinks.csv_file(df, str(tmp_path / "out"), "i") == 3
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "out"))
    assert sorted((int(r.i), r.s) for r in back.collect()) == [(1, None), (2, 'say "x", y'), (3, "a\nb")]
    sinks.listings_table(spark.createDataFrame([("a", 1, dt.date(2024, 1, 2)), ("b", 2, dt.date(2024, 1, 3))], "area string, rooms int, scraped_at_date date"), str(tmp_path / "l"))
    assert sorted(p.name for p in (tmp_path / "l").iterdir() if p.is_dir()) == ["scraped_at_date=2024-01-02", "scraped_at_date=2024-01-03"]
    lines = str(tmp_path / "x.jsonl")
    assert sinks.json_lines(df, lines, "i") == 3 and sinks.json_lines(df.where("i < 3"), lines, "i", backup=True) == 2 and spark.read.json(f"{lines}.bak").count() == 3


def test_json_flat_or_deep_and_normalized(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text('{"id": 1}')
    count = lambda p: files.json_flat_or_deep(spark, str(p)).count()
    assert count(tmp_path) == 1
    (tmp_path / "b.json").write_text('{"id": 2}{"id": 3}')
    assert count(tmp_path) == 2
    with pytest.raises(FileNotFoundError):
        count(tmp_path / "none")
    rows = [("a", "59.1", "18.2", "1000", "2024-01-02", "2024-02-01"), ("a", "59.1", "18.2", "x", "bad", "2024-03-01"), ("b", None, None, None, None, "2024-01-01")]
    got = {r.listing_id: r for r in files.normalized(spark.createDataFrame(rows, "listing_id string, latitude string, longitude string, sold_price string, sold_date string, scraped_at string")).collect()}
    assert got["a"].sold_price is None and got["a"].sold_date is None and got["a"].lat == "59.1" and len(got) == 2


def test_every_letter_is_taken_apart_as_unicode_says(spark):
    import re
    import sys
    import unicodedata

    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and c != 0]
    texts = ["x".join(points[i : i + 64]) for i in range(0, len(points), 64)] + ["ŝşﬁ ė", "Ångström ½ №", "", None]

    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        return re.sub(r"[^a-z0-9]+", " ", t).strip(" ")

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", strings.plain_description(F.col("t")).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert all(got[i] == (None if t is None else plain(t)) for i, t in enumerate(texts)) and got[len(texts) - 4] == "ssfi e"
