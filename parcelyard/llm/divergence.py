"""Audit of how far the sources of a language differ in their terms: DuckDB counts in shards, Spark merges."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelyard.llm.common import looked_up, saved

#: Terms are runs of ASCII letters and of all characters beyond ASCII.
TERM = r"[^\x00-@\[-`{-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term is kept by a language if so many of its documents have it; so many terms of a group are ranked.
LEAST_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
#: Characters of text that one SQL statement of a task counts; a longer text is counted alone.
BATCH_CHARS = 4_000_000
#: What DuckDB may hold in a task; beyond it, it spills to the task's own temporary folder, which goes with the statement.
DUCKDB_MEMORY = "384MB"

_COUNT = f"""
WITH found AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM batch),
in_doc AS (SELECT any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n FROM found GROUP BY doc, term)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM in_doc GROUP BY ALL"""

_KEEP = """
WITH all_sources AS (SELECT *, sum(docs) OVER w AS in_docs, sum(n) OVER w AS in_lang, row_number() OVER (PARTITION BY lang, term ORDER BY source) AS place
                     FROM batch WINDOW w AS (PARTITION BY lang, term))
SELECT lang, source, term, n, in_lang::BIGINT AS in_lang, (place = 1)::INT AS first FROM all_sources WHERE in_docs >= {least}"""

#: a's terms against b's where both have the term, less what the sums of each alone count for it; and a's best terms.
_COMPARE = """
WITH pairs AS (
  SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item,
         sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.none) * (a.p - b.none) // b.none
             - (a.none - b.p) * (a.none - b.p) // b.p + (a.none - b.none) * (a.none - b.none) // b.none)::DECIMAL(38, 0) AS value
  FROM batch a JOIN batch b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::DECIMAL(38, 0) AS value FROM batch WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top})
SELECT * FROM pairs UNION ALL SELECT * FROM terms"""


def _sql(query: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a statement over the rows that come, as table `batch`."""
    import duckdb

    first = next(batches, None)
    if first is None:
        return

    def rows() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    with tempfile.TemporaryDirectory() as scratch:
        con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": scratch, "preserve_insertion_order": False})
        try:
            con.register("incoming", pa.RecordBatchReader.from_batches(first.schema, rows()))
            con.execute("CREATE TABLE batch AS FROM incoming")
            yield from con.sql(query).to_arrow_reader(100_000)
        finally:
            con.close()


def _in_shards(query: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _sql(query, batches)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        sizes = [len(t) for t in b.column("text").to_pylist()]
        while at < b.num_rows:
            end, held = at, 0
            while end < b.num_rows and (end == at or held + sizes[end] <= BATCH_CHARS):
                held += sizes[end]
                end += 1
            part = b.slice(at, end - at)
            numbered = pa.RecordBatch.from_arrays([*part.columns, pa.array(range(end - at), pa.int64())], [*part.schema.names, "doc"])
            yield from _sql(_COUNT, iter([numbered]))
            at = end


def _probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.call_function("div", up, (total + terms).cast("decimal(19,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q), exact."""
    return F.call_function("div", (p - q) * (p - q), q)


def _times(n: Column, value: Column) -> Column:
    return n.cast("decimal(17,0)") * value.cast("decimal(20,0)")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms.

    Null text, lang and source read as ''. Every row is a document of its own,
    repeated rows too. A source without terms is a source; a language without a
    kept term gives its pairs the value 0; a source alone in its language has
    no pair; no rows give none. Equal values are ranked by item, in the order of
    UTF-8. Other columns are ignored.

    Documents are counted by SQL statements of some million characters, Spark
    adds up (lang, source, term). Shards by hash of (lang, term) hold a term's
    counts of all sources: SQL keeps terms, then sums what each two sources
    differ in where both have the term. What they differ in elsewhere follows
    from how often each count occurs in a source, so no term meets the sources
    that lack it. Numbers stay whole throughout.
    """
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))))
    counted = own.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    shards = summed.repartition("lang", "term")
    kept = saved(shards.mapInArrow(_in_shards(_KEEP.format(least=least)), "lang string, source string, term string, n long, in_lang long, first int"), "terms-kept")

    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("first").cast("long").alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = own.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs")).join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("group_n", "all_n", "v")))
    none = F.when(F.col("v") > 0, _probability(F.lit(0), F.col("group_n"), F.col("v")))
    groups = saved(groups.withColumn("none", none), "term-groups")

    rated = looked_up(kept, groups, ["lang", "source"])
    rated = rated.select("lang", "source", "term", "n", _probability(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), "none", _probability(F.col("in_lang"), F.col("all_n"), F.col("v")).alias("q"))
    compared = rated.select("lang", "source", "term", "p", "none", "q").repartition("lang", "term")
    partial = saved(compared.mapInArrow(_in_shards(_COMPARE.format(top=top)), "lang string, source string, part string, item string, value decimal(38,0)"), "term-sums")

    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    spread = rated.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("n"))
    met = spread.join(other, "lang").where("source <> item")
    differs, back = (_times(F.col("n"), f) for f in (_apart(F.col("p"), F.col("item_none")) - _apart(F.col("none"), F.col("item_none")), _apart(F.col("item_none"), F.col("p")) - _apart(F.col("item_none"), F.col("none"))))
    both_ways = F.explode(F.array(F.struct("source", "item", differs.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.alias("value"))))
    alone = met.select("lang", both_ways.alias("w")).select("lang", "w.*")
    without = F.when(F.col("v") > 0, _times(F.col("v"), _apart(F.col("none"), F.col("item_none")))).otherwise(F.lit(0))
    everywhere = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", without.cast("decimal(38,0)").alias("value"))
    shared = partial.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = shared.unionByName(alone.withColumn("value", F.col("value").cast("decimal(38,0)"))).unionByName(everywhere)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = partial.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


#: The same over the whole table, every term met with every source of its language.
ORACLE = f"""
WITH own AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM own),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM own),
rated AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + v.v))::BIGINT AS p,
                 (1 + {SCALE}::HUGEINT * (k.n + 1) // (v.n + v.v))::BIGINT AS q
          FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM rated WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
