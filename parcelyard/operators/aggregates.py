"""Grouped statistics of reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.tables import written


def median(x: str | Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def quad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, p75, p90 and count of value by keys, from one exact percentile pass."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("q"), F.count(value).alias("n"))
    return q.select(*keys, F.col("q")[0].alias("p50"), F.col("q")[1].alias("p75"), F.col("q")[2].alias("p90"), "n")


#: Ranges of values among which a quantile of all rows is looked for.
RANGES = 256


def overall_quantiles(df: DataFrame, value: str, qs: Sequence[float]) -> DataFrame:
    """One row with q, the exact quantiles of a column over all rows, no task of which holds all values.

    Values are counted; counts of ranges between approximate quantiles tell
    which ranges hold the wanted ranks, and only there counts are run up.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "value-counts")  # read for the edges, the ranges and the wanted ones
    edges = counts.agg(F.coalesce(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10_000), F.array().cast("array<double>")).alias("e"))
    cut = counts.crossJoin(F.broadcast(edges)).select("v", "n", F.size(F.filter("e", lambda e: e < F.col("v"))).alias("r"))
    w = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)  # (RANGES rows)
    sums = cut.groupBy("r").agg(F.sum("n").alias("m")).select("r", "m", F.coalesce(F.sum("m").over(w), F.lit(0)).alias("base"), F.sum("m").over(W.partitionBy()).alias("total"))
    at = [F.lit(float(q)) * (F.col("total") - 1) for q in qs]
    ends = F.array(*[x for a in at for x in (F.floor(a + 1e-12), F.ceil(a - 1e-12))])
    wanted = sums.select("r", "base", "total", F.posexplode(ends).alias("i", "rank")).where("rank >= base and rank < base + m")
    run = W.partitionBy("r").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    near = cut.join(F.broadcast(wanted.select("r").distinct()), "r", "left_semi").withColumn("upto", F.sum("n").over(run))
    got = near.join(F.broadcast(wanted), "r").where((F.col("rank") < F.col("base") + F.col("upto")) & (F.col("rank") >= F.col("base") + F.col("upto") - F.col("n")))
    found = got.agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"x{i}") for i in range(2 * len(qs))], F.max("total").alias("total"))
    part = lambda q: F.greatest(F.lit(0.0), F.lit(float(q)) * (F.col("total") - 1) - F.floor(F.lit(float(q)) * (F.col("total") - 1) + 1e-12))
    return found.select(F.array(*[F.col(f"x{2 * i}") + (F.col(f"x{2 * i + 1}") - F.col(f"x{2 * i}")) * part(q) for i, q in enumerate(qs)]).alias("q"))


def overall_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column over all rows, under its own name; no task holds all values of one."""
    out = None
    for c in columns:
        m = overall_quantiles(df.select(c), c, [0.5]).select(F.col("q")[0].alias(c))
        out = m if out is None else out.crossJoin(F.broadcast(m))  # one row each
    return out


def middles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name and middle: the exact median of each column over all rows (of an even number the lower one); columns without a value have no row.

    As `overall_quantiles`, for all columns in one pass over the rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    known = df.select(F.explode(pairs).alias("x")).select("x.*").where("v is not null and not isnan(v)")
    counts = written(known.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    edges = counts.groupBy("column_name").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("e"))
    cut = counts.join(F.broadcast(edges), "column_name").select("column_name", "v", "n", F.size(F.filter("e", lambda e: e < F.col("v"))).alias("r"))
    w = W.partitionBy("column_name").orderBy("r")  # (RANGES rows)
    sums = cut.groupBy("column_name", "r").agg(F.sum("n").alias("m"))
    sums = sums.select("column_name", "r", "m", (F.sum("m").over(w) - F.col("m")).alias("base"), F.floor((F.sum("m").over(W.partitionBy("column_name")) - 1) / 2).alias("rank"))
    wanted = sums.where("rank >= base and rank < base + m").drop("m")
    near = cut.join(F.broadcast(wanted), ["column_name", "r"]).withColumn("upto", F.col("base") + F.sum("n").over(W.partitionBy("column_name", "r").orderBy("v")))
    return near.where("rank < upto and rank >= upto - n").select("column_name", F.col("v").alias("middle"))


def histogram(df: DataFrame, value: str, bins: int, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Equal bins between two quantiles of all values: bin, left edge, count; the last bin holds its right edge.

    Values beyond the quantiles aren't counted; empty bins have count 0.
    """
    ends = overall_quantiles(df, value, [low, high]).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    rows = df.select(value).crossJoin(F.broadcast(ends)).where(F.col(value).between(F.col("lo"), F.col("hi")))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("lo"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("edge"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram_report(df: DataFrame, value: str, bins: int, low: float = 0.01, high: float = 0.99, whole: bool = True) -> DataFrame:
    """One row: n, least, most and bin_width of the window between two quantiles, p1, p25, p50, p75, p99 of all values, and counts, an array.

    whole: numbers are rounded to whole ones, halves to the even one.
    """
    known = df.where(F.col(value).isNotNull())
    r = (lambda x: F.bround(x, 0)) if whole else (lambda x: F.round(x + 1e-7, 4))
    q = overall_quantiles(df, value, [0.01, 0.25, 0.5, 0.75, 0.99, low, high])
    counts = histogram(df, value, bins, low, high).groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda b: b["n"]).alias("counts"))  # bins entries
    n = known.agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("q")[6] - F.col("q")[5]) / bins
    return q.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(n)).select("n", r(F.col("q")[5]).alias("least"), r(F.col("q")[6]).alias("most"), r(width).alias("bin_width"), *[r(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((1, 25, 50, 75, 99))], "counts")


def sort_places(df: DataFrame, key: str, orders: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """df, a table of a row for each area, with the place of each row in each order (column, descending): texts without regard to case, nulls last, ties by key."""
    kinds = dict(df.dtypes)
    for name, (column, descending) in orders.items():
        c = F.lower(column) if kinds[column] == "string" else F.col(column)
        df = df.withColumn(name, F.row_number().over(W.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), key)))
    return df


def bucketed(df: DataFrame, bucket: Column, value: str, least: int = 1) -> DataFrame:
    """Median and count of value by bucket, for buckets with at least so many values."""
    rows = df.where(F.col(value).isNotNull()).select(bucket.alias("bucket"), value).where("bucket is not null")
    return rows.groupBy("bucket").agg(median(value).alias("median"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def with_and_without(df: DataFrame, flag: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Medians and counts of both arms of a flag that may be unknown, and their difference in per cent."""
    yes, no = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    t = df.groupBy(*keys).agg(median(yes).alias("median_with"), median(no).alias("median_without"), F.count(yes).alias("n_with"), F.count(no).alias("n_without"))
    return t.withColumn("diff_pct", F.try_divide((F.col("median_with") - F.col("median_without")) * 100, F.nullif("median_without", F.lit(0.0))))


def shares(x: Column) -> dict[str, Column]:
    """Shares of values above, below and at 0."""
    return {"share_over": F.avg(F.when(x > 0, 1.0).when(x <= 0, 0.0)), "share_under": F.avg(F.when(x < 0, 1.0).when(x >= 0, 0.0)), "share_at": F.avg(F.when(x == 0, 1.0).when(x != 0, 0.0))}


def overall_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row of `errors` over all rows, no task of which holds all of them for the median."""
    df = written(df.select(F.col(actual).alias("a"), F.col(predicted).alias("p")), "predictions")  # read for the median, too
    kinds = errors(F.col("a"), F.col("p"))
    rest = df.agg(*[c.alias(k) for k, c in kinds.items() if k != "median_ape"])
    ape = df.select(F.try_divide(F.abs(F.col("p") - F.col("a")), F.abs(F.nullif("a", F.lit(0.0)))).alias("ape"))
    median = overall_quantiles(ape, "ape", [0.5]).select(F.col("q")[0].alias("median_ape"))
    return rest.crossJoin(F.broadcast(median)).select(*kinds)  # one row each


def errors(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAE, RMSE, MAPE, median APE and shares within 10 and 20 per cent."""
    e = predicted - actual
    ape = F.try_divide(F.abs(e), F.abs(F.nullif(actual, F.lit(0.0))))
    return {
        "n": F.count(e), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mape": F.avg(ape), "median_ape": F.percentile(ape, F.lit(0.5)), "bias": F.avg(e),
        "within_10": F.avg(F.when(ape <= 0.1, 1.0).when(ape > 0.1, 0.0)), "within_20": F.avg(F.when(ape <= 0.2, 1.0).when(ape > 0.2, 0.0)),
    }
