"""Statistics that a row of day D may see: rows dated strictly before D, never the same day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from parcelyard.operators.quantiles import window_quantiles
from parcelyard.tables import met, written


def prior(keys: Sequence[str], day: str, days: int | None = None) -> WindowSpec:
    """Rows of the key dated before the row's day, at most `days` before."""
    return W.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(W.unboundedPreceding if days is None else -days, -1)


def _seen(name: str) -> Column:
    """Values counted before a day; null, not 0, if there is no row at all."""
    return F.when(F.col(f"{name}_rows") > 0, F.col(f"{name}_n"))


def trailing(df: DataFrame, key: str, day: str, value: str, windows: Sequence[int]) -> DataFrame:
    """Median and count of value over the trailing days, the row's own day excluded."""
    t = window_quantiles(df, [key], day, value, {f"w{n}": n for n in windows}, [0.5])
    return met(df, t.select(key, day, *[c for n in windows for c in (F.col(f"w{n}_q0").alias(f"median_{n}"), _seen(f"w{n}").alias(f"count_{n}"))]), [key, day])


def prior_market(df: DataFrame, key: str, day: str, price: str, dom: str, change: str) -> DataFrame:
    """df with what the days before tell of a key: inventory (prices), median and deviation of price, median days on market, mean and count of price changes."""
    return met(df, market_by_day(df, key, day, price, dom, change), [key, day])


def market_by_day(df: DataFrame, key: str, day: str, price: str, dom: str, change: str) -> DataFrame:
    """The columns that `prior_market` adds, for each key and day once.

    Sums are taken by day first, so that a large key has a row a day in its window.
    """
    x, y = F.col(price), F.col(change)
    by_day = df.groupBy(key, day).agg(F.count(price).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count(change).alias("cn"), F.sum(y).alias("cs"))
    w = prior([key], day)
    t = by_day.select(key, day, *[F.sum(c).over(w).alias(c) for c in ("n", "s", "q", "cn", "cs")])
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    var = F.when(n > 1, (q - s * s / n) / (n - 1))
    t = t.select(key, day, F.sqrt(F.when(var < 0, 0.0).otherwise(var)).alias("price_volatility"), F.when(F.col("cn") > 0, F.col("cs") / F.col("cn")).alias("price_change_mean"), F.col("cn").alias("price_change_count"))
    medians = window_quantiles(df, [key], day, price, {"p": None}, [0.5]).select(key, day, _seen("p").alias("inventory"), F.col("p_q0").alias("price_median"))
    doms = window_quantiles(df, [key], day, dom, {"d": None}, [0.5]).select(key, day, F.col("d_q0").alias("dom_median"))
    return medians.join(t, [key, day], "left").join(doms, [key, day], "left")


def prior_quantiles(df: DataFrame, keys: str | Sequence[str], day: str, value: str) -> DataFrame:
    """Exact p50, p75, p90 and count of value before each day of each key: keys, day, p50, p75, p90, n (null if no row is dated before)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    t = window_quantiles(df, keys, day, value, {"p": None}, [0.5, 0.75, 0.9])
    return t.select(*keys, day, F.col("p_q0").alias("p50"), F.col("p_q1").alias("p75"), F.col("p_q2").alias("p90"), _seen("p").alias("n"))


def native_prior_quantiles(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """df with p50, p75, p90 and n by a window that sorts every prefix anew: for keys of few rows, and to check the other by."""
    w = prior(keys, day)
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).over(w)
    n = F.when(F.count(F.lit(1)).over(w) > 0, F.count(value).over(w))
    return df.withColumn("_q", q).withColumn("n", n).select(*df.columns, F.col("_q")[0].alias("p50"), F.col("_q")[1].alias("p75"), F.col("_q")[2].alias("p90"), "n")


def target_mean(df: DataFrame, key: str, day: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """(prior sum + smoothing * overall mean) / (prior count + smoothing), by daily sums."""
    return df.join(target_mean_by_day(df, key, day, target, smoothing), [key, day], "left")


def target_mean_by_day(df: DataFrame, key: str, day: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """The column encoded that `target_mean` adds, for each key and day once."""
    mean = df.agg(F.avg(target).alias("mu"))
    daily = df.groupBy(key, day).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    w = W.partitionBy(key).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    t = daily.select(key, day, F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"))
    return t.crossJoin(F.broadcast(mean)).select(key, day, ((F.col("s") + smoothing * F.col("mu")) / (F.col("n") + smoothing)).alias("encoded"))


def month_spine(df: DataFrame, day: str) -> DataFrame:
    """Every month from the first to the last, as column month (one row a month)."""
    ends = df.agg(F.trunc(F.min(day), "MM").alias("a"), F.trunc(F.max(day), "MM").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def fill_forward(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Last known value so far, by keys. For series of a row a month, so one window without keys is small."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key strictly before it."""
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_left"), F.struct(*values).alias("_v"))
    cols = [c for c in left.columns if c not in keys]
    r = r.withColumns({f"_l_{c}": F.lit(None).cast(t) for c, t in left.dtypes if c in cols})
    x = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_left"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), *[F.col(c).alias(f"_l_{c}") for c in cols])
    w = W.partitionBy(*keys).orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    both = x.unionByName(r).withColumn("_at", F.struct(F.col("_at"), 1 - F.col("_left")))  # left rows come first among equals
    both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left = 1")
    return both.select(*keys, *[F.col(f"_l_{c}").alias(c) for c in cols], *[F.col(f"_v.{v}").alias(v) for v in values])


def temporal_split(df: DataFrame, day: str, test: float = 0.2) -> DataFrame:
    """is_train: dated strictly before the day at position int(n * (1 - test)) of the days in order.

    Found from counts by day, so no row is ranked against all others.
    """
    by_day = df.where(F.col(day).isNotNull()).groupBy(day).count()
    w = W.orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    runs = by_day.select(day, F.sum("count").over(w).alias("upto"), F.sum("count").over(W.partitionBy()).alias("total"))
    edge = runs.where(F.col("upto") > F.floor(F.col("total") * (1 - test))).agg(F.min(day).alias("_edge"))
    return df.crossJoin(F.broadcast(edge)).withColumn("is_train", F.col(day) < F.col("_edge")).drop("_edge")


def folds(df: DataFrame, day: str, tie: str, k: int) -> DataFrame:
    """fold 0..k of expanding splits by day, then tie: fold i tests on its rows and trains on all before; 0 only trains.

    A row's place is its day's first place plus its place within the day. Most
    days lie in one fold; only rows of the up to k days in which a fold begins
    are sorted, and no other row is shuffled.
    """
    before = W.orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    runs = df.groupBy(day).count().select(day, "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"), F.sum("count").over(W.partitionBy()).alias("_n"))
    size = F.greatest(F.floor(F.col("_n") / (k + 1)), F.lit(1))
    at = lambda place: F.greatest(F.lit(0), k - F.floor((F.col("_n") - place) / size)).cast("int")
    starts = written(runs.select("*", at(F.col("_first") + 1).alias("fold"), at(F.col("_first") + F.col("count")).alias("_last")), "days")  # a row a day
    whole = df.join(F.broadcast(starts.where("fold = _last").select(day, "fold")), day)
    cut = df.join(F.broadcast(starts.where("fold < _last").select(day, "_first", "_n")), day)
    cut = cut.withColumn("fold", at(F.col("_first") + F.row_number().over(W.partitionBy(day).orderBy(tie)))).drop("_first", "_n")
    return whole.unionByName(cut)
