"""Blends, gates, calibration, scores and drift as relational steps over predictions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.functions.math import clip, interpolated_normal_quantile, safe_divide
from parcelyard.tables import written


def market_normalized(price: Column, index: Column, reference: Column) -> Column:
    return safe_divide(price * reference, index)


def denormalized(x: Column, index: Column, reference: Column, fallback: Column) -> Column:
    return F.coalesce(F.when(index > 0, safe_divide(x * index, reference)), fallback)


def blend(base: Column, other: Column, weight: float) -> Column:
    return (1 - weight) * base + weight * other


def gate(x: Column, low: float = 5e6, high: float = 1e7) -> Column:
    return F.when(x < low, "low").when(x >= high, "high").otherwise("mid")


def calibrated(base: Column, correction: Column, cap: float = 1e6, share: float = 0.12, least: float = 8e6) -> Column:
    """base plus the correction, within cap and share of base, for bases from `least`; never below 0."""
    most = F.least(F.lit(cap), share * F.abs(base))
    return F.greatest(F.lit(0.0), base + F.when(base >= least, F.greatest(-most, F.least(most, correction))).otherwise(0.0))


def best_weight(df: DataFrame, actual: str, base: str, other: str, steps: int = 20) -> DataFrame:
    """The blend weight i / steps with the least MAE, the first of equals; one pass, no copy of the rows for each weight."""
    maes = [F.avg(F.abs((1 - i / steps) * F.col(base) + (i / steps) * F.col(other) - F.col(actual))).alias(f"w{i}") for i in range(steps + 1)]
    rows = df.agg(*maes).select(F.explode(F.array(*[F.struct(F.col(f"w{i}").alias("mae"), F.lit(i).alias("i")) for i in range(steps + 1)])).alias("x"))
    return rows.select((F.col("x.i") / steps).alias("weight"), "x.mae", "x.i").orderBy(F.round("mae", 6), "i").limit(1).select("weight", "mae")


def compositions(units: int, parts: int) -> list[tuple[int, ...]]:
    """All ways to share `units` among `parts`, in lexicographic order."""
    if parts == 1:
        return [(units,)]
    return [(first, *rest) for first in range(units + 1) for rest in compositions(units - first, parts - 1)]


def expert_errors(df: DataFrame, actual: str, experts: Sequence[str], units: int = 20, by: str | None = None) -> DataFrame:
    """gate, candidate, err and n: of each way to weigh the experts in whole units, the sum of absolute errors times units.

    Every task tries all weights on its rows in blocks and passes on one sum for
    each, so rows are neither copied nor moved. Whole predictions give exact
    sums. Rows with a null among the columns don't count.
    """
    grid = np.array(compositions(units, len(experts)), np.float64).T

    def tried(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in experts], 1)
            y = b.column(actual).to_numpy(zero_copy_only=False) * units
            gates = np.array(b.column("gate").to_pylist(), object)
            for g in set(gates.tolist()):
                at = np.flatnonzero(gates == g)
                for first in range(0, len(at), 64):  # (errors of so many rows stay in a core's cache)
                    part = at[first : first + 64]
                    err = x[part] @ grid
                    err -= y[part, None]
                    err = np.abs(err, out=err).sum(0)
                    sums[g] = sums[g] + err if g in sums else err
                rows[g] = rows.get(g, 0) + len(at)
        for g, err in sums.items():
            yield pa.RecordBatch.from_pydict({"gate": [g], "err": [err.tolist()], "n": [rows[g]]}, pa.schema([("gate", pa.string()), ("err", pa.list_(pa.float64())), ("n", pa.int64())]))

    known = df.select(F.coalesce(F.col(by), F.lit("")).alias("gate") if by else F.lit("all").alias("gate"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([actual, *experts])]).dropna()
    summed = known.mapInArrow(tried, "gate string, err array<double>, n long")
    return summed.select("gate", "n", F.posexplode("err").alias("candidate", "e")).groupBy("gate", "candidate").agg(F.sum("e").alias("err"), F.sum("n").alias("n"))


def best_experts(df: DataFrame, actual: str, experts: Sequence[str], by: str, units: int = 20, least: int = 200, gates: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    """A row for `all` and each gate: gate, units (an array, in order of experts), mae, n, fallback.

    Of equal candidates the first in lexicographic order counts. A gate with
    fewer than `least` rows takes the weights of all rows, and its own error with them.
    """
    errors = written(expert_errors(df, actual, experts, units, by), "errors")  # (a row for each candidate of a gate) read five times
    both = errors.unionByName(errors.groupBy("candidate").agg(F.sum("err").alias("err"), F.sum("n").alias("n")).select(F.lit("all").alias("gate"), "candidate", "err", "n"))
    best = both.groupBy("gate").agg(F.min_by("candidate", F.struct("err", "candidate")).alias("own"), F.max("n").alias("n"))
    overall = best.where("gate = 'all'").select(F.col("own").alias("common"))
    wanted = df.sparkSession.createDataFrame([(g,) for g in ("all", *gates)], "gate string")
    picked = wanted.join(best, "gate", "left").crossJoin(F.broadcast(overall)).withColumn("n", F.coalesce("n", F.lit(0))).withColumn("fallback", (F.col("gate") != "all") & (F.col("n") < least))
    picked = picked.withColumn("candidate", F.when(F.col("fallback"), F.col("common")).otherwise(F.col("own")))
    table = df.sparkSession.createDataFrame(list(enumerate(map(list, compositions(units, len(experts))))), "candidate int, units array<int>")
    scored = picked.join(both.select("gate", "candidate", "err"), ["gate", "candidate"], "left").join(F.broadcast(table), "candidate", "left")
    return scored.select("gate", "units", (F.col("err") / F.col("n") / units).alias("mae"), "n", "fallback")


def range_factors(df: DataFrame, day: str, actual: str, predicted: str, edges: Sequence[float], months: int = 3, least: int = 100) -> DataFrame:
    """q35 and q65 of actual / predicted by predicted bucket over the last months; thin buckets take the pooled ones."""
    last = df.agg(F.add_months(F.max(day), -months).alias("_from"))
    rows = df.crossJoin(F.broadcast(last)).where((F.col(day) >= F.col("_from")) & (F.col(predicted) > 0) & F.col(actual).isNotNull())
    bucket = sum((F.when(F.col(predicted) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = rows.select(bucket.alias("bucket"), (F.col(actual) / F.col(predicted)).alias("r"))
    q = lambda: F.percentile("r", F.array(F.lit(0.35), F.lit(0.65)))
    own = rows.groupBy("bucket").agg(q().alias("q"), F.count(F.lit(1)).alias("n"))
    pooled = rows.agg(q().alias("p"))
    spine = pooled.select(F.explode(F.sequence(F.lit(0), F.lit(len(edges)))).alias("bucket"), "p")
    thin = F.coalesce("n", F.lit(0)) < least
    pick = lambda i: F.bround(F.when(thin, F.col("p")[i]).otherwise(F.col("q")[i]), 4)
    return spine.join(own, "bucket", "left").select("bucket", pick(0).alias("lower"), pick(1).alias("upper"), F.coalesce("n", F.lit(0)).alias("sample_size"), thin.alias("fallback"))


def estimate_range(df: DataFrame, predicted: str, factors: DataFrame, edges: Sequence[float], step: float) -> DataFrame:
    """center (to the nearest step), low and high: the prediction times its bucket's factors, rounded outward to whole steps."""
    p = F.col(predicted)
    bucket = sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = df.withColumn("_bucket", bucket).join(F.broadcast(factors.select(F.col("bucket").alias("_bucket"), F.col("lower").alias("_lower"), F.col("upper").alias("_upper"))), "_bucket", "left")
    whole = lambda x: x.cast("double") * step
    return rows.withColumns({"center": whole(F.floor(p / step + 0.5)), "low": whole(F.floor(p * F.col("_lower") / step)), "high": whole(F.ceil(p * F.col("_upper") / step))}).drop("_bucket", "_lower", "_upper")


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name and vif: the diagonal of the inverse of the correlation matrix, which is one row of numbers."""
    known = df.dropna(subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    r = known.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    m = np.eye(len(columns))
    for a, b in pairs:
        m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = r[f"{a}|{b}"] if r[f"{a}|{b}"] is not None else 0.0
    vif = np.diag(np.linalg.pinv(m))
    return df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(columns, vif, strict=True)], "column_name string, vif double")


def equal_count_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """value and bin of each distinct known value: floor(bins * smaller values / values), counts by value summed in two levels."""
    number = F.col(value).cast("double")
    counts = df.select(number.alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.floor(F.signum("v") * F.log1p(F.abs("v")) * 20))
    slots = counts.groupBy("slot").agg(F.sum("n").alias("m"))
    before = slots.select("slot", F.coalesce(F.sum("m").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("m").over(W.partitionBy()).alias("total"))
    own = F.coalesce(F.sum("n").over(W.partitionBy("slot").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("own", own).join(F.broadcast(before), "slot").select("v", F.expr(f"({bins} * (base + own)) div total").cast("int").alias("bin"))  # (some 2,000 slots at most)


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 20) -> DataFrame:
    """column_name, n, mi: information in nats that a column has about the target, both cut into bins of equal counts.

    Equal values share a bin. Rows where either is unknown don't count. Strings
    are categories, each a bin of its own. Less the bias of so many filled cells
    (Miller and Madow), and never below 0.
    """
    kinds = dict(df.dtypes)

    def binned(rows: DataFrame, c: str, name: str) -> DataFrame:
        if kinds[c] == "string":
            return rows.withColumn(name, F.col(c)).where(F.col(name).isNotNull())
        # a bin begins at its least value: at most so many numbers, so that rows aren't shuffled to find theirs
        starts = equal_count_bins(rows, c, bins).groupBy("bin").agg(F.min("v").alias("v")).agg(F.sort_array(F.collect_list(F.struct("v", "bin"))).alias("_starts"))
        v = F.col(c).cast("double")
        held = rows.where(~F.isnan(v)).crossJoin(F.broadcast(starts))
        return held.withColumn(name, F.get("_starts", F.size(F.filter("_starts", lambda s: s["v"] <= v)) - 1)["bin"]).drop("_starts")

    out = None
    for c in columns:
        known = df.select(F.col(c).alias(c), F.col(target).alias("_target")).where(F.col("_target").isNotNull() & F.col(c).isNotNull())
        kinds["_target"] = kinds[target]
        cells = binned(binned(known, c, "_bx"), "_target", "_by").groupBy("_bx", "_by").agg(F.count(F.lit(1)).alias("n"))
        sides = lambda k, name: F.sum("n").over(W.partitionBy(k)).alias(name)
        both = cells.select("n", sides("_bx", "nx"), sides("_by", "ny"), F.dense_rank().over(W.orderBy("_bx")).alias("ix"), F.dense_rank().over(W.orderBy("_by")).alias("iy"))
        total = F.sum("n")
        # sum n/N ln(n N / (nx ny)), with N taken out of the sum
        plain = F.sum(F.col("n") * (F.log("n") - F.log("nx") - F.log("ny"))) / total + F.log(total)
        bias = (F.count(F.lit(1)) - F.max("ix") - F.max("iy") + 1) / (2 * total)
        got = both.agg(F.lit(c).alias("column_name"), total.alias("n"), F.greatest(F.lit(0.0), plain - bias).alias("mi"))
        out = got if out is None else out.unionByName(got)
    return out


def value_metrics(df: DataFrame, predicted: str, sold: str, key: str) -> DataFrame:
    """delta, delta_pct, is_undervalued and score: 50 + 15 * the normal quantile of the average rank / (n + 1).

    Ranks come from counts by value: values are counted, the distinct ones run
    through a two-level prefix sum (by range of values, then within a range).
    """
    rows = df.withColumn("delta", F.col(predicted) - F.col(sold))
    rows = rows.withColumn("delta_pct", safe_divide(F.col("delta") * 100, F.col(sold)))
    counts = rows.where("delta_pct is not null").groupBy("delta_pct").agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.floor("delta_pct"))
    slots = counts.groupBy("slot").agg(F.sum("n").alias("m"))
    before = slots.select("slot", F.coalesce(F.sum("m").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("m").over(W.partitionBy()).alias("total"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("slot").orderBy("delta_pct").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("_w", within).join(before, "slot").select("delta_pct", (F.col("base") + F.col("_w") + (F.col("n") + 1) / 2).alias("rank"), "total")
    score = F.when(F.col("total") == 1, 50.0).otherwise(clip(50 + 15 * interpolated_normal_quantile(F.col("rank") / (F.col("total") + 1)), 1.0, 100.0))
    return rows.join(ranks, "delta_pct", "left").withColumn("score", F.bround(score, 1)).drop("total")


def ks_drift(base: DataFrame, now: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of each column, and whether it exceeds the 5 per cent bound."""
    out = None
    for c in columns:
        both = base.select(F.col(c).alias("v"), F.lit(1).alias("b"), F.lit(0).alias("n")).unionByName(now.select(F.col(c).alias("v"), F.lit(0).alias("b"), F.lit(1).alias("n"))).where("v is not null")
        steps = both.groupBy("v").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).withColumn("slot", F.floor(F.signum("v") * F.log1p(F.abs("v")) * 20))
        slots = steps.groupBy("slot").agg(F.sum("b").alias("sb"), F.sum("n").alias("sn"))
        w = W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
        slots = slots.select("slot", F.coalesce(F.sum("sb").over(w), F.lit(0)).alias("pb"), F.coalesce(F.sum("sn").over(w), F.lit(0)).alias("pn"), F.sum("sb").over(W.partitionBy()).alias("tb"), F.sum("sn").over(W.partitionBy()).alias("tn"))
        run = W.partitionBy("slot").orderBy("v")
        gaps = steps.withColumn("cb", F.sum("b").over(run)).withColumn("cn", F.sum("n").over(run)).join(slots, "slot")
        gap = F.abs((F.col("pb") + F.col("cb")) / F.col("tb") - (F.col("pn") + F.col("cn")) / F.col("tn"))
        got = gaps.agg(F.max(gap).alias("ks"), F.max("tb").alias("nb"), F.max("tn").alias("nn"))
        got = got.select(F.lit(c).alias("column_name"), "ks", (F.col("ks") > 1.358 * F.sqrt((F.col("nb") + F.col("nn")) / (F.col("nb") * F.col("nn")))).alias("drifted"))
        out = got if out is None else out.unionByName(got)
    return out


def dataset_drift(drift: DataFrame, share: float = 0.5) -> DataFrame:
    """Of columns' drift: columns, drifted, share, dataset_drift (whether that share is reached) and mean_score."""
    n, d = F.count(F.lit(1)), F.count(F.when(F.col("drifted"), 1))
    return drift.agg(n.alias("columns"), d.alias("drifted"), F.coalesce(F.try_divide(d, n), F.lit(0.0)).alias("share"), (F.coalesce(F.try_divide(d, n), F.lit(0.0)) >= share).alias("dataset_drift"), F.avg("ks").alias("mean_score"))


def correlations(df: DataFrame, columns: Sequence[str], beyond: float = 0.0) -> DataFrame:
    """a, b, r of each two columns whose correlation is beyond a limit, either way."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = r.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x"))
    return rows.select("x.*").where(F.abs("r") > beyond)


def js_drift(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """Jensen-Shannon distance of two categorical columns, base 2."""
    p = base.groupBy(column).agg(F.count(F.lit(1)).alias("b"))
    q = now.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    both = p.join(q, column, "full").select(F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("n", F.lit(0)).alias("n"))
    total = both.agg(F.sum("b").alias("tb"), F.sum("n").alias("tn"))
    x = both.crossJoin(F.broadcast(total)).select((F.col("b") / F.col("tb")).alias("p"), (F.col("n") / F.col("tn")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return x.agg(F.sqrt(F.greatest(F.lit(0.0), F.sum((part("p") + part("q")) / 2))).alias("js"))
