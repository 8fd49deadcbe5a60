"""A tiered model: a base, a market-normalised expert and experts of three price segments, blended by gates and calibrated.

Features look at strictly earlier days only, so one table of them serves every
fold; it is written once. The models of all folds and of the whole are fitted
side by side, each job reading that table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelyard.operators import aggregates as A
from parcelyard.operators import models as P
from parcelyard.operators import temporal as T
from parcelyard.plans import registry as G
from parcelyard.plans.catalog import query
from parcelyard.plans.features import features, mask_asking
from parcelyard.plans.valuation import _PRED_SQL, predicted
from parcelyard.sources.listings import listings
from parcelyard.tables import written

#: Expanding folds, units that weights are shared in, least rows that an expert is fitted on and that a gate's own weights need.
FOLDS, UNITS, LEAST_ROWS, LEAST_GATE = 3, 20, 100, 200
#: The acceptance gate on the median absolute percentage error.
MOST_MEDIAN_APE = 0.08
#: Models that are fitted at a time, and rows that all of these hold in memory (some 300 bytes each); a larger model is fitted alone.
AT_ONCE, ROWS_HELD = 8, 20_000_000

EXPERTS = ("global", "low", "mid", "high")
MODELS = ("base", "market", "low", "mid", "high")


@dataclass(frozen=True)
class Segments:
    """Prices that bound what experts learn from (mid and high overlap), the gates of predictions, and the limits of corrections."""

    low_max: float = 5e6
    mid_min: float = 5e6
    mid_max: float = 1e7
    high_min: float = 8e6
    gate_low: float = 5e6
    gate_high: float = 1e7
    most: float = 1e6
    share: float = 0.12
    least: float = 8e6

    @staticmethod
    def of(df: DataFrame, price: str = "sold_price") -> Segments:
        """The same for another currency or market: bounds at the thirds of its prices."""
        a, b, c = A.overall_quantiles(df, price, [1 / 3, 0.55, 2 / 3]).first()[0]
        return Segments(a, a, c, b, a, c, c / 10, 0.12, b)

    def masks(self, price: Column) -> dict[str, Column]:
        return {"low": price < self.low_max, "mid": (price >= self.mid_min) & (price < self.mid_max), "high": price >= self.high_min}


@dataclass
class Tiered:
    spec: G.Spec
    segments: Segments
    prepare: PipelineModel
    context: G.Context
    models: Mapping[str, GBTRegressionModel | None]
    reference: float
    market_weight: float = 0.0
    weights: dict[str, tuple[int, ...]] = field(default_factory=dict)  # of `all` and of each gate, in UNITS
    calibrator: PipelineModel | None = None


def market_index(df: DataFrame) -> DataFrame:
    """month, idx: the median price per square metre of the month before, or of the last month before it with sales. A row a month."""
    month = F.trunc("sold_date", "MM")
    m = df.groupBy(month.alias("month")).agg(A.median("observed_ppsqm").alias("ppsqm"))
    spine = T.month_spine(df, "sold_date").join(m, "month", "left")
    filled = T.fill_forward(spine, "month", ["ppsqm"])
    return filled.select("month", F.lag("ppsqm").over(W.orderBy("month")).alias("idx"))


def table(l: DataFrame, spec: G.Spec, k: int = FOLDS) -> tuple[DataFrame, PipelineModel, G.Context]:
    """The written table that every fit reads: listing_key, sold_date, sold_price, living_area, area, size_band, area_p50, idx, fold (0 to k) and the vector _x.

    Medians for missing values come from fold 0, which every model sees.
    Categories are numbered in alphabetical order, which tells nothing of how
    often they occur later.
    """
    spec.check()
    numeric, categorical = G.subset(spec.subset)
    rows = l if spec.asking else l.withColumn("listing_price", F.lit(None).cast("double"))
    wanted = ["listing_key", "sold_date", "sold_price", "living_area", "observed_ppsqm", *numeric, *categorical]
    made = features(rows, wanted).where((F.col("sold_price") > 0) & F.col("sold_date").isNotNull() & (F.col("living_area") > 0))
    made = made if spec.asking else mask_asking(made)
    made = written(T.folds(made, "sold_date", "listing_key", k), "tier-features")
    index = written(market_index(made), "market-index")
    made = made.withColumn("month", F.trunc("sold_date", "MM")).join(F.broadcast(index), "month", "left").drop("month")  # (a row a month)
    context = G.fit_context(made.where("fold = 0"), numeric, categorical)
    prepare = preparation(G.matrix(made, numeric, categorical, context), numeric, categorical)
    # a training set opens its own folds, and of their files the pages with its prices
    rows = prepared(made, prepare, spec, context).sortWithinPartitions("fold", "sold_price")
    return written(rows, "tier-table", ["fold"]), prepare, context


def preparation(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> PipelineModel:
    index = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, VectorAssembler(inputCols=[*numeric, *(f"{c}_i" for c in categorical)], outputCol="_x")]).fit(rows)


def prepared(made: DataFrame, prepare: PipelineModel, spec: G.Spec, context: G.Context) -> DataFrame:
    """Rows of the feature chain with what the models and the calibrator read."""
    numeric, categorical = G.subset(spec.subset)
    own = [F.col(c).alias(f"own_{c}") for c in ("living_area", "area", "size_band", "area_p50")]
    keep = [c for c in ("listing_key", "sold_date", "sold_price", "idx", "fold") if c in made.columns]
    rows = made.select("*", *own)
    rows = prepare.transform(G.matrix(rows, numeric, categorical, context, [*keep, *(f"own_{c}" for c in ("living_area", "area", "size_band", "area_p50"))]))
    return rows.select(*keep, *[F.col(f"own_{c}").alias(c) for c in ("living_area", "area", "size_band", "area_p50")], "_x")


def _at_once(rows: int) -> int:
    """How many models of up to so many rows are fitted side by side."""
    return max(1, min(AT_ONCE, ROWS_HELD // max(rows, 1)))


def _in_parallel(spark: SparkSession, jobs: Mapping[Any, Callable[[], Any]], at_once: int) -> dict[Any, Any]:
    """The results of jobs that a pool of threads hands to Spark."""
    with ThreadPool(at_once) as pool:
        return dict(zip(jobs, pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs.values(), chunksize=1), strict=True))


def _fit_all(rows: DataFrame, segments: Segments, sets: Mapping[int, Column], trees: int) -> dict[int, tuple[dict[str, GBTRegressionModel | None], float]]:
    """The models of each training set, and the median of its market index; thin segments have no model."""
    index = {i: A.median(F.when(c & (F.col("idx") > 0), F.col("idx"))).alias(f"ref{i}") for i, c in sets.items()}
    sizes = {(i, k): F.count(F.when(c & m & (F.col("idx") > 0), 1)).alias(f"{k}{i}") for i, c in sets.items() for k, m in segments.masks(F.col("sold_price")).items()}
    whole = {i: F.count(F.when(c, 1)).alias(f"rows{i}") for i, c in sets.items()}
    facts = rows.agg(*index.values(), *sizes.values(), *whole.values()).first()
    most = max(facts[f"rows{i}"] for i in sets)
    jobs: dict[tuple[int, str], Callable[[], GBTRegressionModel]] = {}

    def job(own: DataFrame, label: Column) -> Callable[[], GBTRegressionModel]:
        trained = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=4, maxBins=64, stepSize=0.3, seed=7)
        return lambda: trained.fit(own.select("_x", F.log1p(label).alias("_y")))

    for i, c in sets.items():
        own, price = rows.where(c), F.col("sold_price")
        jobs[i, "base"] = job(own, price)
        if facts[f"ref{i}"] is None:
            continue
        indexed = own.where("idx > 0")
        normal = P.market_normalized(price, F.col("idx"), F.lit(facts[f"ref{i}"]))
        jobs[i, "market"] = job(indexed, normal)
        jobs |= {(i, k): job(indexed.where(m), normal) for k, m in segments.masks(price).items() if facts[f"{k}{i}"] >= LEAST_ROWS}
    done = _in_parallel(rows.sparkSession, jobs, _at_once(most))
    return {i: ({k: done.get((i, k)) for k in MODELS}, facts[f"ref{i}"] or 1.0) for i in sets}


def experts(rows: DataFrame, models: Mapping[str, GBTRegressionModel | None], reference: float) -> DataFrame:
    """rows with by_base, by_market, by_low, by_mid and by_high; what a model or the month's index can't tell is the market's view, and the base's before it."""
    for k, model in models.items():
        if model is not None:
            rows = model.setPredictionCol(f"_log_{k}").transform(rows)
    level = lambda k: F.greatest(F.lit(0.0), P.denormalized(F.expm1(f"_log_{k}"), F.col("idx"), F.lit(reference), F.lit(None).cast("double")))
    rows = rows.withColumn("by_base", F.expm1("_log_base"))
    rows = rows.withColumn("by_market", F.coalesce(level("market"), "by_base") if models.get("market") else F.col("by_base"))
    for k in ("low", "mid", "high"):
        rows = rows.withColumn(f"by_{k}", F.coalesce(level(k), "by_market") if models.get(k) else F.col("by_market"))
    return rows.drop(*[f"_log_{k}" for k in models])


def blended(t: Tiered, rows: DataFrame) -> DataFrame:
    """Rows of `experts` with by_global, the gate that it opens, and blended by the gate's weights."""
    rows = rows.withColumn("by_global", P.blend(F.col("by_base"), F.col("by_market"), t.market_weight))
    rows = rows.withColumn("gate", P.gate(F.col("by_global"), t.segments.gate_low, t.segments.gate_high))
    mixed = lambda units: sum((F.col(f"by_{e}") * (u / UNITS) for e, u in zip(EXPERTS, units, strict=True)), F.lit(0.0))
    out = mixed(t.weights["all"])
    for g in ("low", "mid", "high"):
        out = F.when(F.col("gate") == g, mixed(t.weights[g])).otherwise(out)
    return rows.withColumn("blended", out)


def out_of_fold(rows: DataFrame, fitted: Mapping[int, tuple[dict[str, GBTRegressionModel | None], float]], k: int) -> DataFrame:
    """The written predictions of folds 1 to k, each by the models of the folds before it."""
    out = None
    for i in range(1, k + 1):
        got = experts(rows.where(F.col("fold") == i), *fitted[i])
        out = got if out is None else out.unionByName(got)
    return written(out.drop("_x"), "tier-oof")


def calibration_rows(rows: DataFrame, context: float | None = None) -> DataFrame:
    per = F.when(F.col("living_area") > 0, F.col("blended") / F.col("living_area"))
    return rows.withColumns({"_per": F.coalesce(per, F.lit(0.0)), "_size": F.coalesce("living_area", F.lit(0.0)), "_around": F.coalesce("area_p50", per, F.lit(0.0)), "_area": F.coalesce("area", F.lit("unknown")), "_band": F.coalesce("size_band", F.lit("unknown"))})


def fit_calibrator(oof: DataFrame, trees: int = 20) -> PipelineModel | None:
    """Trees of the absolute loss on what blended out-of-fold predictions lack, in units of its median size, gates, areas and sizes one-hot.

    None if there is nothing to learn. The correction is the column _correction.
    """
    lack = oof.withColumn("_lack", F.col("sold_price") - F.col("blended")).where("_lack is not null")
    scale = lack.agg(F.percentile_approx(F.when(F.col("_lack") != 0, F.abs("_lack")), 0.5, 10_000)).first()[0]
    if not scale:
        return None
    rows = calibration_rows(lack).withColumn("_label", F.col("_lack") / scale)
    names = ("gate", "_area", "_band")
    index = StringIndexer(inputCols=list(names), outputCols=[f"{c}_c" for c in names], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_c" for c in names], outputCols=[f"{c}_h" for c in names], handleInvalid="keep")
    vector = VectorAssembler(inputCols=["blended", "_per", "_size", "_around", *(f"{c}_h" for c in names)], outputCol="_cx")
    trained = GBTRegressor(featuresCol="_cx", labelCol="_label", predictionCol="_scaled", lossType="absolute", maxIter=trees, maxDepth=3, stepSize=0.1, seed=7)
    model = Pipeline(stages=[index, hot, vector, trained]).fit(rows)
    model.scale = float(scale)
    return model


def corrected(model: PipelineModel | None, segments: Segments, rows: DataFrame) -> DataFrame:
    """rows with predicted: blended and its correction, within the limits of the segments."""
    if model is None:
        return rows.withColumn("predicted", F.col("blended"))
    told = model.transform(calibration_rows(rows))
    limited = P.calibrated(F.col("blended"), F.col("_scaled") * model.scale, segments.most, segments.share, segments.least)
    return told.withColumn("predicted", limited).select(*rows.columns, "predicted")


def proven_calibrator(oof: DataFrame, segments: Segments, k: int, trees: int = 20) -> PipelineModel | None:
    """A calibrator of all folds, if one of the folds before the last doesn't make the last one's mean absolute error worse; else none."""
    if k > 1 and (trial := fit_calibrator(oof.where(F.col("fold") < k), trees)) is not None:
        off = lambda c: F.avg(F.abs(F.col(c) - F.col("sold_price")))
        r = corrected(trial, segments, oof.where(F.col("fold") == k)).agg(off("predicted").alias("a"), off("blended").alias("b")).first()
        if r.a is None or r.a > r.b:
            return None
    return fit_calibrator(oof, trees)


def fit(l: DataFrame, spec: G.Spec = G.NO_LIST, segments: Segments | None = None, k: int = FOLDS, trees: int = 10) -> Tiered:
    """The model of all rows of l, its weights and calibrator chosen on out-of-fold predictions."""
    if k < 2:
        raise ValueError("at least two folds")
    return fit_table(*table(l, spec, k), spec, segments, k, trees)[0]


def fit_table(rows: DataFrame, prepare: PipelineModel, context: G.Context, spec: G.Spec, segments: Segments | None = None, k: int = FOLDS, trees: int = 10) -> tuple[Tiered, DataFrame]:
    """The model of a written table, and the out-of-fold predictions, blended."""
    segments = segments or Segments.of(rows)
    sets = {i: F.col("fold") < i for i in range(1, k + 2)}  # k + 1 is all rows
    fitted = _fit_all(rows, segments, sets, trees)
    t = Tiered(spec, segments, prepare, context, *fitted[k + 1])
    oof = out_of_fold(rows, fitted, k)
    best = P.best_weight(oof, "sold_price", "by_base", "by_market", UNITS).first()
    t.market_weight = float(best["weight"]) if best else 0.0
    unit = {"all": (UNITS, 0, 0, 0)} | {g: (UNITS, 0, 0, 0) for g in ("low", "mid", "high")}
    t.weights = dict(unit)
    gated = blended(t, oof)
    for r in P.best_experts(gated, "sold_price", [f"by_{e}" for e in EXPERTS], "gate", UNITS, LEAST_GATE).collect():
        t.weights[r.gate] = tuple(r.units) if r.units else unit["all"]
    oof = written(blended(t, oof), "tier-blended", ["fold"])
    if not spec.asking:
        t.calibrator = proven_calibrator(oof, segments, k, 2 * trees)
    return t, oof


def apply(t: Tiered, rows: DataFrame) -> DataFrame:
    """Rows of `prepared` with predicted."""
    return corrected(t.calibrator, t.segments, blended(t, experts(rows, t.models, t.reference)))


def accepted(metrics: DataFrame, most: float = MOST_MEDIAN_APE) -> DataFrame:
    """metrics with accepted: whether the median absolute percentage error passes the gate."""
    return metrics.withColumn("accepted", F.coalesce(F.col("median_ape") <= most, F.lit(False)))


def retrain_wanted(degraded: bool | Column, drift: DataFrame, least: int = 3) -> DataFrame:
    """retrain, drifted and reason: a model is to be fitted anew if it has got worse, or if so many columns have drifted."""
    worse = F.lit(degraded) if isinstance(degraded, bool) else degraded
    n = F.count(F.when(F.col("drifted"), 1))
    return drift.agg(n.alias("drifted"), (worse | (n >= least)).alias("retrain"), F.when(worse, "degraded").when(n >= least, "drift").otherwise("none").alias("reason"))


_DRIFT = ("living_area", "sold_price", "rooms", "monthly_fee", "days_on_market")
_CUT = "1998-01-01"
_KS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, max(abs(cb / tb - cn / tn)) > 1.358 * sqrt((max(tb) + max(tn)) / (max(tb) * max(tn))) AS drifted FROM (SELECT v, sum(b) OVER o AS cb, sum(n) OVER o AS cn, sum(b) OVER () AS tb, sum(n) OVER () AS tn FROM"
    f" (SELECT {c} AS v, count(*) FILTER (sold_date < DATE '{_CUT}') AS b, count(*) FILTER (sold_date >= DATE '{_CUT}') AS n FROM l WHERE {c} IS NOT NULL GROUP BY 1) WINDOW o AS (ORDER BY v))"
    for c in _DRIFT
)
_APE = "median(abs(predicted - sold_price) / sold_price)"


@query(_PRED_SQL + f", d AS ({_KS_SQL}), e AS (SELECT {_APE} FILTER (sold_date >= DATE '{_CUT}') > 1.1 * {_APE} FILTER (sold_date < DATE '{_CUT}') AS worse FROM v) SELECT count(*) FILTER (drifted) AS drifted, any_value(worse) OR count(*) FILTER (drifted) >= 3 AS retrain, CASE WHEN any_value(worse) THEN 'degraded' WHEN count(*) FILTER (drifted) >= 3 THEN 'drift' ELSE 'none' END AS reason FROM d, e")
def retrain_trigger(l: DataFrame) -> DataFrame:
    """Drift of five columns between the days before and from a cut, and whether the median error grew by more than a tenth."""
    early = F.col("sold_date") < F.lit(_CUT).cast("date")
    drift = P.ks_drift(l.where(early), l.where(~early), _DRIFT)
    ape = F.abs(F.col("predicted") - F.col("sold_price")) / F.col("sold_price")
    worse = predicted(l).agg((A.median(F.when(~early, ape)) > 1.1 * A.median(F.when(early, ape))).alias("worse"))
    rows = drift.crossJoin(F.broadcast(worse))  # one row
    return retrain_wanted(F.max("worse"), rows)


_MI = ("living_area", "rooms", "monthly_fee", "construction_year", "listing_price")
_MI_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, n, round(greatest(0, mi - (cells - nx - ny + 1) / (2 * n)) + 1e-9, 6) AS mi FROM (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * (ln(n) - ln(mx) - ln(my))) / sum(n) + ln(sum(n)) AS mi, count(*) AS cells, count(DISTINCT b1) AS nx, count(DISTINCT b2) AS ny"
    f" FROM (SELECT b1, b2, n, sum(n) OVER (PARTITION BY b1) AS mx, sum(n) OVER (PARTITION BY b2) AS my FROM (SELECT b1, b2, count(*) AS n FROM (SELECT 20 * (rank() OVER (ORDER BY {c}) - 1) // count(*) OVER () AS b1, 20 * (rank() OVER (ORDER BY sold_price) - 1) // count(*) OVER () AS b2 FROM l WHERE {c} IS NOT NULL AND sold_price IS NOT NULL) GROUP BY ALL)))"
    for c in _MI
)


@query(", d AS (SELECT 1) " + _MI_SQL)
def mutual_information(l: DataFrame) -> DataFrame:
    """What each column tells of the price, over bins of equal counts."""
    return P.mutual_information(written(l.select(*_MI, "sold_price"), "listings"), _MI, "sold_price").withColumn("mi", F.round(F.col("mi") + 1e-9, 6))


_WHOLE = {"by_global": "round(predicted)", "by_low": "round(0.9 * listing_price)", "by_mid": "round(other)", "by_high": "round(listing_price)", "actual": "round(sold_price)"}
_GRID_SQL = (
    ", x AS (SELECT " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _WHOLE.items()) + ", CASE WHEN predicted < 100000 THEN 'low' WHEN predicted >= 200000 THEN 'high' ELSE 'mid' END AS gate FROM v WHERE listing_price IS NOT NULL),"
    " w AS (SELECT a, b, c, 20 - a - b - c AS d FROM range(21) p(a), range(21) q(b), range(21) r(c) WHERE a + b + c <= 20),"
    " e AS (SELECT gate, a, b, c, d, sum(abs(a * by_global + b * by_low + c * by_mid + d * by_high - 20 * actual)) AS err, count(*) AS n FROM x, w GROUP BY ALL),"
    " f AS (FROM e UNION ALL SELECT 'all', a, b, c, d, sum(err), sum(n) FROM e GROUP BY ALL),"
    " best AS (SELECT gate, arg_min({'a': a, 'b': b, 'c': c, 'd': d}, (err, a, b, c)) AS u, max(n) AS n FROM f GROUP BY gate),"
    " g AS (SELECT t.gate, coalesce(best.n, 0) AS n, t.gate <> 'all' AND coalesce(best.n, 0) < 200 AS fallback, CASE WHEN t.gate <> 'all' AND coalesce(best.n, 0) < 200 THEN (SELECT u FROM best WHERE gate = 'all') ELSE best.u END AS u FROM (VALUES ('all'), ('low'), ('mid'), ('high')) t(gate) LEFT JOIN best USING (gate))"
)


@query(_PRED_SQL + _GRID_SQL + " SELECT g.gate, CAST(g.u.a AS INTEGER) AS w_global, CAST(g.u.b AS INTEGER) AS w_low, CAST(g.u.c AS INTEGER) AS w_mid, CAST(g.u.d AS INTEGER) AS w_high, round(f.err / f.n / 20 + 1e-7, 4) AS mae, CAST(g.n AS BIGINT) AS n, g.fallback FROM g LEFT JOIN f ON f.gate = g.gate AND f.a = g.u.a AND f.b = g.u.b AND f.c = g.u.c AND f.d = g.u.d")
def expert_weights_by_gate(l: DataFrame) -> DataFrame:
    """The best of all ways to weigh four experts in twentieths, overall and by gate, by exact sums of errors."""
    l = written(l.select("area", "living_area", "listing_price", "sold_price", "ppsqm"), "listings")
    v = predicted(l).withColumn("gate", P.gate(F.col("predicted"), 100_000.0, 200_000.0)).where("listing_price is not null")
    v = v.select("gate", *[F.expr(x).alias(k) for k, x in _WHOLE.items()])
    best = P.best_experts(v, "actual", [f"by_{e}" for e in EXPERTS], "gate")
    return best.select("gate", *[F.col("units")[i].alias(f"w_{e}") for i, e in enumerate(EXPERTS)], F.round(F.col("mae") + 1e-7, 4).alias("mae"), "n", "fallback")


@query(_PRED_SQL + f" SELECT gate, count(*) AS n, round({_APE} + 1e-7, 6) AS median_ape, {_APE} <= 0.08 AS accepted FROM (SELECT *, CASE WHEN predicted < 100000 THEN 'low' WHEN predicted >= 200000 THEN 'high' ELSE 'mid' END AS gate FROM v) GROUP BY gate")
def acceptance_by_gate(l: DataFrame) -> DataFrame:
    v = predicted(l).withColumn("gate", P.gate(F.col("predicted"), 100_000.0, 200_000.0))
    m = v.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), A.median(F.abs(F.col("predicted") - F.col("sold_price")) / F.col("sold_price")).alias("median_ape"))
    return accepted(m).withColumn("median_ape", F.round(F.col("median_ape") + 1e-7, 6))


@query(on_listings=False)
def ml_tiered_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Rows only: errors of the tiered model on the last of four folds, which it hasn't seen, and whether it is accepted."""
    rows, prepare, context = table(listings(spark, d), G.NO_LIST, FOLDS)
    seen = rows.where(F.col("fold") < FOLDS)
    t, _ = fit_table(seen, prepare, context, G.NO_LIST, None, FOLDS - 1, trees=4)
    got = apply(t, rows.where(F.col("fold") == FOLDS))
    return accepted(A.overall_errors(got, "sold_price", "predicted"))
