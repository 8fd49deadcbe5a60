"""The ordered feature chain, each step a function of the columns before it, and models on top."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.functions import classify as C
from parcelyard.functions import dates as D
from parcelyard.functions import math as M
from parcelyard.functions import strings as S
from parcelyard.operators import aggregates as A
from parcelyard.operators import temporal as T
from parcelyard.plans.catalog import query
from parcelyard.sources.listings import listings
from parcelyard.tables import met, written

NUMERIC = ("living_area", "rooms", "construction_year", "floor", "monthly_fee", "area_p50", "area_n", "encoded_area", "price_median", "price_volatility", "dom_median", "energy", "quality", "month_sin", "month_cos", "timing")
CATEGORICAL = ("area", "size_band", "era", "season")
#: Columns that follow from the asking price, hidden from models that mustn't know it.
ASKING = ("listing_price", "price_per_sqm", "price_change", "fee_price_interaction", "value_score", "total_cost_per_sqm", "luxury_score")


def mask_asking(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in ASKING if c in df.columns})


def basic(df: DataFrame) -> DataFrame:
    """The observed price per square metre is kept before the asking one takes its name."""
    year, age = F.col("construction_year"), F.year("sold_date") - F.col("construction_year")
    return df.withColumns({"observed_ppsqm": M.observed_ppsqm(F.col("sold_price"), F.col("living_area")), "price_per_sqm": M.safe_divide(F.col("listing_price"), F.col("living_area")), "property_age": age}).withColumns({
        "size_band": C.size_band(F.col("living_area")), "era": C.era(year), "quality": C.quality_of_year(year), "energy": C.energy(year, F.col("living_area")), "renovation": C.renovation(age), "street": S.street_ml(F.col("address"))
    })


def calendar(df: DataFrame) -> DataFrame:
    c, m = D.cyclic(F.col("sold_date")), F.month("sold_date")
    return df.withColumns({"month_sin": c["month_sin"], "month_cos": c["month_cos"], "season": C.in_sets(m, C.SEASONS), "timing": C.timing_score(m, F.year("sold_date"))})


def priors(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """What earlier days tell of the area: quantiles, market sums and the smoothed mean, joined to the rows at once. keep: the columns of df that are wanted (None: all)."""
    asked = df.columns if keep is None else [c for c in df.columns if c in keep]
    df = df.select(*dict.fromkeys([*asked, "area", "sold_date", "observed_ppsqm", "listing_price", "sold_price", "days_on_market"]))
    df = written(df, "chain")  # read for each kind of statistics
    facts = df.withColumn("price_change", F.col("sold_price") - F.col("listing_price")).select("area", "sold_date", "observed_ppsqm", "listing_price", "sold_price", "days_on_market", "price_change")
    q = T.prior_quantiles(facts, "area", "sold_date", "observed_ppsqm").select("area", "sold_date", F.col("p50").alias("area_p50"), F.col("n").cast("double").alias("area_n"))
    market = T.market_by_day(facts, "area", "sold_date", "listing_price", "days_on_market", "price_change").select("area", "sold_date", "price_median", "price_volatility", "dom_median")
    encoded = T.target_mean_by_day(facts, "area", "sold_date", "sold_price").select("area", "sold_date", F.col("encoded").alias("encoded_area"))
    on = ["area", "sold_date"]
    return met(df.select(*dict.fromkeys([*asked, *on])), q.join(market, on, "left").join(encoded, on, "left"), on)


def features(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The whole chain, or of the columns before the last step those in keep."""
    return priors(calendar(basic(df)), keep)


def train(df: DataFrame, target: str = "sold_price", trees: int = 20, seed: int = 7) -> PipelineModel:
    """Gradient-boosted trees on the logarithm of the price; unseen categories have their own index."""
    df = df.where(F.col(target) > 0).withColumn("_y", F.log1p(target)).na.fill(0.0, list(NUMERIC)).na.fill("unknown", list(CATEGORICAL))
    index = StringIndexer(inputCols=list(CATEGORICAL), outputCols=[f"{c}_i" for c in CATEGORICAL], handleInvalid="keep")
    vector = VectorAssembler(inputCols=[*NUMERIC, *(f"{c}_i" for c in CATEGORICAL)], outputCol="_x")
    return Pipeline(stages=[index, vector, GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_log", maxIter=trees, maxDepth=4, maxBins=64, seed=seed)]).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    rows = model.transform(df.na.fill(0.0, list(NUMERIC)).na.fill("unknown", list(CATEGORICAL)))
    return rows.withColumn("predicted", F.expm1("_log"))


@query()
def feature_chain(l: DataFrame) -> DataFrame:
    """Rows only: the whole chain."""
    return features(l, ["listing_id", *NUMERIC, *CATEGORICAL]).select("listing_id", *[F.round(c, 4).alias(c) for c in NUMERIC], *[c for c in CATEGORICAL])


@query(on_listings=False)
def ml_gbt_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Rows only: errors on the later fifth of a model trained on the days before."""
    df = T.temporal_split(features(listings(spark, d), ["sold_price", "sold_date", *NUMERIC, *CATEGORICAL]), "sold_date")
    df = written(df.select("sold_price", "is_train", *NUMERIC, *CATEGORICAL), "holdout")  # each step of training reads it
    got = predict(train(df.where("is_train"), trees=5), df.where("not is_train"))
    return A.overall_errors(got, "sold_price", "predicted")
