"""Reading JSON, CSV and table scans as the listings pipeline needs them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from parcelyard.functions import strings as S
from parcelyard.operators.relational import Filter, latest, where_all


def json_concatenated(spark: SparkSession, path: str, glob: str = "*.json*", recursive: bool = True) -> DataFrame:
    """One JSON text (column value) for each object in files that hold objects or arrays back to back.

    Whole files are read as rows, since an object may span lines; a part that
    isn't JSON ends its file.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(path)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for batch in batches:
            out = []
            for text in batch["value"]:
                at = 0
                while at < len(text):
                    while at < len(text) and text[at].isspace():
                        at += 1
                    if at == len(text):
                        break
                    try:
                        got, at = decoder.raw_decode(text, at)
                    except json.JSONDecodeError:
                        break
                    out += [json.dumps(x, ensure_ascii=False) for x in (got if isinstance(got, list) else [got]) if isinstance(x, dict)]
            yield pd.DataFrame({"value": out})

    return files.mapInPandas(cut, "value string")


def json_array_or_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array, or a document a line, by the first character; malformed records are dropped."""
    first = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
    array = bool(first) and first[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", array).option("mode", "DROPMALFORMED").json(path)


def csv_reference(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV with a header; values that aren't of the type are null; a file that is missing or empty gives no row."""
    empty = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in types.items()))
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return empty
    return raw.select(*[F.col(c).try_cast(t).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])


def json_flat_or_deep(spark: SparkSession, path: str, glob: str = "*.json*") -> DataFrame:
    """json_concatenated of a folder's own files, or, where it has none, of all folders below; a missing folder is an error."""
    try:
        flat = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path").take(1)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    return json_concatenated(spark, path, glob, recursive=not flat)


def table_filtered(spark: SparkSession, path: str, filters: Sequence[Filter]) -> DataFrame:
    """A Parquet scan whose filters reach the reader."""
    return where_all(spark.read.parquet(path), filters)


def recent_or_more(df: DataFrame, at: str, as_of: Column, days: int = 7, least: int = 10, most: int = 500, or_at: str | None = None) -> DataFrame:
    """Rows of the last days by `at`; if there are too few, those by `or_at`, if given; then the latest ones."""
    for c in [at, *([or_at] if or_at else [])]:
        recent = df.where(F.col(c) >= F.date_sub(as_of, days))
        if len(recent.select(F.lit(1)).take(least)) >= least:
            return recent
    return df.orderBy(F.col(at).desc_nulls_last()).limit(most)


def normalized(df: DataFrame, key: str = "listing_id", at: str = "scraped_at") -> DataFrame:
    """Coordinates under one name, numbers and dates coerced, the latest row of each listing."""
    for given, name in (("latitude", "lat"), ("longitude", "lon")):
        if name not in df.columns and given in df.columns:
            df = df.withColumn(name, F.col(given))
    for c in ("listing_price", "sold_price", "living_area", "rooms", "monthly_fee", "floor", "days_on_market"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).try_cast("double"))
    if "sold_date" in df.columns:
        df = df.withColumn("sold_date", F.col("sold_date").try_cast("date"))
    return latest(df, [key], [F.col(at).desc_nulls_first()]) if at in df.columns else df.dropDuplicates([key])


def _value(*keys: str) -> Column:
    """The first of alternative fields that is neither null nor empty; of an object its raw or plain value."""
    found = []
    for key in keys:
        own = F.get_json_object("value", f"$.{key}")
        inner = [F.get_json_object("value", f"$.{key}.{name}") for name in ("raw", "value", "name", "formatted")]
        plain = F.when(~own.startswith("{") & ~own.startswith("["), own)
        found.append(F.nullif(F.coalesce(*inner, plain), F.lit("")))
    return F.coalesce(*found)


def map_record(df: DataFrame, source: str | None = None, site: str = "", home: str = "/bostad/") -> DataFrame:
    """Source records (a JSON text in value) to the raw listing's columns: the first known of alternative fields, and what follows from them.

    site goes before urls that begin with a slash, and before home and the id
    where a record has no url. Records without an id go.
    """
    text = lambda *keys: F.nullif(F.trim(_value(*keys)), F.lit(""))
    whole, number = (lambda *keys: S.to_int(_value(*keys))), (lambda *keys: S.to_float(_value(*keys)))
    listed = [f"location.{k}[0]{x}" for k in ("namedAreas", "areas", "addressAreas") for x in (".name", "")]
    area = F.coalesce(text(*listed), text("location.areaName", "location.cityName", "location.district", "area"))
    null = lambda kind: F.lit(None).cast(kind)
    url = text("url", "soldUrl", "listingUrl")
    # fixed values: the fields' alternatives
    own = text("booliId", "id", "listingId", "residenceId")
    url = F.coalesce(F.when(url.startswith("/"), F.concat(F.lit(site), url)).otherwise(url), F.concat(F.lit(site + home), own))
    out = df.select(
        own.alias("listing_id"), url.alias("url"), F.current_timestamp().alias("scraped_at"),
        whole("listPrice", "listingPrice", "price").cast("double").alias("listing_price"), whole("soldPrice", "sold.price").cast("double").alias("sold_price"), text("location.streetAddress", "address", "streetAddress").alias("address"), area.alias("area"),
        text("location.region.municipalityName", "location.municipalityName", "municipality").alias("municipality"), number("livingArea", "size", "soldSize").alias("living_area"), whole("rooms", "roomCount").alias("rooms"), text("objectType", "propertyType", "type").alias("property_type"),
        whole("constructionYear", "buildYear", "yearBuilt").alias("construction_year"), whole("rent", "monthlyFee", "fee").alias("monthly_fee"), whole("soldSqmPrice", "sqmPrice", "pricePerSqm").alias("given_sqm"), whole("floor").alias("floor"),
        null("boolean").alias("elevator"), null("boolean").alias("balcony"), text("soldDate", "sold.date").alias("sold_date"), whole("daysActive", "daysOnMarket").alias("days_on_market"), text("description").alias("description"),
        F.array().cast("array<string>").alias("images"), F.lit(source).cast("string").alias("source_page"),
    )
    out = out.where("listing_id is not null and lower(listing_id) != 'none'").withColumns({
        "price_per_sqm": F.coalesce("given_sqm", F.bround(F.try_divide("sold_price", F.nullif("living_area", F.lit(0.0))), 0).cast("long")), "price_change": F.col("sold_price") - F.col("listing_price")
    })
    return out.drop("given_sqm")
