"""Tables written once and read by several jobs."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Rows of a table that is handed to every task.
SMALL_ROWS = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of its own only for a session in a single process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="parcelyard-"))


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df as a Parquet table of the shared folder: its plan ends there, and lost executors don't bring it back. by: few values each, of which a reader opens only those that it asks for.

    Many columns at once make methods that HotSpot doesn't compile (over 8,000
    bytes); such steps are made of small methods instead.
    """
    spark, huge = df.sparkSession, "spark.sql.codegen.hugeMethodLimit"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(huge, "65535")
    spark.conf.set(huge, "8000")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(huge, before)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def met(rows: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows left-joined with stats, which is written first: where it has few rows, whatever their number is in rows, no row is shuffled for it."""
    stats = written(stats, "stats")
    return rows.join(F.broadcast(stats) if stats.count() <= SMALL_ROWS else stats, list(keys), "left")
