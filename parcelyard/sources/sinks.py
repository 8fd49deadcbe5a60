"""Writing tables so that a reader never sees half of one."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelyard.operators.relational import evolve


def staged_swap(df: DataFrame, table: str, expected: int | None = None) -> int:
    """Write to a staging table, verify its rows, then take the table's name for it.

    The old table keeps its name until the new one is whole, then a second name
    until the new one has the first; it is dropped only then, and takes its name
    back if the new one can't have it. A reader between the two renames finds no
    table, never half of one; `Versions` has no such moment.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex[:8]
    staging, old = f"{table}_staging_{mark}", f"{table}_old_{mark}"
    try:
        df.write.saveAsTable(staging)
        n = spark.table(staging).count()
        if expected is not None and n != expected:
            raise ValueError(f"{n} rows staged, {expected} expected")
        aside = spark.catalog.tableExists(table)
        if aside:
            _rename(spark, table, old)
        try:
            _rename(spark, staging, table)
        except BaseException:
            if aside:
                _rename(spark, old, table)
            raise
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    return n


def _rename(spark: SparkSession, a: str, b: str) -> None:
    spark.sql(f"ALTER TABLE {a} RENAME TO {b}")


class Versions:
    """A table as a folder of whole versions and one pointer to the current one, on any file system that Spark reads.

    A commit writes a version under a name of its own, checks it, then renames a
    new pointer over the old one, which is a single step: a reader finds the
    version before or the one after. A commit that fails at any step leaves the
    pointer as it was, and its version is deleted.
    """

    POINTER = "CURRENT"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at(".").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The name of the current version."""
        if not self._files().exists(self._at(self.POINTER)):
            return None
        return self.spark.read.text(f"{self.path}/{self.POINTER}").first()[0]

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"{self.path} has no version")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def commit(self, df: DataFrame, expected: int | None = None, keep: int = 2) -> int:
        """Write df as the current version; expected: the rows that it must have. The last `keep` versions stay for readers that have begun. Gives the rows."""
        version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        try:
            self._write(df, version)
            n = self.spark.read.parquet(f"{self.path}/{version}").count()
            if expected is not None and n != expected:
                raise ValueError(f"{n} rows written, {expected} expected")
            self._point(version)
        except BaseException:
            self._files().delete(self._at(version), True)
            raise
        versions = sorted(s.getPath().getName() for s in self._files().listStatus(self._at(".")) if s.getPath().getName().startswith("v-"))
        for old in versions[: -keep or None]:
            if old != version:
                self._files().delete(self._at(old), True)
        return n

    def _write(self, df: DataFrame, version: str) -> None:
        df.write.parquet(f"{self.path}/{version}")

    def _point(self, version: str) -> None:
        fresh = self._at(f".{self.POINTER}-{uuid.uuid4().hex}")
        out = self._files().create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration())
        over = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        over[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._at(self.POINTER), over)


def feature_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns: NaN and infinity as null, the text `nan` as null, dates as ISO text."""
    out = []
    for f in evolve(df, schema).schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(F.lower(c) != "nan", c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        if f.name in schema.names:
            out.append(c.alias(f.name))
    return evolve(df, schema).select(*out)


def listings_table(df: DataFrame, path: str) -> None:
    """Partitioned by day, sorted within partitions by what queries select on."""
    df.repartition("scraped_at_date").sortWithinPartitions("area", "rooms").write.mode("overwrite").partitionBy("scraped_at_date").parquet(path)


def json_lines(df: DataFrame, path: str, order: str, backup: bool = False) -> int:
    """JSON lines in descending order of a column, in parts; returns the rows written. backup: what was there stays as <path>.bak."""
    spark = df.sparkSession
    if backup and Path(path).exists():
        spark.read.text(path).write.mode("overwrite").text(f"{path}.bak")
    df.orderBy(F.col(order).desc_nulls_last()).write.mode("overwrite").json(path)
    return spark.read.schema(df.schema).json(path).count()


def csv_file(df: DataFrame, path: str, order: str | None = None) -> int:
    """A folder of CSV parts with a header, in order of a column if one is named; nulls are empty, quotes doubled. Returns the rows written."""
    rows = df.orderBy(order) if order else df
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).count()


def report_json(df: DataFrame, path: str, most: int = 10_000) -> int:
    """A small report (a row for each area or bucket) as one indented JSON array; more rows than `most` are an error."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    Path(path).write_text(json.dumps(rows, indent=2, ensure_ascii=False))
    return len(rows)


def merged_lines(spark: SparkSession, path: str, schema: str, key: str, day: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON lines of all files, the first of each key in order of file and place; and how many stay by file and by month."""
    kind = T.StructType.fromDDL(schema)
    rows = spark.read.schema(kind).json(path).select("*", F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("source", "_block", "_at"))).where((F.col("_r") == 1) & F.col(key).isNotNull())
    by_source = first.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    by_month = first.groupBy(F.substring(day, 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return first.select(*kind.names), by_source, by_month


def write_sha256(path: str) -> str:
    digest = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    Path(f"{path}.sha256").write_text(f"{digest}  {Path(path).name}\n")
    return digest


def verify_sha256(path: str) -> bool:
    """Constant-time comparison with the sidecar."""
    want = Path(f"{path}.sha256").read_text().split()[0]
    return hmac.compare_digest(want, hashlib.sha256(Path(path).read_bytes()).hexdigest())
