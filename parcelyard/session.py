"""The session that queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "parcelyard", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; ANSI stays on, so casts of dirty text use try_ functions."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (fixed | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
