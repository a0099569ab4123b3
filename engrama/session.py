"""Session settings the engine relies on: UTC, adaptive execution with skew handling."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "engrama", **conf: str) -> SparkSession:
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
