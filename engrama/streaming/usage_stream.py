"""An extension: usage statistics kept up by a stream of log records.

Decay is multiplicative, so weights are summed at a fixed reference time and rescaled when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import accuracy_weight

REFERENCE = "2000-01-01"


def stream_usage(log: DataFrame, half_life_days: float = 180, lateness: str = "2 days") -> DataFrame:
    """log: streaming record_id, time, results. One row per id and day: positive hits and weight at the reference time."""
    r = log.withWatermark("time", lateness).select("time", F.explode(F.array_distinct(F.transform("results", lambda x: F.struct(x["id"].alias("id"), x["accuracy"].alias("accuracy"))))).alias("r"))
    days = (F.col("time").cast("double") - F.lit(REFERENCE).cast("timestamp").cast("double")) / 86400.0
    w = accuracy_weight(F.col("r.accuracy")) * F.pow(F.lit(2.0), days / half_life_days)
    return r.groupBy(F.window("time", "1 day"), F.col("r.id").alias("id")).agg(F.sum(w).alias("weight_at_reference"), F.count_if(accuracy_weight(F.col("r.accuracy")) > 0).alias("hits"))


def weights_at(rows: DataFrame, now: Column, half_life_days: float = 180) -> DataFrame:
    """id, weighted at `now`."""
    days = (now.cast("double") - F.lit(REFERENCE).cast("timestamp").cast("double")) / 86400.0
    return rows.groupBy("id").agg((F.sum("weight_at_reference") * F.first(F.pow(F.lit(0.5), days / half_life_days))).alias("weighted"))
