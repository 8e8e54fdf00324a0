"""Request counts, latency statistics and rate-limit offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyrank.contract import (
    CALL_LATENCY_BANDS, LATENCY_REST, MEAN_LATENCY_BANDS, RATE_LIMIT_PER_MINUTE,
)
from tallyrank.functions.numeric import banded, ratio
from tallyrank.operators.ordered import group_percentiles


def runtime_stats(log: DataFrame) -> DataFrame:
    """Calls and mean duration, 0 for an empty log."""
    return log.agg(
        F.count("*").alias("predictions"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("mean_ms"),
    )


def request_stats(log: DataFrame) -> DataFrame:
    ok = F.sum((F.col("status") < 400).cast("bigint"))
    return (
        log.groupBy("endpoint")
        .agg(
            F.count("*").alias("requests"),
            ok.alias("succeeded"),
            F.avg("duration_ms").alias("mean_ms"),
            F.min("duration_ms").alias("min_ms"),
            F.max("duration_ms").alias("max_ms"),
        )
        .withColumn("success_rate", ratio("succeeded", "requests"))
    )


def latency_percentiles(log: DataFrame, shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """Mean, bounds and exact percentiles by index, per endpoint."""
    base = request_stats(log).select("endpoint", "requests", "mean_ms", "min_ms", "max_ms")
    points = group_percentiles(log, "endpoint", "duration_ms", list(shares))
    wide = points.groupBy("endpoint").agg(
        *[
            F.max(F.when(F.col("share") == s, F.col("duration_ms"))).alias(f"p{round(s * 100)}_ms")
            for s in shares
        ]
    )
    return base.join(wide, "endpoint")


def mean_rating(col: str) -> Column:
    return banded(col, MEAN_LATENCY_BANDS, LATENCY_REST)


def call_rating(col: str) -> Column:
    return banded(col, CALL_LATENCY_BANDS, LATENCY_REST)


def rate_limit_offenders(
    log: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE, seconds: int = 60, key: str = "user_id"
) -> DataFrame:
    """Callers with more than ``limit`` requests in one tumbling window."""
    window = F.window("ts", f"{seconds} seconds")
    return (
        log.groupBy(key, window.alias("w"))
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select(key, F.col("w.start").alias("window_start"), "requests")
    )
