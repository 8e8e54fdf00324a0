"""Operators on scored rows: batch summary, model choice, contributions, registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyrank.contract import DEFAULT_MODEL
from tallyrank.functions.numeric import ratio, sigmoid


def linear_score(features: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    z = F.lit(float(bias))
    for f, w in zip(features, weights):
        z = z + F.lit(float(w)) * F.col(f)
    return sigmoid(z)


def batch_summary(df: DataFrame, batch: str, p: str, duration: str, cut: float = 0.5) -> DataFrame:
    return (
        df.groupBy(F.col(batch).alias("batch_id"))
        .agg(
            F.count("*").alias("total_transactions"),
            F.sum((F.col(p) > cut).cast("bigint")).alias("positives_detected"),
            F.sum(duration).alias("total_processing_time_ms"),
        )
        .withColumn(
            "positive_rate", ratio("positives_detected", "total_transactions") * 100
        )
    )


def score_map(names: Sequence[str]) -> Column:
    return F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))])


def select_model_score(df: DataFrame, names: Sequence[str], model: str = "model_name") -> DataFrame:
    """Score of the model each row asks for; the default when it names none."""
    asked = F.coalesce(F.col(model), F.lit(DEFAULT_MODEL))
    return df.withColumn("score", F.try_element_at(score_map(names), asked))


def model_contributions(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``abs(mean score * weight)`` per base model, from one pass."""
    means = df.agg(*[F.avg(n).alias(n) for n in weights])
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return means.unpivot([], list(weights), "model", "mean_score").select(
        "model", "mean_score", F.abs(F.col("mean_score") * weight[F.col("model")]).alias("contribution")
    )


def latest_entries(df: DataFrame, model: str, order: Sequence[str]) -> DataFrame:
    """Newest entry per model.  ``max`` of a struct merges on the map side."""
    rest = [c for c in df.columns if c != model and c not in order]
    newest = df.groupBy(model).agg(F.max(F.struct(*order, *rest)).alias("e"), F.count("*").alias("entries"))
    return newest.select(model, "entries", "e.*")
