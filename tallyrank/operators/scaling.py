"""Standard scaling with population deviation, and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from tallyrank.functions.numeric import ratio


def scaler_state(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row holding a struct of mean and scale per feature.

    A feature without spread gets scale 1.
    """
    fields = []
    for f in features:
        fields.append(F.avg(f).alias(f"mean_{f}"))
        spread = F.stddev_pop(f)
        fields.append(F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias(f"scale_{f}"))
    return df.agg(F.struct(*fields).alias("state"))


def scaler_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The scaler state in long form: (feature, mean, scale)."""
    state = scaler_state(df, features)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"state.mean_{f}").alias("mean"),
                F.col(f"state.scale_{f}").alias("scale"),
            )
            for f in features
        ]
    )
    return state.select(F.inline(rows))


def scale(df: DataFrame, features: Sequence[str], state: DataFrame) -> DataFrame:
    """Replace each feature by ``(x - mean) / scale`` with a fitted state.

    The state is one row of two numbers a feature; it is computed here, once, and its
    numbers enter the plan as they are.
    """
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"features absent from the input: {absent}")
    fitted = state.first()["state"]

    def number(name: str) -> Column:
        return F.lit(fitted[name]).cast("double")

    return df.withColumns({f: (F.col(f) - number(f"mean_{f}")) / number(f"scale_{f}") for f in features})


def inference_frame(df: DataFrame, features: Sequence[str], state: DataFrame) -> DataFrame:
    """Scaled features of unseen rows; a missing or NaN value stops the job."""
    out = scale(df, features, state)
    checked = {}
    for f in features:
        bad = F.col(f).isNull() | F.isnan(f)
        checked[f] = F.when(bad, F.raise_error(F.lit(f"{f} is missing after scaling"))).otherwise(
            F.col(f)
        )
    return out.withColumns(checked)


def feature_vector(features: Sequence[str]) -> Column:
    """The features, in contract order, as one ML vector."""
    return array_to_vector(F.array(*[F.col(f).cast("double") for f in features]))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per label."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("records"))
    totals = counts.agg(F.struct(F.sum("records").alias("n"), F.count("*").alias("k")).alias("t"))
    t = totals.scalar()
    return counts.select(
        "label", "records", ratio(t["n"], t["k"] * F.col("records")).alias("weight")
    )


def vector_state(df: DataFrame, vec: str = "x") -> DataFrame:
    """Mean and population deviation per vector position, from one summary pass."""
    summary = Summarizer.metrics("mean", "std", "count").summary(array_to_vector(F.col(vec)))
    found = df.agg(summary.alias("s")).select(
        vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.std").alias("std"),
        F.col("s.count").cast("double").alias("n"),
    )
    # The summary divides by n - 1.
    spread = F.transform("std", lambda v: v * F.sqrt((F.col("n") - 1) / F.col("n")))
    return found.select(
        F.struct(
            "mean", F.transform(spread, lambda v: F.when(v == 0, 1.0).otherwise(v)).alias("scale")
        ).alias("state")
    )


def scale_vector(df: DataFrame, state: DataFrame, vec: str = "x") -> DataFrame:
    fitted = state.scalar()
    held = df.withColumns({"_mean": fitted["mean"], "_scale": fitted["scale"]})
    scaled = F.transform(
        vec, lambda v, i: (v - F.get(F.col("_mean"), i)) / F.get(F.col("_scale"), i)
    )
    return held.withColumn(vec, scaled).drop("_mean", "_scale")
