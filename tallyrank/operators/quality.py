"""Data-quality checks, cleaning and record validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyrank.contract import BATCH_MAX, INTERACTION_WEIGHTS, MODEL_NAMES
from tallyrank.functions.numeric import ratio


def _missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    test = F.col(name).isNull()
    if dict(df.dtypes)[name] in ("double", "float"):
        test = test | F.isnan(F.col(name))
    return test


def _total(flags: Sequence[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for flag in flags:
        out = out + flag.cast("bigint")
    return out


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, repeated rows and infinite cells, one row."""
    names = df.columns
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    cells = df.withColumn("_missing", _total([_missing(df, c) for c in names])).withColumn(
        "_infinite",
        _total([F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False)) for c in floats]),
    )
    # Copies collapse on the map side, so a row copied very often stays cheap.
    distinct = cells.groupBy(*names).agg(
        F.count("*").alias("_copies"),
        F.sum("_missing").alias("_missing"),
        F.sum("_infinite").alias("_infinite"),
    )
    return distinct.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_records"),
        F.lit(len(names)).alias("total_columns"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_records"),
        F.coalesce(F.sum("_infinite"), F.lit(0)).alias("infinite_values"),
    )


def required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One issue row per absent column, with the number of rows lacking it."""
    absent = [c for c in required if c not in df.columns]
    issues = F.array(*[F.lit(c) for c in absent]) if absent else F.array().cast("array<string>")
    return df.agg(F.count("*").alias("records")).select(
        F.explode(issues).alias("column"), F.lit("missing").alias("issue"), "records"
    )


def label_domain(df: DataFrame, label: str, allowed: Sequence = (0, 1)) -> DataFrame:
    """Labels outside the allowed set, with their row counts."""
    return (
        df.groupBy(F.col(label).alias("label"))
        .agg(F.count("*").alias("records"))
        .filter(F.col("label").isNull() | ~F.col("label").isin(*allowed))
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    positive = F.sum((F.col(label) == 1).cast("bigint"))
    return df.agg(F.count("*").alias("total"), positive.alias("positives")).select(
        "total",
        "positives",
        (F.col("total") - F.col("positives")).alias("negatives"),
        (ratio("positives", "total") * 100).alias("positive_rate"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing cells and how many, in one scan."""
    counts = df.agg(*[F.sum(_missing(df, c).cast("bigint")).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "missing").filter(F.col("missing") > 0)


def clean(df: DataFrame) -> DataFrame:
    """Drop repeated rows, then rows with any null or NaN."""
    return df.dropDuplicates().dropna("any")


def feature_order_matches(df: DataFrame, expected: Sequence[str], label: str) -> bool:
    return [c for c in df.columns if c != label] == list(expected)


def feature_order_check(df: DataFrame, expected: Sequence[str], label: str) -> DataFrame:
    matches = feature_order_matches(df, expected, label)
    return df.agg(F.count("*").alias("records")).withColumn("matches", F.lit(matches))


def record_issues(df: DataFrame, features: Sequence[str], model: str = "model_name") -> Column:
    """Reasons a scoring record is rejected, an empty array for a good one.

    NaN counts as missing; Spark orders it above every number, so it is never negative.
    """
    reasons = [F.when(_missing(df, f), F.lit(f"{f}:missing")) for f in features]
    for f in ("time", "amount"):
        reasons.append(F.when(F.col(f) < 0, F.lit(f"{f}:negative")))
    unknown = F.col(model).isNotNull() & ~F.col(model).isin(*MODEL_NAMES)
    reasons.append(F.when(unknown, F.lit("model_name:unknown")))
    return F.array_compact(F.array(*reasons))


def validate_records(df: DataFrame, features: Sequence[str]) -> DataFrame:
    issues = df.withColumn("issues", record_issues(df, features))
    return issues.withColumn("valid", F.size("issues") == 0)


def interaction_issues() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("user_id").isNull(), F.lit("user_id:missing")),
            F.when(F.col("product_id").isNull(), F.lit("product_id:missing")),
            F.when(F.col("kind").isNull(), F.lit("kind:missing")),
            F.when(~F.col("kind").isin(*INTERACTION_WEIGHTS), F.lit("kind:unknown")),
        )
    )


def validate_interactions(df: DataFrame) -> DataFrame:
    return df.withColumn("issues", interaction_issues()).withColumn("valid", F.size("issues") == 0)


def batch_sizes(df: DataFrame, batch: str, most: int = BATCH_MAX) -> DataFrame:
    return (
        df.groupBy(F.col(batch).alias("batch_id"))
        .agg(F.count("*").alias("records"))
        .withColumn("accepted", F.col("records").between(1, most))
    )
