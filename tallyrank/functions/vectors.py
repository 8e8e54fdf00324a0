"""Array-of-double arithmetic in Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def as_doubles(col) -> Column:
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def squared_distance(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v
    )


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity; a missing or zero vector gives 0."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def between(a, b, share) -> Column:
    """The point ``a + share * (b - a)``."""
    return F.zip_with(a, b, lambda x, y: x + share * (y - x))


def with_names(df: DataFrame, names: Sequence[str], vec: str = "x") -> DataFrame:
    """The same rows, ``vec`` knowing the names of its positions; they travel with the column."""
    return df.withMetadata(vec, {"features": list(names)})


def names_of(df: DataFrame, vec: str = "x") -> list[str] | None:
    """Names of the positions of ``vec``, where it knows them."""
    return df.schema[vec].metadata.get("features")


def assembled(df: DataFrame, names: Sequence[str], vec: str = "x") -> DataFrame:
    """Adds ``vec`` from columns, found by name whatever their order."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return with_names(df.withColumn(vec, F.array(*[F.col(n).cast("double") for n in names])), names, vec)
