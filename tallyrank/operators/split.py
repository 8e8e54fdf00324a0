"""Repeatable stratified splits and folds.

A split is a small fitted object: per label, the hash key at each share of its
rows.  Applying it is a comparison per row, so train, test and every fold can
be taken from the scan, batch or stream, with no shuffle and the same outcome.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyrank.contract import SEED
from tallyrank.functions.hashing import key_hash
from tallyrank.functions.numeric import ratio
from tallyrank.operators.ordered import at_or_below, order_points


@dataclass
class StratifiedSplit:
    """Parts 0..n of each label, cut at the given shares of its rows."""

    label: str
    keys: list[str]
    shares: list[float]
    seed: int = SEED
    points: dict | None = None

    def fit(self, df: DataFrame) -> "StratifiedSplit":
        hashed = df.select(self.label, *self.keys, key_hash(self.seed, *self.keys).alias("_hash"))
        ranks = F.array(
            *[F.floor(F.col("n") * F.lit(s) + F.lit(0.5)).cast("bigint") for s in self.shares]
        )
        self.points = order_points(hashed, self.label, "_hash", self.keys, ranks)
        return self

    def part(self) -> Column:
        """Index of the part a row falls in; needs the key and label columns."""
        if self.points is None:
            raise RuntimeError("fit the split first")
        last = F.lit(len(self.shares))
        out = None
        for label, points in sorted(self.points.items(), key=str):
            part = None
            for i in sorted(points):
                test = at_or_below("_hash", self.keys, points[i])
                part = F.when(test, F.lit(i)) if part is None else part.when(test, F.lit(i))
            test = F.col(self.label).eqNullSafe(F.lit(label))
            part = part.otherwise(last)
            out = F.when(test, part) if out is None else out.when(test, part)
        return last if out is None else out.otherwise(last)

    def apply(self, df: DataFrame, name: str = "part") -> DataFrame:
        hashed = df.withColumn("_hash", key_hash(self.seed, *self.keys))
        return hashed.withColumn(name, self.part()).drop("_hash")


    def save(self, spark: SparkSession, path: str) -> None:
        """Stored with its points, so that any session finds the same parts of the raw rows."""
        points = [[label, sorted([i, list(p)] for i, p in own.items())] for label, own in (self.points or {}).items()]
        row = (self.label, self.keys, self.shares, self.seed, json.dumps(points))
        spark.createDataFrame([row], "label string, keys array<string>, shares array<double>, seed bigint, points string").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "StratifiedSplit":
        r = spark.read.parquet(path).first()
        points = {label: {i: tuple(p) for i, p in own} for label, own in json.loads(r["points"])}
        return cls(r["label"], r["keys"], r["shares"], r["seed"], points)


def train_test_split(
    df: DataFrame, label: str, keys: Sequence[str], test_size: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Add ``split`` = test / train, the label mix kept in both."""
    fitted = StratifiedSplit(label, list(keys), [test_size], seed).fit(df)
    return fitted.apply(df, "_part").withColumn(
        "split", F.when(F.col("_part") == 0, "test").otherwise("train")
    ).drop("_part")


def stratified_folds(
    df: DataFrame, label: str, keys: Sequence[str], folds: int = 5, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` in 0..folds-1, label mix kept in each."""
    shares = [i / folds for i in range(1, folds)]
    return StratifiedSplit(label, list(keys), shares, seed).fit(df).apply(df, "fold")


def split_report(df: DataFrame, label: str) -> DataFrame:
    return (
        df.groupBy("split")
        .agg(
            F.count("*").alias("records"),
            F.sum((F.col(label) == 1).cast("bigint")).alias("positives"),
        )
        .withColumn("positive_rate", ratio("positives", "records") * 100)
    )
