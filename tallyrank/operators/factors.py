"""Learned scores of users and products: factors of implicit feedback for 64-bit ids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyrank.contract import SEED
from tallyrank.functions.numeric import clip01, ratio
from tallyrank.session import materialize

LARGEST_INDEX = 2 ** 31 - 1


def dense_index(ids: DataFrame, column: str) -> DataFrame:
    """(``column``, index): the distinct values in order, numbered from 0 without gaps.

    Values are dealt out by range and numbered inside each range; only the ranges'
    counts are cumulated.
    """
    ordered = ids.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
    # The number holds the range in its upper bits and the place inside it in the lower 33.
    placed = materialize(ordered.withColumn("_n", F.monotonically_increasing_id()), "ids")
    placed = placed.select(column, F.shiftright("_n", 33).alias("_range"), F.col("_n").bitwiseAND(2 ** 33 - 1).alias("_at"))
    counts = placed.groupBy("_range").count()
    before = counts.withColumn("_before", F.sum("count").over(W.orderBy("_range")) - F.col("count"))  # one row a range
    return placed.join(F.broadcast(before), "_range").select(column, (F.col("_before") + F.col("_at")).alias("index"))


@dataclass
class Factors:
    """``users`` (user_id, u) and ``products`` (product_id, v), and the highest score that the fit gives."""

    users: DataFrame
    products: DataFrame
    high: float
    alpha: float
    ridge: float

    def score(self, pairs: DataFrame) -> DataFrame:
        """(user_id, product_id, score) of the (user_id, product_id) pairs whose factors are known.

        0 stands for no preference at all, 1 for the highest one of the fit.
        """
        known = pairs.select("user_id", "product_id").join(self.users, "user_id").join(self.products, "product_id")
        product = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return known.select("user_id", "product_id", clip01(ratio(product, F.lit(self.high))).alias("score"))

    def fold_in(self, affinity: DataFrame) -> DataFrame:
        """Factors (user_id, u) of users by their (user_id, product_id, affinity), products held as they are.

        Each user is a least-squares problem of the factors' width.  Products without
        factors are left out; a user with no others has no factors.
        """
        width = self.products.select(F.size("v")).first()
        width = width[0] if width else 0
        cells = [F.sum(F.col("v")[i] * F.col("v")[j]) for i in range(width) for j in range(width)]
        whole = np.array(self.products.agg(*cells).first() if width else [], float).reshape(width, width)
        alpha, ridge = self.alpha, self.ridge

        @F.pandas_udf("array<double>")
        def solved(weights: pd.Series, factors: pd.Series) -> pd.Series:
            out = []
            for w, v in zip(weights, factors):
                w, v = alpha * np.abs(np.asarray(w, float)), np.stack(v).astype(float)
                left = whole + (v * w[:, None]).T @ v + ridge * len(w) * np.eye(width)
                out.append(np.linalg.solve(left, ((1.0 + w)[:, None] * v).sum(axis=0)))
            return pd.Series(out)

        liked = affinity.filter("affinity > 0").join(self.products, "product_id")
        own = liked.groupBy("user_id").agg(F.collect_list("affinity").alias("w"), F.collect_list("v").alias("v"))
        return own.select("user_id", solved("w", "v").alias("u"))

    def with_users(self, users: DataFrame) -> Factors:
        """These factors with ``users`` in place of the rows of the same user, and added to the rest."""
        rest = self.users.join(users, "user_id", "left_anti")
        return Factors(rest.unionByName(users), self.products, self.high, self.alpha, self.ridge)


def fit_factors(affinity: DataFrame, rank: int = 10, rounds: int = 5, alpha: float = 1.0, ridge: float = 0.1) -> Factors:
    """Factors of (user_id, product_id, affinity) rows; ids are any 64-bit numbers.

    The library takes 32-bit ids, so dense numbers stand in for them; more than 2**31
    users or products are refused.  Rows with a null id or without affinity don't count.
    """
    rows = affinity.filter("user_id is not null and product_id is not null and affinity > 0")
    users, products = dense_index(rows, "user_id"), dense_index(rows, "product_id")
    for side in (users, products):
        if (side.agg(F.max("index")).first()[0] or 0) > LARGEST_INDEX:
            raise ValueError(f"more than {LARGEST_INDEX + 1} different values of {side.columns[0]}")
    numbered = rows.join(users.withColumnRenamed("index", "u"), "user_id").join(products.withColumnRenamed("index", "p"), "product_id")
    numbered = materialize(numbered.select("user_id", "product_id", F.col("u").cast("int"), F.col("p").cast("int"), "affinity"), "ratings")
    als = ALS(userCol="u", itemCol="p", ratingCol="affinity", implicitPrefs=True, rank=rank, maxIter=rounds,
              alpha=alpha, regParam=ridge, seed=SEED, coldStartStrategy="drop")
    model = als.fit(numbered)

    def named(factors: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        doubles = F.transform("features", lambda x: x.cast("double")).alias(name)
        return materialize(ids.join(factors, F.col("index") == F.col("id")).select(ids.columns[0], doubles), f"factors-{name}")

    fitted = Factors(named(model.userFactors, users, "u"), named(model.itemFactors, products, "v"), 1.0, alpha, ridge)
    both = numbered.select("user_id", "product_id").join(fitted.users, "user_id").join(fitted.products, "product_id")
    product = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    fitted.high = both.agg(F.max(product)).first()[0] or 1.0
    return fitted
