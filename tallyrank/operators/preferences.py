"""What users did, reduced to affinities, preferences and boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyrank.contract import BOOST_WEIGHTS, DEFAULT_COLLABORATIVE, INTERACTION_WEIGHTS
from tallyrank.functions.numeric import ratio


def interaction_weight(kind: str = "kind") -> Column:
    pairs = [F.lit(x) for kv in INTERACTION_WEIGHTS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(kind)], F.lit(0.0))


def user_product_affinity(feed: DataFrame) -> DataFrame:
    """Weighted interaction total per user and product."""
    return feed.groupBy("user_id", "product_id").agg(
        F.sum(interaction_weight()).alias("affinity"), F.count("*").alias("events")
    )


def collaborative_scores(affinity: DataFrame) -> DataFrame:
    """Affinity over the user's largest one."""
    most = affinity.groupBy("user_id").agg(F.max("affinity").alias("most"))
    return affinity.join(most, "user_id").select(
        "user_id", "product_id", ratio("affinity", "most").alias("score")
    )


def collaborative_score(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Score of each (user, product) pair, a fixed default where none is known."""
    return pairs.join(scores, ["user_id", "product_id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(DEFAULT_COLLABORATIVE))
    )


def _preference(affinity: DataFrame, products: DataFrame, field: str) -> DataFrame:
    known = affinity.join(products.select("product_id", field), "product_id")
    sums = known.groupBy("user_id", field).agg(F.sum("affinity").alias("s"))
    totals = sums.groupBy("user_id").agg(F.sum("s").alias("t"))
    return sums.join(totals, "user_id").select(
        "user_id", field, ratio("s", "t").alias("preference")
    )


def category_preferences(affinity: DataFrame, products: DataFrame) -> DataFrame:
    """Share of each category in a user's weighted interactions."""
    return _preference(affinity, products, "category")


def brand_preferences(affinity: DataFrame, products: DataFrame) -> DataFrame:
    return _preference(affinity, products, "brand")


def price_preference(affinity: DataFrame, products: DataFrame) -> DataFrame:
    """Weighted mean and population deviation of the prices a user touched."""
    w, x = F.col("affinity"), F.col("price")
    sums = (
        affinity.join(products.select("product_id", "price"), "product_id")
        .groupBy("user_id")
        .agg(
            F.sum(w).alias("w"),
            F.sum(w * x).alias("wx"),
            F.sum(w * x * x).alias("wxx"),
            F.count("*").alias("products"),
        )
    )
    mean = ratio("wx", "w")
    return sums.select(
        "user_id",
        "products",
        mean.alias("mean_price"),
        F.sqrt(F.greatest(ratio("wxx", "w") - mean * mean, F.lit(0.0))).alias("price_deviation"),
    )


def boost(affinity: str, category: str, brand: str) -> Column:
    """Weighted sum of three shares, each 0 when unknown, at most 1."""
    parts = zip(("affinity", "category", "brand"), (affinity, category, brand))
    total = F.lit(0.0)
    for key, name in parts:
        total = total + F.lit(BOOST_WEIGHTS[key]) * F.coalesce(F.col(name), F.lit(0.0))
    return F.least(F.lit(1.0), total)


def interaction_boost(pairs: DataFrame, feed: DataFrame, products: DataFrame) -> DataFrame:
    """Adds ``interaction`` to (user, product, category, brand) rows."""
    affinity = user_product_affinity(feed)
    own = collaborative_scores(affinity).withColumnRenamed("score", "_own")
    category = category_preferences(affinity, products).withColumnRenamed("preference", "_cat")
    brand = brand_preferences(affinity, products).withColumnRenamed("preference", "_brand")
    return (
        pairs.join(own, ["user_id", "product_id"], "left")
        .join(category, ["user_id", "category"], "left")
        .join(brand, ["user_id", "brand"], "left")
        .withColumn("interaction", boost("_own", "_cat", "_brand"))
        .drop("_own", "_cat", "_brand")
    )


def unseen(pairs: DataFrame, feed: DataFrame) -> DataFrame:
    """Pairs the user has not interacted with."""
    return pairs.join(feed.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
