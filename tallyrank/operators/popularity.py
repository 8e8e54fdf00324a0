"""Trending and popular lists, and the chain of lists to fall back on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyrank.operators.preferences import interaction_weight


def since(feed: DataFrame, hours: int) -> DataFrame:
    """Events of the last ``hours`` before the newest one."""
    newest = feed.agg(F.max("ts").alias("ts"))
    return feed.filter(F.col("ts") > newest.scalar() - F.expr(f"INTERVAL {hours} HOURS"))


def interaction_totals(feed: DataFrame) -> DataFrame:
    return feed.groupBy("product_id").agg(
        F.sum(interaction_weight()).alias("weight"), F.count("*").alias("events")
    )


def _first(df: DataFrame, score: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc("product_id")).limit(limit)


def trending(feed: DataFrame, products: DataFrame, limit: int = 20, hours: int = 24) -> DataFrame:
    """Products with the largest weighted interaction total in the horizon.

    Known products are chosen first, so an id missing from the catalogue takes
    no place in the list.
    """
    known = interaction_totals(since(feed, hours)).join(products, "product_id")
    return _first(known, "weight", limit)


def popular(feed: DataFrame, factors: DataFrame, limit: int = 20, days: int = 30) -> DataFrame:
    """Weighted total over the horizon times the popularity of the product."""
    known = interaction_totals(since(feed, 24 * days)).join(factors, "product_id")
    scored = known.withColumn("score", F.round(F.col("weight") * F.col("popularity_score"), 6))
    return _first(scored, "score", limit)


def first_available(lists: list[DataFrame]) -> DataFrame:
    """Rows of the first list that is not empty.  The lists share columns."""
    tagged = [df.withColumn("priority", F.lit(i)) for i, df in enumerate(lists)]
    union = reduce(DataFrame.unionByName, tagged)
    present: Column = union.agg(F.min("priority").alias("p")).scalar()
    return union.filter(F.col("priority") == present)
