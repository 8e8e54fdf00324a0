"""From component scores to a ranked, explained list per request.

Every window here is per request, and a request holds at most two pages of
candidates, so no window partition grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyrank.contract import (
    DIVERSITY_ALPHA, DIVERSITY_MIN_CANDIDATES, FACTOR_WEIGHTS, SCORE_WEIGHTS,
)
from tallyrank.functions.numeric import ratio


def combined_score(weights=None) -> Column:
    total = F.lit(0.0)
    for name, w in (weights or SCORE_WEIGHTS).items():
        total = total + F.lit(w) * F.col(name)
    return total


def multi_factor_score(base: str, popularity=True, recency=True, price=True) -> Column:
    """Base score blended with product factors; a switched-off factor counts 0."""
    w = FACTOR_WEIGHTS
    total = F.lit(w["base"]) * F.col(base)
    for name, on in (("popularity", popularity), ("recency", recency), ("price", price)):
        if on:
            total = total + F.lit(w[name]) * F.col(f"{name}_score")
    return total


def diversity_penalty(
    df: DataFrame, score: str, request="request_id", category="category", alpha=DIVERSITY_ALPHA
) -> DataFrame:
    """Lower later items of a category, when a request has enough candidates."""
    in_category = W.partitionBy(request, category).orderBy(F.desc(score), F.asc("product_id"))
    r = F.row_number().over(in_category).cast("double")
    many = F.count("*").over(W.partitionBy(request)) > DIVERSITY_MIN_CANDIDATES
    lowered = F.col(score) * (F.lit(1.0) - F.lit(alpha) * (r - F.lit(1.0)) / r)
    return df.withColumn("diverse_score", F.when(many, lowered).otherwise(F.col(score)))


def normalized(score: str, request="request_id") -> Column:
    """Min-max over all candidates of the request; equal scores give 1."""
    w = W.partitionBy(request)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, ratio(F.col(score) - low, high - low)).otherwise(F.lit(1.0))


def top_k(df: DataFrame, score: str, k, request="request_id") -> DataFrame:
    """Best ``k`` items of each request, best first; ids break ties."""
    order = W.partitionBy(request).orderBy(F.desc(score), F.asc("product_id"))
    keep = F.col(k) if isinstance(k, str) else F.lit(k)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def explanation() -> Column:
    """Reasons in fixed order, joined; a default text when there are none.

    Needs price, discount_price, stock and the breakdown columns.
    """
    # Thresholds and wording of the reasons.
    percent = F.rint((F.lit(1.0) - F.col("discount_price") / F.col("price")) * 100).cast("int")
    has_discount = F.coalesce(F.col("discount_price"), F.lit(0.0)) != 0
    reasons = [
        F.when(F.col("popularity_score") > 0.7, "highly popular").when(
            F.col("popularity_score") > 0.5, "well-rated"
        ),
        F.when(F.col("recency_score") > 0.8, "new arrival"),
        F.when(
            (F.col("price_score") > 0.5) & has_discount,
            F.concat(percent.cast("string"), F.lit("% off")),
        ).when(F.col("price_score") > 0.5, "great value"),
        F.when(F.coalesce(F.col("stock"), F.lit(0)) < 10, "low stock"),
        F.when(F.col("field") > 0.3, "matches your search"),
        F.when(F.col("interaction") > 0.3, "based on your preferences"),
        F.when(F.col("text") > 0.6, "similar to your query"),
        F.when(F.col("image") > 0.6, "visually similar"),
    ]
    joined = F.concat_ws(", ", *reasons)
    return F.when(joined != "", F.concat(F.lit("Recommended: "), joined)).otherwise(
        F.lit("Recommended for you")
    )


def breakdown(final: str) -> Column:
    """The per-item score breakdown with the blend weights and its explanation."""
    weights = F.create_map(*[F.lit(x) for kv in SCORE_WEIGHTS.items() for x in kv])
    return F.struct(
        *[F.col(name) for name in SCORE_WEIGHTS],
        F.col(final).alias("final"),
        weights.alias("weights"),
        explanation().alias("explanation"),
    )


def recommendation_log(ranked: DataFrame, requests: DataFrame, score: str, debug: bool = False) -> DataFrame:
    """One row per request: who asked for what, product ids and scores in rank order, and metadata.

    ``ranked`` has the number of ``candidates`` of its request, which is what
    ``total_products`` says; a request without any has no row.
    """
    item = F.struct("rank", "product_id", F.col(score).alias("score"))
    lists = ranked.groupBy("request_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.first("candidates").alias("candidates"))
    asked = requests.select("request_id", "user_id", "query", "page", "page_size", F.col("image_vec_id").isNotNull().alias("has_image"))
    facts = {"page": "page", "limit": "page_size", "total_products": "candidates", "has_image": "has_image"}
    metadata = [x for k, c in facts.items() for x in (F.lit(k), F.col(c).cast("string"))]
    return lists.join(asked, "request_id").select(
        "request_id", "user_id", "query",
        F.transform("items", lambda i: i["product_id"]).alias("recommended_products"),
        F.transform("items", lambda i: i["score"]).alias("scores"),
        F.create_map(*metadata, F.lit("debug"), F.lit(str(debug).lower())).alias("metadata"),
        F.current_timestamp().alias("logged_at"),
    )
