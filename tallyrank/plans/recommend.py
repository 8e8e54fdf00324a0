"""Ranking of products for many requests in one run.

Shuffles, in order: product features by product, candidates onto them, the
request side onto candidates, known scores by (user, product), and one by
request that serves every window after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyrank.contract import DEFAULT_COLLABORATIVE
from tallyrank.functions.vectors import cosine
from tallyrank.operators import catalog, preferences as pref, ranking
from tallyrank.operators.factors import Factors

# Scores are compared at this many places, so that sums that differ only in the
# order of addition tie and the product id decides.
PLACES = 9


def user_profiles(history: DataFrame, products: DataFrame) -> DataFrame:
    """Shares per product, category and brand of every user, as maps.

    ``history`` holds at most ``HISTORY_LIMIT`` rows per user, which bounds the
    maps; one join on the user then replaces three on the candidates.
    """
    affinity = pref.user_product_affinity(history)

    def as_map(shares: DataFrame, key: str, value: str, name: str) -> DataFrame:
        entries = F.collect_list(F.struct(F.col(key), F.col(value)))
        return shares.groupBy("user_id").agg(F.map_from_entries(entries).alias(name))

    own = as_map(pref.collaborative_scores(affinity), "product_id", "score", "own_shares")
    category = as_map(
        pref.category_preferences(affinity, products), "category", "preference", "category_shares"
    )
    brand = as_map(
        pref.brand_preferences(affinity, products), "brand", "preference", "brand_shares"
    )
    return own.join(category, "user_id", "left").join(brand, "user_id", "left")


def product_features(
    products: DataFrame, catalogue: DataFrame, text: DataFrame, image: DataFrame
) -> DataFrame:
    """Facts, factor scores and vectors of every product, one row each."""
    t = catalog.with_norms(text).select(
        "product_id", F.col("vec").alias("text_vec"), F.col("len").alias("text_len")
    )
    i = catalog.with_norms(image).select(
        "product_id", F.col("vec").alias("image_vec"), F.col("len").alias("image_len")
    )
    return (
        catalog.product_factors(products, catalogue)
        .join(t, "product_id", "left")
        .join(i, "product_id", "left")
    )


def request_features(requests: DataFrame, text: DataFrame, image_queries: DataFrame) -> DataFrame:
    """Requests with the vectors of their query text and query image."""
    t = catalog.with_norms(text).select(
        F.col("product_id").alias("query_vec_id"),
        F.col("vec").alias("query_vec"),
        F.col("len").alias("query_len"),
    )
    i = catalog.with_norms(image_queries).select(
        F.col("product_id").alias("image_vec_id"),
        F.col("vec").alias("query_image"),
        F.col("len").alias("query_image_len"),
    )
    return requests.join(t, "query_vec_id", "left").join(i, "image_vec_id", "left")


def text_similarity() -> Column:
    sim = F.coalesce(
        cosine(F.col("query_vec"), F.col("text_vec"), F.col("query_len"), F.col("text_len")),
        F.lit(0.0),
    )
    return F.when(F.coalesce(F.col("query"), F.lit("")) != "", sim).otherwise(F.lit(0.0))


def image_similarity() -> Column:
    sim = cosine(
        F.col("query_image"), F.col("image_vec"), F.col("query_image_len"), F.col("image_len")
    )
    return F.coalesce(sim, F.lit(0.0))


def lookup(shares: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(shares), F.col(key)), F.lit(0.0))


def component_scores(
    requests: DataFrame,
    products: DataFrame,
    feed: DataFrame,
    text: DataFrame,
    image: DataFrame,
    known: DataFrame | None = None,
    catalogue: DataFrame | None = None,
) -> DataFrame:
    """One row per request and candidate with its five component scores.

    ``catalogue`` holds the product attributes without the sales facts, which
    searching and preferences do not need.

    ``known`` is a stored (user_id, product_id, score) table; without it the
    scores come from all interactions.
    """
    if catalogue is None:
        catalogue = products.select("product_id", "name", "category", "brand", "price")
    if known is None:
        known = pref.collaborative_scores(pref.user_product_affinity(feed))
    profiles = user_profiles(catalog.recent_interactions(feed), catalogue)
    asked = request_features(requests, text, text).join(profiles, "user_id", "left")
    rows = (
        catalog.candidates(requests, catalogue)
        .join(product_features(products, catalogue, text, image), "product_id")
        .join(asked.drop("category"), "request_id")
        .withColumns({
            "text": text_similarity(),
            "image": image_similarity(),
            "field": catalog.field_boost(catalog.query_terms()),
            "_own": lookup("own_shares", "product_id"),
            "_category": lookup("category_shares", "category"),
            "_brand": lookup("brand_shares", "brand"),
        })
        .withColumn("interaction", pref.boost("_own", "_category", "_brand"))
        .select(
            "request_id", "user_id", "product_id", "position", "page_size", "category", "brand",
            "price", "discount_price", "stock", "popularity_score", "recency_score",
            "price_score", "stock_score", "text", "image", "field", "interaction",
        )
    )
    return rows.join(
        known.withColumnRenamed("score", "hybrid"), ["user_id", "product_id"], "left"
    ).withColumn("hybrid", F.coalesce("hybrid", F.lit(DEFAULT_COLLABORATIVE)))


def learned_scores(requests: DataFrame, catalogue: DataFrame, fitted: Factors) -> DataFrame:
    """Scores (user_id, product_id, score) of learned factors for the candidates of the requests, to be ``known``."""
    pairs = catalog.candidates(requests, catalogue).join(requests.select("request_id", "user_id"), "request_id")
    return fitted.score(pairs.select("user_id", "product_id").distinct())


def score_chain(components: DataFrame) -> DataFrame:
    """Adds combined, multi-factor and diversity-adjusted scores."""
    scored = components.withColumn("combined", F.round(ranking.combined_score(), PLACES))
    scored = scored.withColumn("multi", F.round(ranking.multi_factor_score("combined"), PLACES))
    # One shuffle by request serves the diversity, bounds and rank windows.
    scored = ranking.diversity_penalty(scored.repartition("request_id"), "multi")
    return scored.withColumnRenamed("diverse_score", "diverse")


def recommend(components: DataFrame) -> DataFrame:
    """Ranked items per request; normalised over all candidates, whose number stays beside them, then cut."""
    scored = score_chain(components).withColumn("score", ranking.normalized("diverse"))
    scored = scored.withColumn("candidates", F.count("*").over(W.partitionBy("request_id")))
    return ranking.top_k(scored, "diverse", "page_size")


def with_empty(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """Keep requests without any item, as one row without a product."""
    return requests.select("request_id").join(ranked, "request_id", "left")
