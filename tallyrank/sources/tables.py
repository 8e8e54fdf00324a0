"""Readers for the given tables and the views the operators work on."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyrank.contract import INTERACTION_WEIGHTS, LINEAR_SCORERS
from tallyrank.functions.numeric import ratio, sigmoid
from tallyrank.functions.vectors import as_doubles


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def epoch_seconds(col: str) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def epoch_micros(col: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def transactions(spark: SparkSession, root: str) -> DataFrame:
    """Labelled transactions (view ``tx``): key, five features, label."""
    lines = table(spark, root, "lineitem")
    start = lines.agg(F.min("l_shipdate").alias("s")).select(epoch_seconds("s").alias("s"))
    zero = F.lit(0.0)
    return lines.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        epoch_seconds("l_shipdate").alias("ship_s"),
        (epoch_seconds("l_shipdate") - start.scalar()).cast("double").alias("time"),
        (F.col("l_quantity") + zero).alias("v1"),
        (F.col("l_discount") + zero).alias("v2"),
        (F.col("l_tax") + zero).alias("v3"),
        (F.col("l_extendedprice") + zero).alias("amount"),
        (F.col("l_returnflag") == "R").cast("int").alias("class"),
    )


def raw_transactions(spark: SparkSession, root: str) -> DataFrame:
    """Transactions without a key: repeated rows, and nulls for zero rates."""
    lines = table(spark, root, "lineitem")
    zero = F.lit(0.0)
    return lines.select(
        (F.col("l_quantity") + zero).alias("v1"),
        F.nullif(F.col("l_discount"), zero).alias("v2"),
        F.nullif(F.col("l_tax"), zero).alias("v3"),
        (F.col("l_returnflag") == "R").cast("int").alias("class"),
    )


def scoring_records(spark: SparkSession, root: str) -> DataFrame:
    """Scoring requests as they arrive, some of them breaking the contract."""
    lines = table(spark, root, "lineitem")
    zero = F.lit(0.0)
    names = F.array(*[F.lit(n) for n in [*LINEAR_SCORERS, "unknown_model"]])
    return lines.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        epoch_seconds("l_shipdate").alias("ship_s"),
        (epoch_seconds("l_shipdate") - F.lit(804556800)).cast("double").alias("time"),
        (F.col("l_quantity") + zero).alias("v1"),
        (F.col("l_discount") + zero).alias("v2"),
        F.nullif(F.col("l_tax"), zero).alias("v3"),
        (F.col("l_extendedprice") - F.lit(2000.0)).alias("amount"),
        F.get(names, (F.col("l_suppkey") % 6).cast("int")).alias("model_name"),
    )


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """Labelled vectors (view ``emb``): id, 64 doubles, label."""
    return table(spark, root, "embeddings").select(
        F.col("vec_id"),
        as_doubles("embedding").alias("x"),
        (F.col("label") == 0).cast("int").alias("class"),
    )


def linear_probability(weights: tuple) -> Column:
    bias, w1, w2, w3, w4 = weights
    z = (
        F.lit(bias)
        + F.lit(w1) * F.col("v1")
        + F.lit(w2) * F.col("v2")
        + F.lit(w3) * F.col("v3")
        + F.lit(w4) * F.col("amount")
    )
    return F.round(sigmoid(z), 4)


def wide_scores(spark: SparkSession, root: str) -> DataFrame:
    """One score column per fixed linear scorer, beside key and label."""
    tx = transactions(spark, root)
    return tx.select(
        "order_key",
        "line_no",
        "part_key",
        "supp_key",
        "ship_s",
        F.col("class").alias("y"),
        *[linear_probability(w).alias(name) for name, w in LINEAR_SCORERS.items()],
    )


def scores(spark: SparkSession, root: str) -> DataFrame:
    """Long form of the scores: (model, y, p)."""
    return wide_scores(spark, root).unpivot(
        ["y"], list(LINEAR_SCORERS), "model", "p"
    )


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """What a product is, without its sales: no pass over the order lines."""
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("stock"),
    )


def products(spark: SparkSession, root: str) -> DataFrame:
    """Product facts: one row per part with its sales aggregates."""
    sales = (
        table(spark, root, "lineitem")
        .groupBy(F.col("l_partkey").alias("product_id"))
        .agg(
            F.count("*").alias("reviews_count"),
            F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("discount_points"),
            F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("returned"),
            F.min("l_shipdate").alias("created_at"),
        )
    )
    discount = ratio(F.col("discount_points"), F.col("reviews_count") * 100)
    return catalogue(spark, root).join(sales, "product_id", "left").select(
        "product_id",
        "name",
        "category",
        "brand",
        "price",
        F.round(F.col("price") * (1 - F.coalesce(discount, F.lit(0.0))), 2).alias("discount_price"),
        "stock",
        (F.lit(1.0) + F.lit(4.0) * (1 - ratio("returned", "reviews_count"))).alias("rating"),
        F.coalesce("reviews_count", F.lit(0)).alias("reviews_count"),
        "created_at",
    )


def interactions(spark: SparkSession, root: str) -> DataFrame:
    """Raw interaction feed, including event types that are not interactions."""
    return table(spark, root, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
        F.col("event_type").alias("kind"),
    )


def valid_interactions(spark: SparkSession, root: str) -> DataFrame:
    return interactions(spark, root).filter(F.col("kind").isin(*INTERACTION_WEIGHTS))


def request_log(spark: SparkSession, root: str) -> DataFrame:
    """Served requests: endpoint, caller, duration and status."""
    return table(spark, root, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("endpoint"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )


def text_vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("product_id"), as_doubles("embedding").alias("vec")
    )


def image_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Image vectors: every second product has one."""
    return table(spark, root, "embeddings").select(
        (F.col("vec_id") * 2).alias("product_id"),
        F.reverse(as_doubles("embedding")).alias("vec"),
    )


def requests(spark: SparkSession, root: str) -> DataFrame:
    """One recommendation request per customer.

    The query is the first word of the matching part name, with the part type
    added for every third customer and absent for every tenth; every fourth asks
    within one category.
    """
    customer = table(spark, root, "customer")
    part = table(spark, root, "part")
    n_vectors = table(spark, root, "embeddings").agg(F.count("*").alias("n"))
    key = F.col("c_custkey")
    word = F.get(F.split("p_name", " "), F.lit(0))
    words = F.when(key % 3 == 0, F.concat_ws(" ", word, "p_type")).otherwise(word)
    return (
        customer.join(part, customer.c_custkey == part.p_partkey, "left")
        .withColumn("n_vectors", n_vectors.scalar())
        .select(
            key.alias("request_id"),
            key.alias("user_id"),
            F.when(key % 10 != 0, words).alias("query"),
            F.when(key % 4 == 1, F.col("p_type")).alias("category"),
            (F.lit(1) + key % 3).cast("int").alias("page"),
            F.lit(10).alias("page_size"),
            (key % F.col("n_vectors")).alias("query_vec_id"),
            F.when(key % 2 == 0, (key * 3) % F.col("n_vectors")).alias("image_vec_id"),
        )
    )
