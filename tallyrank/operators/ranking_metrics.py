"""Precision, recall and NDCG at k of ranked lists against later interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyrank.functions.numeric import ratio


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per-user metrics from ``ranked`` (user_id, product_id, rank).

    ``relevant`` may hold repeated pairs.  Users with nothing relevant get 0;
    users with no list are absent.
    """
    truth = relevant.select("user_id", "product_id").distinct()
    counts = truth.groupBy("user_id").agg(F.count("*").alias("relevant"))
    hits = ranked.filter(F.col("rank") <= k).join(
        truth.withColumn("hit", F.lit(1)), ["user_id", "product_id"], "left"
    )
    gain = F.when(F.col("hit") == 1, F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0)))
    per_user = hits.groupBy("user_id").agg(
        F.count("hit").alias("hits"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg")
    )
    joined = per_user.join(counts, "user_id", "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(0))
    )
    reachable = F.least(F.col("relevant"), F.lit(k)).cast("int")
    places = F.slice(F.sequence(F.lit(1), F.lit(k)), F.lit(1), reachable)
    ideal = F.aggregate(
        places, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1.0))
    )
    return joined.select(
        "user_id",
        "hits",
        "relevant",
        (F.col("hits") / F.lit(float(k))).alias("precision_at_k"),
        ratio("hits", "relevant").alias("recall_at_k"),
        ratio(F.col("dcg"), ideal).alias("ndcg_at_k"),
    )
