"""Learned factors: 64-bit ids, the fold-in against the fit, and their scores in the ranking."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyrank.operators.factors import dense_index, fit_factors
from tallyrank.plans import recommend as plan

BIG = 2 ** 40


def liked(spark, n_users=60, n_products=25):
    rng = np.random.default_rng(4)
    rows = [(BIG + 7 * u, BIG * 3 + p, float(rng.integers(1, 6))) for u in range(n_users) for p in range(n_products)
            if (u + p) % 2 == 0 and rng.random() < 0.7]
    return spark.createDataFrame(rows, "user_id bigint, product_id bigint, affinity double").repartition(4)


def test_dense_index_has_no_gaps_and_keeps_the_order(spark):
    ids = [5, -9, 2 ** 62, 5, None, 3, -2 ** 63, 44] + list(range(1000, 1400, 3))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(6)
    got = {r["id"]: r["index"] for r in dense_index(df, "id").collect()}
    assert got == {v: i for i, v in enumerate(sorted({i for i in ids if i is not None}))}


def test_folding_in_gives_the_factors_of_the_fit_and_new_users_are_scored(spark):
    affinity = liked(spark)
    fitted = fit_factors(affinity, rank=4)
    users = {r["user_id"]: np.array(r["u"]) for r in fitted.users.collect()}
    assert min(users) >= BIG
    again = {r["user_id"]: np.array(r["u"]) for r in fitted.fold_in(affinity).collect()}
    assert again.keys() == users.keys() and max(np.abs(again[u] - users[u]).max() for u in users) < 1e-3
    scores = fitted.score(affinity).toPandas()["score"]
    assert len(scores) == affinity.count() and scores.min() >= 0.0 and scores.max() == 1.0
    # A new user of even products scores them above odd ones.
    new = spark.createDataFrame([(-5, BIG * 3 + p, 3.0) for p in (0, 2, 4, 6, 999)], "user_id bigint, product_id bigint, affinity double")
    both = fitted.with_users(fitted.fold_in(new))
    pairs = spark.createDataFrame([(-5, BIG * 3 + p) for p in range(25)], "user_id bigint, product_id bigint")
    by = both.score(pairs).withColumn("even", (F.col("product_id") - BIG * 3) % 2 == 0).groupBy("even").agg(F.avg("score")).collect()
    mean = dict(map(tuple, by))
    assert mean[True] > mean[False] + 0.2
    assert both.users.count() == len(users) + 1


def test_learned_scores_become_the_collaborative_part(spark):
    fitted = fit_factors(liked(spark), rank=4)
    catalogue = spark.createDataFrame(pd.DataFrame({
        "product_id": [BIG * 3 + p for p in range(25)], "name": "red ring", "category": "A", "brand": "x", "price": 2.0}))
    requests = spark.createDataFrame([(1, BIG, "red", None, 1, 5), (2, 77, "red", None, 1, 5)],
                                     "request_id bigint, user_id bigint, query string, category string, page int, page_size int")
    known = plan.learned_scores(requests, catalogue, fitted)
    rows = {r["product_id"]: r["score"] for r in known.collect()}
    expected = {r["product_id"]: r["score"] for r in fitted.score(
        catalogue.select(F.lit(BIG).alias("user_id"), "product_id").orderBy("product_id").limit(10)).collect()}
    assert rows == expected and len(rows) == 10  # the other user is unknown, and keeps the default


def test_no_rows(spark):
    none = spark.createDataFrame([], "user_id bigint, product_id bigint, affinity double")
    assert dense_index(none, "user_id").count() == 0
