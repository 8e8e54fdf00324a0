import pytest
from pyspark.sql import functions as F

from tallyrank.operators import catalog, popularity, ranking, ranking_metrics
from tallyrank.operators.preferences import (
    collaborative_score, collaborative_scores, unseen, user_product_affinity,
)


@pytest.fixture(scope="module")
def products(spark):
    rows = [(i, f"{'red' if i % 2 else 'blue'} ring", "A" if i % 3 else "B", "x") for i in range(100)]
    return spark.createDataFrame(rows, "product_id long, name string, category string, brand string")


def pages(spark, products, asked):
    names = "request_id long, query string, category string, page int, page_size int"
    got = {}
    for r in catalog.candidates(spark.createDataFrame(asked, names), products).collect():
        got.setdefault(r["request_id"], {})[r["position"]] = r["product_id"]
    return {k: [v[p] for p in sorted(v)] for k, v in got.items()}


def test_candidate_pages(spark, products):
    got = pages(spark, products, [
        (1, "red", None, 1, 5), (2, "RED", None, 2, 5), (3, None, "B", 1, 5),
        (4, "red blue", None, 1, 3), (5, "green", None, 1, 5), (6, "red", "B", 3, 5), (7, "", None, 1, 2),
    ])
    red = [i for i in range(100) if i % 2]
    assert got[1] == red[:10] and got[2] == red[5:15]
    assert got[3] == [i for i in range(100) if i % 3 == 0][:10]
    assert got[4] == list(range(6)) and 5 not in got
    assert got[6] == [i for i in red if i % 3 == 0][10:20]
    assert got[7] == list(range(4))


def test_product_page(products):
    page = catalog.product_page(products, 2, 3, "red", "B").collect()
    assert [r["product_id"] for r in page] == [i for i in range(100) if i % 2 and i % 3 == 0][2:5]


def test_history_keeps_the_latest(spark):
    feed = spark.range(30).select(
        F.lit(1).alias("user_id"), F.col("id").alias("event_id"), (F.col("id") % 10).alias("ts"))
    got = catalog.recent_interactions(feed, 4).orderBy("rn").collect()
    assert [(r["ts"], r["event_id"]) for r in got] == [(9, 9), (9, 19), (9, 29), (8, 8)]


def test_affinity_defaults_and_unseen(spark):
    feed = spark.createDataFrame(
        [(1, 1, "view"), (1, 1, "purchase"), (1, 2, "click")], "user_id long, product_id long, kind string")
    affinity = user_product_affinity(feed)
    assert {(r["product_id"], r["affinity"]) for r in affinity.collect()} == {(1, 6.0), (2, 2.0)}
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "user_id long, product_id long")
    got = {(r["user_id"], r["product_id"]): r["score"] for r in
           collaborative_score(pairs, collaborative_scores(affinity)).collect()}
    assert got == {(1, 1): 1.0, (1, 2): pytest.approx(1 / 3), (1, 3): 0.5, (2, 1): 0.5}
    assert {tuple(r) for r in unseen(pairs, feed).collect()} == {(1, 3), (2, 1)}


def scored(spark, n):
    rows = [(1, i, "A" if i % 2 else "B", 1.0 - i / 10) for i in range(n)]
    return spark.createDataFrame(rows, "request_id long, product_id long, category string, s double")


def test_diversity_needs_more_than_five_candidates(spark):
    few = ranking.diversity_penalty(scored(spark, 5), "s").collect()
    assert all(r["diverse_score"] == r["s"] for r in few)
    many = {r["product_id"]: r["diverse_score"] for r in
            ranking.diversity_penalty(scored(spark, 6), "s").collect()}
    assert many[0] == 1.0 and many[2] == pytest.approx(0.8 * (1 - 0.3 / 2))
    assert many[4] == pytest.approx(0.6 * (1 - 0.3 * 2 / 3))


def test_bounds_come_from_rows_that_are_cut(spark):
    rows = scored(spark, 6).withColumn("n", ranking.normalized("s"))
    top = ranking.top_k(rows, "s", 2).orderBy("rank").collect()
    assert [r["n"] for r in top] == pytest.approx([1.0, 0.8])
    same = scored(spark, 3).withColumn("s", F.lit(0.4)).withColumn("n", ranking.normalized("s"))
    assert {r["n"] for r in same.collect()} == {1.0}


def test_explanation_order_and_default(spark):
    names = ("popularity_score double, recency_score double, price_score double, price double, "
             "discount_price double, stock int, field double, interaction double, text double, image double")
    rows = [
        (0.8, 0.9, 0.6, 100.0, 75.0, 5, 0.4, 0.4, 0.7, 0.7),
        (0.6, 0.8, 0.6, 100.0, None, 10, 0.3, 0.3, 0.6, 0.6),
        (0.5, 0.1, 0.5, 100.0, 50.0, None, 0.0, 0.0, 0.0, 0.0),
        (0.1, 0.1, 0.1, 100.0, 50.0, 99, 0.0, 0.0, 0.0, 0.0),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, names).select(ranking.explanation()).collect()]
    assert got == [
        "Recommended: highly popular, new arrival, 25% off, low stock, matches your search, "
        "based on your preferences, similar to your query, visually similar",
        "Recommended: well-rated, great value", "Recommended: low stock", "Recommended for you",
    ]


def test_fallback_takes_the_first_list_with_rows(spark):
    empty, full = spark.range(0), spark.range(3)
    assert popularity.first_available([empty, full, spark.range(9)]).count() == 3
    assert popularity.first_available([full, spark.range(9)]).count() == 3


def test_ranking_quality(spark):
    lists = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "user_id long, product_id long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 11), (1, 12)], "user_id long, product_id long")
    got = {r["user_id"]: r for r in ranking_metrics.ranking_quality(lists, truth, 2).collect()}
    assert got[1]["precision_at_k"] == 0.5 and got[1]["recall_at_k"] == 0.5
    assert got[1]["ndcg_at_k"] == pytest.approx((1 / 1.584962500721156) / (1 + 1 / 1.584962500721156))
    assert got[2]["ndcg_at_k"] == 0.0 and got[2]["recall_at_k"] == 0.0


def test_embedding_lookup_trims_caps_and_keeps_unknown_ids(spark):
    vectors = spark.createDataFrame([(1, [0.5])], "product_id long, vec array<double>")
    asked = spark.createDataFrame([(7, " 1, ,x,,9"), (8, ",".join(["1"] * 150))], "lookup_id long, ids string")
    rows = catalog.embedding_lookup(asked, vectors).collect()
    first = sorted((r["position"], r["id_text"], r["text_vec"]) for r in rows if r["lookup_id"] == 7)
    assert first == [(0, "1", [0.5]), (1, "x", None), (2, "9", None)]
    assert sum(r["lookup_id"] == 8 for r in rows) == 100


def test_deep_pages_cost_their_depth_and_nothing_of_others(spark, monkeypatch):
    """A search of depth 2,000 beside shallow ones; few rows of the hot term reach the ranking."""
    monkeypatch.setattr(catalog, "SEARCHES", 2)
    rows = [(i * 3, f"{'red' if i % 2 else 'blue'} ring", "A" if i % 3 else "B", "x") for i in range(20_000)]
    products = spark.createDataFrame(rows, "product_id long, name string, category string, brand string").repartition(5)
    names = "request_id long, query string, category string, page int, page_size int"
    asked = [(1, "ring", None, 20, 100), (2, "red", None, 1, 5), (3, "ring red", "B", 2, 50), (4, None, None, 1, 3), (5, "ring blue", None, 1, 4)]
    read = {}
    real = catalog.rank_brackets

    def watched(rows, *args):
        cuts = real(rows, *args)
        heads = rows.join(cuts, ["term", "cat"]).filter(F.col("product_id") <= F.col("high"))
        read.update({(r["term"], r["cat"]): r["count"] for r in heads.groupBy("term", "cat").count().collect()})
        return cuts

    monkeypatch.setattr(catalog, "rank_brackets", watched)
    got = {}
    for r in catalog.candidates(spark.createDataFrame(asked, names), products, slack=50).collect():
        got.setdefault(r["request_id"], {})[r["position"]] = r["product_id"]
    got = {k: [v[p] for p in sorted(v)] for k, v in got.items()}
    ids = lambda keep: [i * 3 for i in range(20_000) if keep(i)]
    assert got[1] == ids(lambda i: True)[1900:2100] and got[2] == ids(lambda i: i % 2)[:10]
    assert got[3] == ids(lambda i: i % 3 == 0)[50:150] and got[4] == ids(lambda i: True)[:6] and got[5] == got[4] + [18, 21]
    assert read["ring", ""] <= 2_100 + 50 and read["red", ""] <= 10 + 50 and read["", ""] <= 6 + 50 and read["blue", ""] <= 8 + 50
