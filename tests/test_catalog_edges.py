"""Cases that the given tables do not show: several search words, no category, NaN."""


from tallyrank.operators.catalog import product_factors, product_page


def test_a_page_finds_any_word_of_the_text(spark):
    rows = spark.createDataFrame([(1, "red box"), (2, "blue lid"), (3, "green cup")], "product_id int, name string")
    assert [r.product_id for r in product_page(rows, 0, 9, text="Blue  box").collect()] == [1, 2]
    assert product_page(rows, 0, 9, text="  ").count() == 3


def test_products_without_a_category_keep_their_scores(spark):
    rows = spark.createDataFrame(
        [(1, "a", 2.0), (2, None, 3.0), (3, None, 5.0)], "product_id int, category string, price double"
    ).selectExpr("*", "4.0D AS rating", "3L AS reviews_count", "10 AS stock", "timestamp_ntz'2024-01-01 00:00:00' AS created_at")
    got = {r.product_id: r.price_score for r in product_factors(rows).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0}


def test_nan_is_missing_in_a_scoring_record(spark):
    from tallyrank.operators.quality import validate_records

    rows = spark.createDataFrame([(1.0, float("nan"), None), (1.0, 2.0, None)], "time double, amount double, model_name string")
    got = validate_records(rows, ["time", "amount"]).collect()
    assert [(list(r.issues), r.valid) for r in got] == [(["amount:missing"], False), ([], True)]
