import pytest

from tallyrank.operators import evaluation as ev, isolation
from tallyrank.functions.risk import confidence, hard_label, risk_action, risk_band
from tallyrank.plans import training as tr
from pyspark.sql import functions as F

HAND = list(zip([0, 0, 1, 1, 1], [0.1, 0.5, 0.5, 0.6, 0.9]))


@pytest.fixture
def scored(spark):
    return spark.createDataFrame([("m", y, p) for y, p in HAND], "model string, y int, p double")


def test_confusion_and_rates(scored):
    got = ev.with_rates(ev.confusion(scored)).first()
    assert [got[c] for c in ev.CONFUSION] == [2, 0, 1, 2]
    assert got["precision"] == 1.0 and got["recall"] == pytest.approx(2 / 3)
    assert got["specificity"] == 1.0 and got["f1"] == pytest.approx(0.8)


@pytest.mark.parametrize("decimals", [None, 4])
def test_auc_counts_a_tie_as_half(scored, decimals):
    assert ev.roc_auc(scored, decimals).first()["roc_auc"] == pytest.approx(5.5 / 6)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("m", 1, 0.2), ("m", 1, 0.4)], "model string, y int, p double")
    assert ev.roc_auc(df, 4).first()["roc_auc"] is None
    assert [ev.confusion(df).first()[c] for c in ev.CONFUSION] == [0, 0, 2, 0]


def test_pr_area_is_the_trapezoid_of_the_curve(scored):
    points = sorted((-(r["threshold"] or 9), r["recall"], r["precision"])
                    for r in ev.pr_curve(scored, 4).collect())
    area = sum((b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip(points, points[1:]))
    assert ev.pr_auc(scored, 4).first()["pr_auc"] == pytest.approx(area)
    assert ev.pr_auc(scored).first()["pr_auc"] == pytest.approx(area)


def test_threshold_search_matches_brute_force(scored):
    best = (0.5, 0.0)
    for i in range(100):
        t = 1.0 if i == 99 else i * (1 / 99)
        tp = sum(p >= t and y for y, p in HAND)
        fp = sum(p >= t and not y for y, p in HAND)
        fn = sum(p < t and y for y, p in HAND)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f1 > best[1]:
            best = (t, f1)
    got = ev.optimal_threshold(scored).first()
    assert (got["threshold"], got["score"]) == pytest.approx(best)


def test_threshold_falls_back_to_half(spark):
    df = spark.createDataFrame([("m", 0, 0.2)], "model string, y int, p double")
    got = ev.optimal_threshold(df).first()
    assert (got["threshold"], got["score"]) == (0.5, 0.0)


def test_grid_index_at_every_cut(spark):
    cuts = [(i, 1.0 if i == 99 else i * (1 / 99)) for i in range(100)]
    df = spark.createDataFrame(cuts, "i int, p double")
    assert all(r[0] == r[1] for r in df.select("i", ev.grid_index(F.col("p"))).collect())


def test_bands_close_below(spark):
    df = spark.createDataFrame([(p,) for p in (0.2999, 0.3, 0.6, 0.8)], "p double")
    rows = df.select(risk_band("p").alias("b")).withColumn("a", risk_action("b")).collect()
    assert [r["b"] for r in rows] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert [r["a"] for r in rows] == ["approve", "verify", "review", "block"]
    one = spark.createDataFrame([(0.5, 0.0234)], "p double, q double")
    got = one.select(hard_label("p"), confidence("q")).first()
    assert got[0] == 0 and got[1] == pytest.approx(0.9766)


def test_compare_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.7), ("a", 0.7), ("c", 0.9)], "model string, roc_auc double")
    assert [r["model"] for r in ev.compare(df).orderBy("rank").collect()] == ["c", "a", "b"]
    assert ev.best(df.filter("model <> 'c'")).first()["model"] == "a"


def test_anomaly_normalisation(spark):
    df = spark.createDataFrame([(-0.9,), (-0.5,), (-0.1,)], "raw double")
    got = [r[0] for r in df.select(isolation.normalised_score(F.col("raw"), 0.3, 0.7)).collect()]
    assert got == pytest.approx([1.0, 0.5, 0.0])
    same = [r[0] for r in df.select(isolation.normalised_score(F.col("raw"), 0.3, 0.3)).collect()]
    assert same == [0.5] * 3
    with pytest.raises(RuntimeError):
        isolation.normalised_score(F.col("raw"), None, None)


def test_curves_are_whole_unless_thinning_is_asked_for(spark):
    df = spark.range(500).select(F.lit("m").alias("model"), (F.col("id") % 3 == 0).cast("int").alias("y"),
                                 (F.col("id") / 500).alias("p"))
    whole = ev.chart_curves(df).collect()
    assert sorted(r["threshold"] for r in whole) == [i / 500 for i in range(500)]
    assert ev.chart_curves(df, most=200).count() <= 201


def test_fitted_scores_close_together_are_told_apart(spark):
    rows = [(i % 2, 0.5 + (1 + i % 2) * 1e-8 + i * 1e-11) for i in range(40)]
    df = spark.createDataFrame(rows, "class int, m double")
    assert tr.area(df, ["m"]).first()["roc_auc"] == 1.0
