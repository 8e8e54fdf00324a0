"""Forests grown in tasks: few jobs, the rules of a tree, and the same trees wherever rows lie."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tallyrank.operators import certificates as ce
from tallyrank.operators.forest import ForestSettings, Rows, fit, grow
from tallyrank.plans import training as tr
from tallyrank.session import scratch_path


def data(n=400, d=5, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    return x, (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=n) > 0.4).astype(int)


def frame(spark, x, y):
    table = pd.DataFrame({"x": list(x), "class": y, "weight": np.where(y > 0, 1.5, 0.75)})
    rows = spark.createDataFrame(table, "x array<double>, class int, weight double").repartition(3)
    return rows.withColumn("features", array_to_vector("x"))


def test_deeper_trees_take_no_more_jobs(spark):
    df, sc = frame(spark, *data()), spark.sparkContext

    def jobs(depth):
        sc.setJobGroup(f"forest-{depth}", "")
        model = tr.fit_forest(df, tr.Settings(forest_trees=4, forest_depth=depth, forest_leaf=1), "weight")
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert model.getNumTrees == 4
        return len(sc.statusTracker().getJobIdsForGroup(f"forest-{depth}"))

    assert jobs(12) == jobs(2)


def test_trees_keep_their_rules_and_do_not_depend_on_how_rows_lie(spark):
    x, y = data()
    s, path = ForestSettings(trees=3, depth=6, leaf=4, bins=256, seed=7), [scratch_path(spark, f"forest-{i}") for i in range(2)]
    for p, df in zip(path, (frame(spark, x, y), frame(spark, x[::-1], y[::-1]).repartition(7))):
        fit(df, s, weight="weight").save(spark, p)
    one, two = (ce.stored_nodes(spark, p).orderBy("tree", "node").collect() for p in path)
    assert one == two and len(one) > 30
    sides = {(r["tree"], r["node"]): r for r in one}
    for r in one:
        assert r["rows"] >= 4
        if r["below"] >= 0:
            below, above = sides[r["tree"], r["below"]], sides[r["tree"], r["above"]]
            assert below["rows"] + above["rows"] == r["rows"] and r["gain"] > 0
            ends = below["below"] < 0 and above["below"] < 0
            assert not ends or np.argmax(below["stats"]) != np.argmax(above["stats"])


def test_a_root_takes_the_best_cut_of_all(spark):
    x, y = data(200)
    x = x[:, :1]
    model = fit(frame(spark, x, y), ForestSettings(trees=1, depth=1, leaf=10, bins=256, bootstrap=False), weight="weight")
    path = scratch_path(spark, "stump")
    model.save(spark, path)
    root = ce.stored_nodes(spark, path).filter("node = 0").first()
    w = np.where(y > 0, 1.5, 0.75)
    gini = lambda m: 1 - (w[m & (y > 0)].sum() / w[m].sum()) ** 2 - (w[m & (y == 0)].sum() / w[m].sum()) ** 2
    gains = []
    for v in np.unique(x[:, 0]):
        below = x[:, 0] <= v
        if min(below.sum(), (~below).sum()) >= 10:
            gains.append(gini(np.full(200, True)) - (w[below].sum() * gini(below) + w[~below].sum() * gini(~below)) / w.sum())
    if root["below"] >= 0:  # sides of one prediction are joined
        assert root["gain"] == pytest.approx(max(gains), abs=1e-9)
    assert root["rows"] == 200 and root["stats"] == pytest.approx([w[y == 0].sum(), w[y > 0].sum()])


def test_it_tells_classes_apart_as_well_as_that_of_ml(spark):
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier

    x, y = data(900)
    df, new = frame(spark, x[:600], y[:600]), frame(spark, x[600:], y[600:])
    own = fit(df, ForestSettings(trees=20, depth=8, bins=32, seed=1), weight="weight")
    ml = RandomForestClassifier(labelCol="class", numTrees=20, maxDepth=8, minInstancesPerNode=5, maxBins=32, seed=1, weightCol="weight").fit(df)
    stored = RandomForestClassificationModel.load(own.path)
    right = [m.transform(new).agg(F.avg((F.col("prediction") == F.col("class")).cast("int"))).first()[0] for m in (stored, ml)]
    assert right[0] > right[1] - 0.05
    scored = stored.setLeafCol("leaf").transform(new).select(
        vector_to_array("probability")[1].alias("p"), vector_to_array("leaf").cast("array<int>").alias("leaf"),
        own.probability().alias("q"), own.leaves().alias("own"))
    assert scored.filter((F.abs(F.col("p") - F.col("q")) > 1e-9) | (F.col("leaf") != F.col("own"))).count() == 0
    assert own.featureImportances.toArray() == pytest.approx(stored.featureImportances.toArray(), abs=1e-9)


def test_rows_without_all_features_stop_the_fit(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 1), ([1.0, None], 0), ([1.0, 3.0], 0)], "x array<double>, class int")
    with pytest.raises(Exception, match="not 2 features"):
        fit(rows, ForestSettings(trees=1, bins=4))


def test_alike_rows_make_a_tree_of_one_leaf():
    rows = Rows(np.zeros((20, 2), np.uint8), np.arange(20) % 2, np.ones(20), 2)
    tree = grow(rows, 0, ForestSettings(bootstrap=False))
    assert tree["feature"].tolist() == [-1] and tree["stats"].tolist() == [[10.0, 10.0]] and tree["raw"].tolist() == [20]
