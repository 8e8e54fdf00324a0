"""Certificates of fits: right fits pass, and each kind of wrong number is seen."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from side_by_side import sorted_rows
from tallyrank.operators import certificates as ce, isolation
from tallyrank.plans import training as tr
from tallyrank.registry import ORACLES, certificates, models
from tallyrank.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    made = [(i, [float(v) for v in rng.normal(1.0 if i % 6 == 0 else 0.0, 1.0, 4)], int(i % 6 == 0)) for i in range(360)]
    return spark.createDataFrame(made, "id long, x array<double>, class int").repartition(3)


@pytest.fixture(scope="module")
def run(rows):
    small = tr.Settings(forest_trees=4, forest_depth=5, forest_bins=32, rounds=3, depth=2, isolation_sample=32)
    return tr.TrainingRun(rows, small)


@pytest.fixture(scope="module")
def con(rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("emb") / "embeddings.parquet")
    table = rows.select(F.col("id").alias("vec_id"), F.col("x").alias("embedding"), (1 - F.col("class")).alias("label")).toPandas()
    table.to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    return con


NAMES = ["penalty_certificates", "stacking_certificate", "forest_recount", "forest_votes", "importance_certificate", "isolation_recount",
         "isolation_rescored", "oof_folds", "training_sizes", "history_falls", "scores_agree"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, run, con, monkeypatch, name):
    monkeypatch.setattr(models, "_run", lambda spark, root: run)
    got = getattr(certificates, name)(spark, "")
    sql = con.execute(ORACLES[name])
    names = [c[0] for c in sql.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted_rows(got.columns, [tuple(r) for r in got.collect()]) == sorted_rows(names, sql.fetchall())


@pytest.mark.parametrize("penalty", ["l1", "l2", "none"])
def test_slopes_equal_the_plain_sum_and_a_moved_weight_is_seen(run, penalty):
    model = run.logistic_with(penalty)
    strength, mix = tr.penalty_of(run.balanced_rows, tr.replace(run.settings, penalty=penalty))
    w, b = np.array(model.coefficients), model.intercept
    moved = w + [0.3, 0.0, 0.0, 0.0]
    data = run.balanced.select("x", "class").toPandas()
    x, y = np.stack(data["x"]), data["class"].to_numpy()
    for values, passes in ((w, True), (moved, False)):
        got = {r["feature"]: r for r in ce.logistic_residuals(run.balanced, values, b, strength, mix, weight="weight").collect()}
        error = 1 / (1 + np.exp(-(x @ values + b))) - y
        slope = (error[:, None] * x).mean(axis=0) + strength * (1 - mix) * values
        assert [got[i]["gradient"] for i in range(4)] == pytest.approx(list(slope), abs=1e-9)
        assert got[-1]["gradient"] == pytest.approx(error.mean(), abs=1e-9)
        assert all(r["residual"] <= certificates.SLOPE * r["scale"] for r in got.values()) == passes


def test_a_weight_at_rest_is_judged_by_the_size_of_its_slope(spark):
    rows = spark.createDataFrame([([1.0, 0.2], 1), ([-1.0, -0.2], 0)], "x array<double>, class int")
    loose, strict = ({r["feature"]: r["residual"] for r in ce.logistic_residuals(rows, [0.0, 0.0], 0.0, s, 1.0).collect()} for s in (0.3, 0.6))
    assert loose == pytest.approx({-1: 0.0, 0: 0.2, 1: 0.0}) and strict == pytest.approx({-1: 0.0, 0: 0.0, 1: 0.0})


def test_rows_of_logistic_residuals_may_be_empty_null_and_of_clashing_names(spark):
    schema = "x array<double>, class int, w double, y string, e int, at int, value string"
    rest = ("y", 1, 2, "v")
    rows = [([1.0], 1, 1.0, *rest), (None, 1, 1.0, *rest), ([1.0], None, 1.0, *rest), ([1.0], 0, None, *rest), ([1.0], 0, 0.0, *rest)]
    got = ce.logistic_residuals(spark.createDataFrame(rows, schema), [0.0], 0.0, weight="w").collect()
    assert {r["feature"]: r["gradient"] for r in got} == pytest.approx({-1: -0.5, 0: -0.5})
    assert ce.logistic_residuals(spark.createDataFrame([], schema), [0.0], 0.0).collect() == []


@pytest.fixture(scope="module")
def grown(spark, run):
    model = run.forest_without_bags(3)
    path = scratch_path(spark, "grown")
    model.write().save(path)
    scored = model.setLeafCol("leaf").transform(run.balanced).withColumn("leaf", vector_to_array("leaf"))
    return ce.stored_nodes(spark, path), scored.select("x", "class", "weight", "leaf")


def test_a_changed_count_row_or_gain_is_seen_in_its_tree(grown):
    nodes, scored = grown
    changes = [
        (nodes.withColumn("gain", F.when(F.expr("tree = 1 AND node = 0"), F.col("gain") + 0.1).otherwise(F.col("gain"))), scored, "gain_gap"),
        (nodes.withColumn("impurity", F.when(F.expr("tree = 1 AND node = 0"), 0.9).otherwise(F.col("impurity"))), scored, "impurity_gap"),
        (nodes, scored.withColumn("leaf", F.transform("leaf", lambda v, i: F.when((i == 1) & (F.col("class") == 1), 0.0).otherwise(v))), "stats_gap"),
    ]
    for n, s, gap in changes:
        found = ce.forest_recount(n, s, weight="weight").groupBy("tree").agg(F.max(gap).alias("gap")).collect()
        assert {r["tree"]: r["gap"] > certificates.CLOSE for r in found} == {0: False, 1: True, 2: False}


def test_a_forest_counted_on_no_rows_misses_all_of_its_leaves(grown):
    nodes, scored = grown
    found = ce.forest_recount(nodes, scored.limit(0)).join(nodes.filter("leaf IS NOT NULL"), ["tree", "node"])
    assert found.count() and found.filter("stats_gap = 0 OR rows_gap = 0").count() == 0


def test_an_isolation_tree_is_walked_as_a_plain_loop_does(spark):
    nodes = [(0, 0, 0, 0.5, 1, 2, 4, 0), (0, 1, -1, 0.0, -1, -1, 3, 1), (0, 2, -1, 0.0, -1, -1, 1, 1), (1, 0, -1, 0.0, -1, -1, 4, 0)]
    table = spark.createDataFrame(nodes, isolation.NODES)
    rows = spark.createDataFrame([(1, [0.5]), (2, [0.6]), (3, [-1.0]), (3, [-1.0])], "id long, x array<double>")
    got = {r["id"]: r["raw_score"] for r in ce.isolation_recomputed(rows, table, 4).collect()}
    scale, four = isolation.mean_path(4), isolation.mean_path(4)
    low, high = (-math.pow(2, -(first + four) / 2 / scale) for first in (1 + isolation.mean_path(3), 1.0))
    assert got == pytest.approx({1: low, 2: high, 3: low})
    sample = spark.createDataFrame([(0, [0.1]), (0, [0.2]), (0, [0.9]), (0, [0.8]), (1, [0.0])], "tree int, x array<double>")
    found = {(r["tree"], r["node"]): (r["size"], r["found"]) for r in ce.isolation_recount(sample, table).collect()}
    assert found == {(0, 0): (4, 4), (0, 1): (3, 2), (0, 2): (1, 2), (1, 0): (4, 1)}
