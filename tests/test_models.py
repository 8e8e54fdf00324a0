import json
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.functions.vectors import with_names
from tallyrank.operators import balancing, isolation
from tallyrank.operators.neighbours import nearest_neighbours
from tallyrank.plans import training as tr
from tallyrank.registry import models
from tallyrank.session import scratch_path


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        positive = i % 8 == 0
        centre = 1.5 if positive else 0.0
        rows.append((i, [float(v) for v in rng.normal(centre, 1.0, 4)], int(positive)))
    return rows


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame(points, "id long, x array<double>, class int").repartition(3)


@pytest.mark.parametrize("limits", [{}, {"broadcast_values": 4, "block_rows": 32}])
def test_neighbours_match_brute_force_on_both_paths(frame, points, limits):
    got = {}
    for r in nearest_neighbours(frame, frame, 5, **limits).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["neighbour"], r["distance"])
    x = {i: np.array(v) for i, v, _ in points}
    for i in x:
        brute = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in x if j != i)[:5]
        assert [got[i][k + 1][0] for k in range(5)] == [j for _, j in brute]
        assert [got[i][k + 1][1] for k in range(5)] == pytest.approx([d for d, _ in brute])


def test_neighbours_of_many_equal_points_stay_whole(spark):
    rows = [(i, [1.0, 2.0]) for i in range(90)] + [(1000 + i, [5.0, float(i)]) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = nearest_neighbours(df, df, 3, broadcast_values=2, block_rows=16)
    assert got.count() == 300
    assert got.filter("id < 1000").agg(F.max("distance")).first()[0] == 0.0


@pytest.mark.parametrize("parts", [1, 3, 13])
@pytest.mark.parametrize("limits", [{}, {"broadcast_values": 2, "block_rows": 16}])
def test_equal_points_are_told_apart_by_id_however_they_are_dealt(spark, parts, limits):
    rows = [(100 + i, [1.0, 2.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(parts)
    got = nearest_neighbours(df, df, 3, **limits).orderBy("id", "rank").collect()
    for i in range(60):
        brute = [j for j in range(100, 160) if j != 100 + i][:3]
        assert [r["neighbour"] for r in got[3 * i : 3 * i + 3]] == brute


@pytest.mark.parametrize("limits", [{}, {"broadcast_values": 8, "block_rows": 32}])
def test_points_close_together_far_from_the_origin_keep_their_order(spark, limits):
    x = 1e5 + 1e-4 * np.random.default_rng(8).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in nearest_neighbours(df, df, 4, **limits).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    for i in range(60):
        brute = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(60) if j != i)[:4]
        assert [got[i][k + 1] for k in range(4)] == [j for _, j in brute]


@pytest.mark.parametrize("method", ["smote", "adasyn"])
def test_synthetic_rows_lie_between_their_parents(frame, points, method):
    made = getattr(balancing, method)(frame).collect()
    x = {i: (np.array(v), y) for i, v, y in points}
    assert len({(r["parent"], r["copy"]) for r in made}) == len(made)
    for r in made:
        a, b = x[r["parent"]], x[r["neighbour"]]
        assert a[1] == b[1] == 1 and 0 <= r["share"] < 1
        assert np.allclose(r["x"], a[0] + r["share"] * (b[0] - a[0]))
    if method == "smote":
        assert len(made) == 300
        per = [sum(r["parent"] == i for r in made) for i, _, y in points if y]
        assert max(per) - min(per) <= 0 or max(per) - min(per) == 1


def test_many_copies_are_spread_in_chunks(frame, monkeypatch):
    whole = sorted((r["parent"], r["copy"], r["share"]) for r in balancing.smote(frame).collect())
    monkeypatch.setattr(balancing, "CHUNK", 2)
    cut = sorted((r["parent"], r["copy"], r["share"]) for r in balancing.smote(frame).collect())
    assert whole == cut


def test_balancing_refuses_unknown_methods(frame):
    with pytest.raises(ValueError):
        balancing.balance(frame, method="other")


def test_isolation_forest_ranks_an_outlier_and_survives_storage(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 3)]) for i in range(600)] + [(600, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    forest = isolation.fit(df, trees=25, sample=64, contamination=0.01)
    assert forest.nodes.groupby("tree").size().max() <= 2 * 64 - 1
    scored = forest.score(df).withColumn("p", forest.probability()).toPandas()
    assert scored.loc[scored.raw_score.idxmin(), "id"] == 600
    assert scored.p.between(0, 1).all() and scored.p.max() == 1.0
    assert forest.offset == pytest.approx(np.percentile(scored.raw_score, 1.0))
    path = scratch_path(spark, "forest-test")
    forest.save(spark, path)
    again = isolation.IsolationForest.load(spark, path).score(df).toPandas()
    assert np.allclose(again.sort_values("id").raw_score, scored.sort_values("id").raw_score)


def test_tree_samples_hold_the_wanted_rows_when_there_are_plenty(spark):
    df = spark.range(20000).select("id", F.array(F.col("id").cast("double")).alias("x"))
    counts = isolation.tree_samples(df, 20000, 10, 64, 1).groupBy("tree").count().collect()
    assert sorted(r["tree"] for r in counts) == list(range(10))
    assert {r["count"] for r in counts} == {64}


@pytest.mark.parametrize("n", [2560, 2561, 20000])
def test_trees_are_dealt_by_one_rule_at_every_size(spark, n):
    df = spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("x"))
    got = {(r["tree"], r["id"]) for r in isolation.tree_samples(df, n, 10, 64, 1).collect()}
    pairs = df.select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tree"))
    first = {}
    for r in pairs.withColumn("h", F.xxhash64("id", "tree", F.lit(1))).collect():
        first.setdefault(r["tree"], []).append((r["h"], r["id"]))
    assert got == {(t, i) for t, own in first.items() for _, i in sorted(own)[:64]}


def test_mean_path():
    assert isolation.mean_path(1) == 0.0 and isolation.mean_path(2) == 1.0
    assert isolation.mean_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 510 / 256)


@pytest.fixture(scope="module")
def run(frame):
    small = tr.Settings(forest_trees=5, forest_depth=4, forest_bins=32, rounds=3, depth=2,
                        isolation_trees=10, isolation_sample=32, folds=2, max_iter=20)
    return tr.TrainingRun(frame, small)


def test_every_train_row_is_scored_once_out_of_fold(run):
    scored = run.out_of_fold.toPandas()
    assert sorted(scored.id) == sorted(r["id"] for r in run.train.select("id").collect())
    for name in tr.BASES:
        assert scored[name].between(0, 1).all()


def test_models_of_the_whole_part_are_fitted_while_those_of_the_folds_are(frame, run):
    began = threading.Event()

    class Watched(tr.TrainingRun):
        @property
        def bases(self):
            began.set()
            return run.bases

        @property
        def out_of_fold(self):
            assert began.wait(20)
            return run.out_of_fold

    weights = Watched(frame, run.settings).ensemble.weights()
    assert [w for _, w in weights] == pytest.approx([w for _, w in run.ensemble.weights()])


def test_models_learn_and_the_ensemble_survives_storage(spark, run):
    areas = {r["model"]: r["roc_auc"] for r in
             tr.area(run.test_scores, [*tr.BASES, "stacking_ensemble"]).collect()}
    assert areas["logistic_regression"] > 0.8 and areas["stacking_ensemble"] > 0.7
    path = scratch_path(spark, "ensemble-test")
    run.ensemble.save(spark, path)
    again = tr.Ensemble.load(spark, path).score(run.test).toPandas().sort_values("id")
    before = run.test_scores.toPandas().sort_values("id")
    assert np.allclose(again.stacking_ensemble, before.stacking_ensemble)


@pytest.mark.parametrize("name", ["score_transactions", "base_model_scores", "score_single_model", "iforest_scores",
                                  "stream_score"])
def test_every_row_is_scored_by_the_stored_model(spark, run, points, monkeypatch, name):
    monkeypatch.setattr(models, "_run", lambda spark, root: run)
    got = getattr(models, name)(spark, "").toPandas()
    if name == "score_single_model":
        whole = run.all_scores.toPandas().set_index("id")
        for base in tr.BASES:
            own = got[got["model"] == base].set_index("id").sort_index()
            assert list(own.index) == [i for i, _, _ in points]
            assert np.allclose(own.p, whole.loc[own.index][base], atol=1e-6) and (own.label == (whole.loc[own.index][base] > 0.5)).all()
        return
    got = got.set_index("id").sort_index()
    assert list(got.index) == [i for i, _, _ in points]
    if name == "base_model_scores":
        assert [json.loads(t) for t in got.scores] == got[models.ALL].to_dict("records")
    if name in ("score_transactions", "stream_score"):
        held = run.test_scores.toPandas().set_index("id").stacking_ensemble
        assert np.allclose(got.loc[held.index].p, held, atol=1e-6)


def test_the_scaler_is_stored_and_refuses_other_features(spark, run, points):
    train = {r["id"] for r in run.train.select("id").collect()}
    x = np.array([v for i, v, _ in points if i in train])
    _, scaler = run.stored_base("logistic_regression")
    assert scaler == run.scaler and len(scaler.features) == 4
    assert np.allclose(scaler.mean, x.mean(axis=0)) and np.allclose(scaler.scale, x.std(axis=0))
    for wrong in ([1.0, 2.0], None):
        with pytest.raises(Exception, match="features of the scaler"):
            scaler.apply(spark.createDataFrame([(1, wrong)], "id long, x array<double>")).collect()


def test_features_are_known_by_name(spark, run, frame):
    named = with_names(frame, ["a", "b", "c", "d"])
    scaler = tr.Scaler.fit(named)
    path = scratch_path(spark, "scaler-test")
    scaler.save(spark, path)
    scaler = tr.Scaler.load(spark, path)
    assert scaler.features == ["a", "b", "c", "d"]
    x = {r["id"]: r["x"] for r in scaler.apply(named).collect()}
    columns = [F.get("x", F.lit(i)).alias(n) for i, n in ((2, "c"), (0, "a"), (3, "d"), (1, "b"))]
    assert {r["id"]: r["x"] for r in scaler.apply(frame.select("id", *columns)).collect()} == x
    with pytest.raises(ValueError, match="position 1 of x is c, not b"):
        scaler.apply(with_names(frame, ["a", "c", "b", "d"]))
    with pytest.raises(ValueError, match="missing features: b, d"):
        scaler.apply(frame.select("id", *columns).drop("b", "d"))


def test_a_stored_run_finds_its_test_rows_again(spark, run, frame):
    path = scratch_path(spark, "run-test")
    run.save(path)
    metrics, report = tr.evaluate_stored(spark, path, frame.repartition(5))
    long = tr.long_scores(run.test_scores, [*tr.BASES, "stacking_ensemble"]).toPandas()
    for r in report.collect():
        own = long[long["model"] == r["model"]]
        hit, actual = (own["p"] > 0.5) == (r["class"] == 1), own["y"] == r["class"]
        both = (hit & actual).sum()
        assert r["support"] == actual.sum() and r["recall"] == pytest.approx(both / actual.sum())
        assert r["precision"] == pytest.approx(both / hit.sum() if hit.sum() else 0.0)
    before = {r["model"]: r["roc_auc"] for r in tr.area(run.test_scores, [*tr.BASES, "stacking_ensemble"]).collect()}
    assert {r["model"]: r["roc_auc"] for r in metrics.collect()} == pytest.approx(before)


def test_weights_of_classes_reach_the_fits(spark):
    rows = spark.createDataFrame([(i, [float(i % 7)], int(i % 5 == 0)) for i in range(100)], "id long, x array<double>, class int")
    weights = {r["class"]: r["weight"] for r in tr.class_weighted(rows).select("class", "weight").distinct().collect()}
    assert weights == {0: 100 / 160, 1: 100 / 40}
    even, fair = (tr.fit_logistic(df, 100, tr.Settings(max_iter=50), w) for df, w in (
        (tr.with_features(rows), None), (tr.with_features(tr.class_weighted(rows)), "weight")))
    assert fair.intercept > even.intercept + 0.5


FITTED = ["train_isolation_forest", "train_logistic", "train_logistic_l1", "train_random_forest", "train_gbt", "feature_importance",
          "train_stacking", "ensemble_weights", "oof_scores", "training_report", "training_history", "training_summary",
          "reload_and_evaluate"]


@pytest.mark.parametrize("name", FITTED)
def test_queries_of_fitted_models_give_sound_rows(spark, run, frame, monkeypatch, name):
    monkeypatch.setattr(models, "_run", lambda spark, root: run)
    monkeypatch.setattr(models, "_rows", lambda spark, root: frame)
    got = getattr(models, name)(spark, "").toPandas()
    assert len(got) and not got.drop(columns=["held_out_loss", "trees"], errors="ignore").isna().any().any()
    if name == "train_gbt":
        kept = got[got["kept"]]
        assert got["held_out_loss"].min() == kept["held_out_loss"].iloc[-1] and list(got["round"]) == list(range(len(got)))
    if name in ("oof_scores", "training_report", "training_summary", "reload_and_evaluate"):
        rates = got[[c for c in got.columns if c in (*tr.BASES, "train_auc", "test_auc", *models.HEADLINE)]]
        assert ((rates >= 0) & (rates <= 1)).all().all()
    if name == "training_summary":
        assert (got["version"] == 1).all() and got["timed"].all() and (got["dataset_size"] == run.train.count()).all()
    if name == "reload_and_evaluate":
        assert (got.groupby("model")["support"].sum() == run.test.count()).all()


def test_every_query_without_sql_is_named_in_a_test():
    from tallyrank.registry import ORACLES, QUERIES

    scored = ["score_transactions", "base_model_scores", "score_single_model", "iforest_scores", "stream_score"]
    assert set(QUERIES) - set(ORACLES) - {*FITTED, *scored} == {"als_scores", "recommend_learned"}


@pytest.mark.parametrize("name", ["als_scores", "recommend_learned"])
def test_learned_scores_lie_between_zero_and_one(spark, root, name):
    from tallyrank.registry import QUERIES

    got = QUERIES[name](spark, root).toPandas()
    column = "score" if name == "als_scores" else "hybrid"
    assert len(got) and got[column].between(0, 1).all()


def test_every_raw_row_scores_alike_after_storage_by_named_columns(spark, frame, points, monkeypatch):
    names = ["a", "b", "c", "d"]
    small = tr.Settings(forest_trees=3, forest_depth=3, forest_bins=16, rounds=2, depth=2, isolation_trees=5, isolation_sample=32,
                        folds=2, max_iter=10)
    again = tr.TrainingRun(with_names(frame, names), small)
    monkeypatch.setattr(models, "_run", lambda spark, root: again)
    monkeypatch.setattr(models, "FEATURES", names)
    got = models.model_roundtrip(spark, "").toPandas().sort_values("id")
    assert list(got["id"]) == [i for i, _, _ in points] and got["equal"].all() and got["in_range"].all()
