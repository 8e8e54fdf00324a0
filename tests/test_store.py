"""Append-only stores and the model registry."""

from pyspark.sql import functions as F

from tallyrank.session import scratch_path
from tallyrank.sources.store import ModelRegistry, Store, model_entries


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"r{i}") for i in ids], "id int, name string")


def test_a_run_adds_its_rows_once_and_failed_runs_add_none(spark):
    store = Store(spark, scratch_path(spark, "store"), "id bigint, name string, extra double")
    assert store.read().count() == 0 and store.read().columns == ["id", "name", "extra", "run_id"]
    withs = lambda *ids: rows(spark, *ids).withColumn("extra", F.lit(1))
    store.append(withs(1, 2), "a")
    store.stage(withs(7))  # fails before it is named
    store.append(withs(1, 2), "a")
    store.append(withs(2, 3), "b")
    store.append(withs(), "empty")
    assert sorted((r["id"], r["run_id"]) for r in store.read().collect()) == [(1, "a"), (2, "a"), (2, "b"), (3, "b")]
    assert dict(store.read().dtypes) == {"id": "bigint", "name": "string", "extra": "double", "run_id": "string"}


def test_of_two_tries_at_once_the_first_named_counts(spark):
    store = Store(spark, scratch_path(spark, "store"), "id bigint, name string")
    one, two = store.stage(rows(spark, 1)), store.stage(rows(spark, 2))
    store.name("a", two)
    store.name("a", one)
    assert [r["id"] for r in store.read().collect()] == [2] and store.runs().count() == 1


def test_only_named_folders_are_scanned(spark):
    store = Store(spark, scratch_path(spark, "store"), "id bigint, name string")
    store.append(rows(spark, 1), "a")
    store.stage(rows(spark, 2))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters")[1].split("]")[0]


def test_versions_rise_and_the_newest_is_read(spark):
    registry = ModelRegistry.at(spark, scratch_path(spark, "models"))
    metrics = lambda x: spark.createDataFrame([("a", x, 1.0), ("b", 0.5, None)], "model string, auc double, f1 double")
    for run, x in (("1", 0.6), ("2", 0.7), ("2", 0.9)):
        registry.register(model_entries(metrics(x), {"a": "linear"}, 10, ["x", "y"], settings={"depth": 6}, train_seconds=1.5), run)
    registry.register(model_entries(metrics(0.8).filter("model = 'a'"), {"a": "linear"}, 20, ["x", "y"]), "3")
    got = {r["model"]: r for r in registry.latest().collect()}
    a, b = got["a"], got["b"]
    assert (a["version"], a["entries"], a["metrics"]["auc"], a["dataset_size"], a["kind"]) == (3, 3, 0.8, 20, "linear")
    assert (b["version"], b["entries"], b["metrics"], b["kind"]) == (2, 2, {"auc": 0.5, "f1": None}, None)
    assert b["settings"] == {"depth": "6"} and b["features"] == ["x", "y"] and b["train_seconds"] == 1.5 and a["trained_at"] is not None
