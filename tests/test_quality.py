import pytest
from pyspark.sql import functions as F

from tallyrank.contract import CARD_FEATURES
from tallyrank.operators import quality, scaling
from tallyrank.sources.transactions import CARD_SCHEMA, read_transactions


def test_profile_counts_copies_missing_and_infinite(spark):
    rows = [(1.0, 1), (1.0, 1), (1.0, 1), (None, 0), (float("nan"), 0), (float("inf"), 0)]
    got = quality.profile(spark.createDataFrame(rows, "v double, y int")).first()
    assert got.asDict() == {
        "total_records": 6, "total_columns": 2, "missing_values": 2,
        "duplicate_records": 2, "infinite_values": 1,
    }
    empty = quality.profile(spark.createDataFrame([], "v double, y int")).first()
    assert empty["total_records"] == 0 and empty["duplicate_records"] == 0


def test_clean_drops_copies_then_missing_but_keeps_infinity(spark):
    rows = [(1.0, 1), (1.0, 1), (None, 0), (float("nan"), 0), (float("inf"), 0)]
    got = quality.clean(spark.createDataFrame(rows, "v double, y int")).collect()
    assert sorted(tuple(r) for r in got) == [(1.0, 1), (float("inf"), 0)]


def test_label_domain_and_columns(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (None,)], "y int")
    bad = {r["label"]: r["records"] for r in quality.label_domain(df, "y").collect()}
    assert bad == {7: 1, None: 1}
    issues = quality.required_columns(df, ["y", "time"]).collect()
    assert [(r["column"], r["records"]) for r in issues] == [("time", 4)]


def test_record_reasons(spark):
    rows = [(1.0, 2.0, "xgboost"), (-1.0, None, "nope"), (0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "time double, amount double, model_name string")
    got = [r["issues"] for r in quality.validate_records(df, ["time", "amount"]).collect()]
    assert got == [[], ["amount:missing", "time:negative", "model_name:unknown"], []]


def test_batch_size_bounds(spark):
    df = spark.range(1001).select(F.lit("big").alias("b")).union(
        spark.range(1000).select(F.lit("full")))
    got = {r["batch_id"]: r["accepted"] for r in quality.batch_sizes(df, "b").collect()}
    assert got == {"big": False, "full": True}


def test_card_csv_is_read_with_its_schema_and_checked(spark, tmp_path):
    header = ",".join([*CARD_FEATURES, "Class"])
    line = ",".join(["0.5"] * 30 + ["1"])
    path = tmp_path / "cards.csv"
    path.write_text(f"{header}\n{line}\n{line}\n")
    df = read_transactions(spark, str(path))
    assert df.schema == CARD_SCHEMA and df.count() == 2
    assert quality.feature_order_matches(df, CARD_FEATURES, "Class")
    short = tmp_path / "short.csv"
    short.write_text("Time,Amount,Class\n1.0,2.0,0\n")
    with pytest.raises(ValueError, match="V1"):
        read_transactions(spark, str(short))


def test_card_csv_whose_files_order_their_columns_differently_is_refused(spark, tmp_path):
    names = [*CARD_FEATURES, "Class"]
    values = ["0.5"] * 30 + ["1"]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    (tmp_path / "b.csv").write_text(",".join(names[::-1]) + "\n" + ",".join(values[::-1]) + "\n")
    with pytest.raises(Exception, match="header"):
        read_transactions(spark, str(tmp_path)).collect()


def test_scaling_uses_population_deviation_and_survives_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = scaling.scale(df, ["a", "b"], scaling.scaler_state(df, ["a", "b"])).collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        scaling.scale(df.drop("b"), ["a", "b"], scaling.scaler_state(df, ["a", "b"]))
    vec = df.select(F.array("a", "b").alias("x"))
    got = scaling.scale_vector(vec, scaling.vector_state(vec)).collect()
    assert [[round(v, 9) for v in r["x"]] for r in got] == [[-1.0, 0.0], [1.0, 0.0]]


def test_inference_stops_on_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    state = scaling.scaler_state(df, ["a"])
    bad = spark.createDataFrame([(None,)], "a double")
    with pytest.raises(Exception, match="missing after scaling"):
        scaling.inference_frame(bad, ["a"], state).collect()
