import pytest
import random

from pyspark.sql import functions as F

from tallyrank.operators import ordered, split
from tallyrank.session import scratch_path
from tallyrank.operators.ordered import bucket_of, group_percentiles, prefix_sums, rank_brackets, values_at_ranks


def test_split_takes_the_least_hashes_of_each_label(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    parts = split.train_test_split(rows, "y", ["id"], 0.2).toPandas()
    sizes = parts.groupby(["y", "split"]).size()
    for y, n in parts.groupby("y").size().items():
        assert sizes[y, "test"] == int(n * 0.2 + 0.5)
    again = split.train_test_split(rows.repartition(5), "y", ["id"], 0.2).toPandas()
    merged = parts.merge(again, on="id")
    assert (merged["split_x"] == merged["split_y"]).all()


def test_split_of_a_tiny_class_may_leave_its_test_part_empty(spark):
    rows = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(50)], "id long, y int")
    parts = split.train_test_split(rows, "y", ["id"], 0.2).toPandas()
    assert len(parts) == 50
    assert (parts[parts.y == 1]["split"] == "train").all()


def test_folds_cover_every_row_once_and_keep_the_mix(spark):
    rows = spark.range(500).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    folds = split.stratified_folds(rows, "y", ["id"], 5).toPandas()
    assert len(folds) == 500
    assert set(folds.groupby(["y", "fold"]).size()[1]) == {20}
    assert set(folds.groupby(["y", "fold"]).size()[0]) == {80}


def test_bucket_of_counts_cuts_at_or_below(spark):
    cuts = [0.1, 0.2, 0.2000001, 0.5, 0.9]
    values = [-1.0, 0.1, 0.15, 0.2, 0.3, 0.5, 0.95]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(bucket_of(F.col("v"), cuts)).collect()]
    assert got == [sum(c <= v for c in cuts) for v in values]


def test_prefix_sums_with_cuts_from_skewed_data(spark):
    rng = random.Random(1)
    values = sorted({rng.random() ** 8 for _ in range(400)})
    df = spark.createDataFrame([("m", v, i) for i, v in enumerate(values)], "g string, v double, n long")
    cuts = ordered.range_cuts(df, "v", 16)
    got = prefix_sums(df, "g", "v", ["n"], bucket_of(F.col("v"), cuts)).orderBy("v").collect()
    total = 0
    for row in got:
        total += row["n"]
        assert row["cum_n"] == total
        assert row["all_n"] == sum(range(len(values)))


def test_values_at_ranks_narrows_until_the_window_fits(spark):
    values = [(i * 7919 % 10007) / 10 for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    n, found = values_at_ranks(df, "v", [0, 10, 2500, 4999], window=100)
    assert n == 5000
    assert found == [sorted(values)[r] for r in (0, 10, 2500, 4999)]


def test_group_percentiles_by_index_with_a_hot_group(spark):
    rows = [("hot", float(i * 31 % 997)) for i in range(3000)] + [("cold", float(i)) for i in range(100)]
    rows += [("one", 5.0)] + [("same", 2.0)] * 40
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["share"]): r["v"] for r in
           group_percentiles(df, "g", "v", [0.5, 0.95, 0.99], slack=20).collect()}
    for g in ("hot", "cold", "one", "same"):
        ordered_values = sorted(v for k, v in rows if k == g)
        for s in (0.5, 0.95, 0.99):
            assert got[g, s] == ordered_values[int(len(ordered_values) * s)]
    # The index rule on a hundred values: 51st, 96th and 100th.
    assert [got["cold", s] for s in (0.5, 0.95, 0.99)] == [50.0, 95.0, 99.0]


@pytest.mark.parametrize("numbers", [
    [float(i % 997) * 10.0 ** (i % 7 - 3) for i in range(6_000)], [1.7e308, -1.7e308, 0.0, 5.0] * 9, [2.0] * 500,
    [2.0 ** 60 + i for i in range(0, 9_000, 256)]], ids=["spread", "ends-of-doubles", "one-value", "close-together"])
@pytest.mark.parametrize("cast", ["double", "bigint"])
def test_brackets_hold_the_rank_and_few_rows(spark, numbers, cast):
    df = spark.createDataFrame([("a", v, 1 + i % 3) for i, v in enumerate(numbers)], "g string, v double, w int")
    df = df.withColumn("v", F.expr(f"cast(greatest(-9e18, least(9e18, v)) as {cast})"))
    wanted = spark.createDataFrame([("a", k, n) for k, n in enumerate([1, 2, 700, 10 ** 9])], "g string, k int, need bigint")
    found = {r["k"]: r for r in rank_brackets(df, ["g"], ["g", "k"], "v", "w", wanted, slack=12).collect()}
    rows = sorted((r["v"], r["w"]) for r in df.collect())
    for k, need in enumerate([1, 2, 700, 10 ** 9]):
        r = found[k]
        need = min(need, sum(w for _, w in rows))
        inside = [v for v, _ in rows if r["low"] <= v <= r["high"]]
        assert r["need"] == need and r["below"] == sum(w for v, w in rows if v < r["low"]) < need
        assert sum(w for v, w in rows if v <= r["high"]) >= need
        assert len(inside) <= 12 or inside[0] == inside[-1] or float(inside[0]) == float(inside[-1])


def test_no_task_orders_more_than_the_slack(spark):
    """One group of many distinct values: what the window of the percentiles reads is bounded."""
    df = spark.range(300_000).select(F.lit("hot").alias("g"), F.expr("id * 7 % 300007 * 0.5").alias("v"))
    got = {r["share"]: r["v"] for r in group_percentiles(df, "g", "v", [0.5, 0.99], slack=1_000).collect()}
    values = sorted(i * 7 % 300_007 * 0.5 for i in range(300_000))
    assert got == {s: values[int(300_000 * s)] for s in (0.5, 0.99)}
    distinct = df.groupBy("g", "v").agg(F.count("*").alias("w"))
    wanted = spark.createDataFrame([("hot", 150_001)], "g string, need bigint")
    r = rank_brackets(distinct, ["g"], ["g"], "v", "w", wanted, slack=1_000).first()
    assert distinct.filter(F.col("v").between(r["low"], r["high"])).count() <= 1_000


def test_a_split_keeps_null_labels_and_can_be_stored(spark):
    rows = spark.range(600).select("id", F.expr("nullif(cast(id % 3 as int), 2)").alias("y"))
    fitted = split.StratifiedSplit("y", ["id"], [0.25], 5).fit(rows)
    path = scratch_path(spark, "split-test")
    fitted.save(spark, path)
    parts = [s.apply(rows).toPandas() for s in (fitted, split.StratifiedSplit.load(spark, path))]
    assert parts[0].equals(parts[1])
    counts = parts[0].groupby("y", dropna=False)["part"].apply(lambda p: (p == 0).sum())
    assert list(counts) == [50, 50, 50]
