"""Boosted trees against a plain in-memory form; losses, patience and weights."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrank.operators.boosting import UNIT, BoostedTrees, BoostSettings, _Held, _Tree, equal_edges, fit, split_gains
from tallyrank.session import scratch_path


def data(n=600, d=5, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=n) > 0.4).astype(int)
    return x, y


def frame(spark, x, y, held=None):
    table = {"id": np.arange(len(x)), "x": list(x), "class": y}
    schema = "id long, x array<double>, class int"
    if held is not None:
        table["held_out"] = held
        schema += ", held_out boolean"
    return spark.createDataFrame(pd.DataFrame(table), schema).repartition(3)


def plain(x, y, edges, s):
    """Scores after each round, every row and column used."""
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1)
    most = max(len(e) for e in edges) + 1
    score, out = np.zeros(len(x)), []
    w = np.where(y > 0, s.positive_weight, 1.0)

    def grow(rows, depth, g, h):
        best = None
        if depth < s.depth:
            hists = [[np.bincount(bins[rows, f], v[rows], most) for f in range(x.shape[1])] for v in (g, h)]
            gains = split_gains(*map(np.array, hists), s)
            f, cut = divmod(int(np.argmax(gains)), most)
            if gains[f, cut] > 1e-9:
                best = f, cut
        if best is None:
            score[rows] += s.rate * -g[rows].sum() / (h[rows].sum() + s.ridge)
            return
        below = bins[rows, best[0]] <= best[1]
        grow(rows[below], depth + 1, g, h)
        grow(rows[~below], depth + 1, g, h)

    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-score))
        grow(np.arange(len(x)), 0, w * (p - y), w * p * (1 - p))
        out.append(1 / (1 + np.exp(-score)))
    return out


def loss(p, y, weight=1.0):
    w = np.where(y > 0, weight, 1.0)
    return (w * -np.log(np.where(y > 0, p, 1 - p))).sum() / w.sum()


@pytest.mark.parametrize("weight, task_values", [(1.0, 4_000_000), (4.0, 500)], ids=["one-task", "weighted-in-many-tasks"])
def test_equals_the_plain_form_and_its_losses(spark, weight, task_values):
    x, y = data()
    s = BoostSettings(rounds=10, depth=3, rate=0.3, row_share=1.0, column_share=1.0, bins=16, positive_weight=weight)
    edges = equal_edges(x.min(axis=0).tolist(), x.max(axis=0).tolist(), 16)
    df = frame(spark, x, y)
    model = fit(df, s, edges, task_values=task_values)
    expected = plain(x, y, edges, s)
    got = df.select("id", model.probability().alias("p")).toPandas().sort_values("id")["p"].to_numpy()
    assert model.rounds == 10 and np.abs(got - expected[-1]).max() < 1e-5
    assert [h[1] for h in model.history[1:]] == pytest.approx([loss(p, y, weight) for p in expected], abs=1e-5)
    three = df.select("id", model.probability(rounds=3).alias("p")).toPandas().sort_values("id")["p"].to_numpy()
    assert np.abs(three - expected[2]).max() < 1e-5


def test_patience_keeps_the_best_round_and_held_out_rows_are_not_trained_on(spark):
    x, y = data(400, 4, 3)
    y[::3] = np.random.default_rng(0).integers(0, 2, len(y[::3]))
    held = np.arange(400) % 4 == 0
    s = BoostSettings(rounds=60, depth=4, rate=0.4, patience=5, bins=16)
    model = fit(frame(spark, x, y, held), s)
    losses = [h[2] for h in model.history]
    assert model.rounds == int(np.argmin(losses)) and len(losses) == model.rounds + 1 + 5
    p = frame(spark, x, y).select("id", model.probability().alias("p")).toPandas().sort_values("id")["p"].to_numpy()
    assert loss(p[held], y[held]) == pytest.approx(min(losses), abs=1e-6)
    other = y.copy()
    other[held] = 1 - other[held]
    first = lambda m: m.nodes[m.nodes["tree"] == 0][["feature", "threshold"]].to_numpy().tolist()
    again = fit(frame(spark, x, other, held), BoostSettings(rounds=2, depth=4, rate=0.4, bins=16, patience=99))
    assert not len(again.nodes) or first(again) == first(model)


def test_rows_may_lie_anywhere_and_models_can_be_stored(spark):
    x, y = data(300)
    x[5, 2] = np.nan
    s = BoostSettings(rounds=9, depth=3)
    one, two = fit(frame(spark, x, y), s), fit(frame(spark, x, y).repartition(7), s, task_values=400)
    pd.testing.assert_frame_equal(one.nodes, two.nodes)
    path = scratch_path(spark, "boosted-test")
    one.save(spark, path)
    again = BoostedTrees.load(spark, path)
    pd.testing.assert_frame_equal(one.nodes, again.nodes, check_dtype=False)
    assert again.history == one.history and (again.rate, again.width) == (one.rate, one.width)
    df = frame(spark, x, y)
    both = df.select(one.probability().alias("a"), again.probability().alias("b"))
    assert both.filter(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0
    kinds = one.importance()
    splits = one.nodes[one.nodes["feature"] >= 0]
    assert kinds[kinds["kind"] == "weight"]["value"].sum() == len(splits)
    assert kinds[kinds["kind"] == "total_gain"]["value"].sum() == pytest.approx(splits["gain"].sum())


def test_weights_move_scores_up_and_odd_tables_fit(spark):
    x, y = data(300)
    df = frame(spark, x, y)
    mean = lambda m: df.agg(F.avg(m.probability())).first()[0]
    assert mean(fit(df, BoostSettings(rounds=3, positive_weight=8.0))) > mean(fit(df, BoostSettings(rounds=3))) + 0.02
    none = fit(df.filter("id < 0"), BoostSettings(rounds=3))
    assert none.rounds == 0 and df.agg(F.max(none.probability())).first()[0] == 0.5
    alike = fit(frame(spark, np.ones((20, 2)), np.arange(20) % 2), BoostSettings(rounds=3))
    assert alike.rounds == 0


def test_more_rounds_of_rows_that_one_task_holds_take_no_more_jobs(spark):
    x, y = data(300)
    df, sc = frame(spark, x, y), spark.sparkContext
    edges = equal_edges(x.min(axis=0).tolist(), x.max(axis=0).tolist(), 16)

    def jobs(rounds):
        sc.setJobGroup(f"boosted-{rounds}", "")
        model = fit(df, BoostSettings(rounds=rounds, depth=3, bins=16), edges)
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert model.rounds == rounds
        return len(sc.statusTracker().getJobIdsForGroup(f"boosted-{rounds}"))

    assert jobs(20) == jobs(3)


def test_sums_too_large_for_doubles_stay_whole_numbers():
    y = np.arange(300) % 2
    s = BoostSettings(row_share=1.0, positive_weight=2.0 ** 27 + 1)
    held = _Held(s, 1, 2, y, np.zeros(300, bool), np.arange(300), np.zeros((300, 1), np.uint8), np.zeros(300))
    _, h, lost = held.sums(0, 0, _Tree.of(1), np.array([0]))
    assert h[0, 0, 0] == (150 * ((2 ** 27 + 1) * 2 ** 22) + 150 * 2 ** 22) * UNIT and lost[-2] == (0, 0)
