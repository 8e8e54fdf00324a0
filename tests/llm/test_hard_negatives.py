"""Strassen products and mined negatives against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrank.llm.hard_negatives import best, hard_negatives, product

SCHEMA = "vec_id long, embedding array<double>, label int, score string, place int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 64, 65), (40, 129, 70), (2, 0, 3), (100, 37, 5)])
def test_products_are_exact_modulo_two_to_the_64(shape):
    rng = np.random.default_rng(3)
    m, k, n = shape
    for top in (200, 2 ** 62):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (n, k))
        for leaf in (2, 8, 32):
            assert (product(a, b, leaf) == a @ b.T).all()


def test_best_breaks_ties_by_id():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(12)
        scores, ids = np.array([rng.choice([-2 ** 63, -1, 0, 5]) for _ in range(n)], np.int64), np.array(rng.sample(range(99), n), np.int64)
        got = [(int(scores[i]), int(ids[i])) for i in best(scores, ids, 4)]
        assert got == sorted(zip(scores.tolist(), ids.tolist()), key=lambda r: (-r[0], r[1]))[:4]


def plain(rows, every, n_pos, n_neg):
    kept = {(i, l, tuple(math.floor(256 * x) for x in e)) for i, e, l in rows
            if i is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for i, l, v in kept:
        if i % every == 0:
            scores = [(sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if len(w) == len(v)]
            order = sorted(scores, key=lambda s: (-s[0], s[1]))
            for p, pid, _ in [s for s in order if s[2] == l and s[1] != i][:n_pos]:
                fit = [s for s in order if s[2] != l and 80 * p <= 100 * s[0] <= 100 * p][:n_neg]
                out += [(i, pid, r, s[1], p, s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out)


def drawn(n, dims, labels, grid=8):
    rng = random.Random(n)
    return [(i, [rng.randrange(-grid, grid + 3) / grid for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


ODD = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 0.5], 1), (10, [1.0, 0.5], 1), (3, [1.0, 0.5], 2), (4, [1.0, 0.5], 2), (5, None, 2),
       (6, [1.0, 0.5], None), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 2), (9, [float("inf"), 1.0], 2), (None, [1.0, 0.5], 2),
       (20, [], 1), (21, [], 1), (22, [], 2), (30, [1.0], 3), (31, [0.5, 0.5], 1), (32, [0.9, 0.5], 2), (40, [-1.0, -1.0], 4), (41, [1.0, 1.0], 4)]


@pytest.mark.parametrize("rows, slice_values", [(drawn(400, 7, 3), 4_000_000), (drawn(400, 7, 3), 60), (drawn(300, 3, 2, 1), 4_000_000), (ODD, 4_000_000)],
                         ids=["one-slice", "many-slices", "ties", "odd"])
def test_equals_plain_loops(spark, rows, slice_values):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = hard_negatives(table, every=10, slice_values=slice_values)
    assert sorted(map(tuple, got.collect())) == plain(rows, 10, 5, 5)


def test_another_label_and_no_rows(spark):
    rows = drawn(200, 4, 4)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = hard_negatives(table, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label")), every=20)
    changed = [(i, e, (l + 1) % 4 if i % 7 == 0 else l) for i, e, l in rows]
    assert sorted(map(tuple, got.collect())) == plain(changed, 20, 5, 5)
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
