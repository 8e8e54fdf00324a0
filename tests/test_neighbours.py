"""Neighbours of two large sides: equal to brute force, and few pairs where vectors fall into clusters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrank.operators.neighbours import Cells, CellSearch, nearest_neighbours


def brute(ids, x, q_ids, q, k):
    out = {}
    for i, v in zip(q_ids, q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        out[i] = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame(pd.DataFrame({"id": ids, "x": list(x)}), "id long, x array<double>").repartition(3)


def ranked(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["id"], []).append((r["distance"], r["neighbour"]))
    return {i: [n for _, n in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize("spread", [6.0, 0.0], ids=["clusters", "one-cloud"])
def test_cells_find_what_brute_force_finds(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 64)) * spread
    x = centres[rng.integers(0, 30, 3_000)] + rng.normal(size=(3_000, 64))
    x[100:160] = x[5]  # a group of copies
    ids = rng.permutation(30_000)[:3_000]
    search = CellSearch(frame(spark, ids[:900], x[:900]), frame(spark, ids, x), 5, True, block_rows=256, cell_rows=64)
    got = ranked(search.found())
    expected = brute(ids, x, ids[:900], x[:900], 5)
    assert {i: v[:5] for i, v in got.items()} == expected
    if spread:
        first = search.first_visits()
        rows = search.base.groupBy("cell").count()
        reach = search._searched(first).groupBy("id").agg(F.sort_array(F.collect_list("distance"))[search.need - 1].alias("reach"))
        visits = first.union(search.other_visits(reach.fillna(float("inf"))))
        pairs = visits.join(rows, "cell").agg(F.sum("count")).first()[0]
        assert pairs < 0.05 * 900 * 3_000


def test_bounds_never_exceed_the_nearest_row():
    rng = np.random.default_rng(2)
    for far in (0.0, 1e6):
        x = far + rng.normal(size=(600, 12)) * rng.choice([0.01, 1.0], (600, 1))
        cells = Cells(x[:300], 5)
        cell = cells.of(x)
        along = x @ cells.directions
        cells.bounded_by([{"cell": c, "n": int((cell == c).sum()), "low": along[cell == c].min(axis=0), "high": along[cell == c].max(axis=0),
                           "radius": np.sqrt(((x[cell == c] - cells.centres[c]) ** 2).sum(axis=1)).max()} for c in np.unique(cell)])
        q = far + rng.normal(size=(40, 12))
        least = cells.least(q, cells.to_centres(q))
        for i in range(40):
            d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
            for j, c in enumerate(cells.held):
                assert least[i, j] <= d[cell == c].min()


@pytest.mark.parametrize("limit", [4_000_000, 200, 8], ids=["base-sent", "queries-sent", "cells"])
def test_every_way_gives_the_same(spark, limit):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 4)), 1)  # ties
    ids = np.arange(300)
    base, queries = frame(spark, ids, x), frame(spark, ids[:40], x[:40])
    got = nearest_neighbours(queries, base, 4, broadcast_values=limit, block_rows=32)
    assert ranked(got) == brute(ids, x, ids[:40], x[:40], 4)


def test_fewer_base_rows_than_asked_for_and_no_rows(spark):
    x = np.arange(6.0).reshape(3, 2)
    both = frame(spark, np.arange(3), x)
    assert ranked(nearest_neighbours(both, both, 5, broadcast_values=1)) == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    none = both.filter("id < 0")
    assert nearest_neighbours(both, none, 5).count() == 0
    assert nearest_neighbours(none, both, 5, broadcast_values=1).count() == 0
