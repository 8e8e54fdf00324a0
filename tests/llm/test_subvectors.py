"""Clusters against plain integer rounds; the dictionaries against the vectors they stand for."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyrank.llm.subvectors import blocks_of, clusters, codebook_of, whole

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def plain(rows, k, rounds, dims, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        names = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), n in zip(kept, names) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    names = assign()
    distance = [far(v, centroids[c]) for (_, v), c in zip(kept, names)]
    inertia = {c: sum(d for d, n in zip(distance, names) if n == c) for c in names}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(distance), digest[c]) for (i, _), c, d in zip(kept, names, distance)), key=str)


def drawn(n, dims, grid):
    rng = random.Random(n)
    return [(i, [rng.randrange(-grid, grid) / grid for _ in range(dims)]) for i in range(n)]


ODD = [(7, None), (8, []), (9, [1.0, None, 0.0]), (10, [float("nan"), 0.0, 0.0]), (11, [float("inf"), 0.0, 0.0]), (12, [1.0, 2.0]),
       (13, [0.5, 0.5, 0.5]), (13, [0.5, 0.5, 0.5]), (13, [0.25, 0.5, 0.5]), (None, [0.1, 0.2, 0.3]), (14, [-0.0, 0.0, 0.0])]


@pytest.mark.parametrize("rows, dims, entries", [
    (drawn(300, 6, 3), 6, 64), (drawn(300, 6, 200), 6, 16), (drawn(120, 4, 1000), 4, 4096), (ODD, 3, 4096), (drawn(5, 3, 9), 3, 64)],
    ids=["wide-blocks", "values-for-codes", "single-dimensions", "odd", "fewer-than-centroids"])
def test_equals_plain_rounds(spark, rows, dims, entries):
    table = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA).repartition(3)
    got = clusters(table, dims=dims, entries=entries, rounds=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 8, 4, dims)


def test_codes_stand_for_their_vectors(spark):
    rows = [(i, [x / 1024 for x in e]) for i, e in enumerate(np.random.default_rng(2).integers(0, 3, (200, 8)).tolist())]
    for row in rows[:100]:  # a dimension with too many values among the others
        row[1][4] = row[0] / 1024
    held = whole(spark.createDataFrame([(i, e, "x", 1) for i, e in rows], SCHEMA), 8, 1024)
    book = codebook_of(held, 8, 81)
    v = np.array([r["v"] for r in held.collect()])
    assert book.blocks == [(0, 4), (4, 5), (5, 8)] and book.words[1] is None
    assert len(book.words[0]) == len(np.unique(v[:, :4], axis=0)) < 81
    assert (book.decode(book.encode(v)) == v).all()


def test_blocks_stay_within_their_entries():
    assert blocks_of([2, 2, 2, 9, 1, 100, 3], 8) == [(0, 3), (3, 4), (4, 5), (5, 6), (6, 7)]


def test_no_rows_and_numbers_too_large(spark):
    assert clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        clusters(spark.createDataFrame([(1, [1e300], "x", 1)], SCHEMA), dims=1).collect()
