"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned from a sample turns a vector into bits, the signs of its turned
components.  A code is cut into substrings, each with an index of its own.  Two codes
within a Hamming radius agree, by the pigeonhole principle, in some substring up to a
share of the radius, so probing every index that far finds every code within it.  What
is found is ranked by the original vectors.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.session import materialize

#: Vectors that the rotation is learned from, at most.
SAMPLE = 4_096
#: Vectors in an index and queries in a block, about.
INDEXED, ASKED = 8_192, 1_024
SUBSTRINGS = 8
#: Share of the bits that may differ, and the candidates below which the radius grows.
RADIUS, CANDIDATES = 0.44, 400


def rotation(sample: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The sample's mean and the rotation whose signs lie nearest to its turned vectors."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    turn = np.linalg.svd(np.random.default_rng(7).normal(size=(sample.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(centred @ turn > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ centred)
        turn = (u @ v).T
    return mean, turn


def codes(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Bits of each vector, one byte per substring of up to eight bits."""
    return np.packbits((vectors - mean) @ turn > 0, axis=1)


@functools.lru_cache
def _flips(most: int) -> np.ndarray:
    """The bytes with at most ``most`` bits."""
    every = np.arange(256, dtype=np.uint8)
    return every[np.bitwise_count(every) <= most]


class Indexes:
    """One index for each byte of the codes, from its value to the rows that have it."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.order = [np.argsort(c, kind="stable") for c in code.T]
        self.start = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(code.T, self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most ``radius`` bits."""
        n, parts = self.code.shape
        share, rest = divmod(radius, parts)
        found = np.zeros(n, bool)
        for i in range(parts):
            # The first ``rest + 1`` substrings have the whole share, the others one less.
            reach = share if i <= rest else share - 1
            if reach < 0:
                continue
            for value in (code[i] ^ _flips(min(reach, 8))).tolist():
                found[self.order[i][self.start[i][value]:self.start[i][value + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.code[rows] ^ code).sum(axis=1) <= radius]


def _searched(learned: dict, k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = np.array(table.column("asked").to_pylist(), bool)
        vectors = np.array(table.column("v").to_pylist(), np.float64)
        names = table.column("place").to_numpy()
        queries, held = np.flatnonzero(asked), np.flatnonzero(~asked)
        out: list[tuple] = []
        if len(queries) and len(held):
            d = vectors.shape[1]
            mean, turn = learned.get(d) or (np.zeros(d), np.eye(d))
            base = vectors[held]
            index = Indexes(codes(base, mean, turn))
            for q, code in zip(queries, codes(vectors[queries], mean, turn)):
                radius = max(1, int(RADIUS * d))
                rows = index.within(code, radius)
                while len(rows) < min(len(held), max(CANDIDATES, 2 * k)):
                    radius += max(1, d // 32)
                    rows = index.within(code, radius)
                score = (base[rows] * vectors[q]).sum(axis=1)
                # One more than asked for, as the query's own vector may be among them, and all ties.
                if len(rows) > k + 1:
                    rows, score = (x[score >= np.partition(score, -k - 1)[-k - 1]] for x in (rows, score))
                out += zip([names[q]] * len(rows), names[held[rows]].tolist(), score.tolist())
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                        names=["asked", "found", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query its ``k`` best by inner product.

    ``vectors`` has ``vec_id, embedding``.  Queries are the rows whose ``vec_id`` is
    divisible by ``every``; candidates are all rows but those of the query's ``vec_id``.
    Ties go to the smaller ``vec_id``.  Vectors that are null, empty, zero or hold a null
    or a component that is not finite, and rows without ``vec_id``, take no part; vectors
    are only held against vectors of their length; a row that is repeated counts as one.
    Other columns play no part; no rows give none.

    Equal vectors are indexed once, with the ``k + 1`` smallest of their ids.  The
    rotation is learned from at most ``SAMPLE`` vectors; every vector is indexed, in
    indexes of bounded size, and every index is asked by every block of queries.
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()  # one zero
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    equal = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    held = materialize(equal.withColumn("place", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = materialize(queries.join(held, "v").select("vec_id", "place", "v"), "queries")
    ask = asked.select("place", "v").distinct()

    n_held, n_asked = held.count(), ask.count()
    shards, blocks = max(1, -(-n_held // INDEXED)), max(1, -(-n_asked // ASKED))
    # Vectors of rarer lengths than the commonest eight are coded by their signs as they are.
    learned = {}
    lengths = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(8).collect()
    for d in (r["d"] for r in lengths):
        sample = held.where(F.size("v") == d).orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()
        sample = np.array([r["v"] for r in sample])
        if len(sample) > 1:
            learned[d] = rotation(sample)
    spread = F.xxhash64("place")
    base = held.select("place", "v", F.lit(False).alias("asked"), F.pmod(spread, F.lit(shards)).alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    some = ask.select("place", "v", F.lit(True).alias("asked"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                      F.pmod(spread, F.lit(blocks)).cast("int").alias("block"))
    found = base.union(some).withColumn("d", F.size("v")).groupBy("d", "shard", "block").applyInArrow(
        _searched(learned, k), "asked long, found long, score double")

    # The best vectors of each query vector, then ids in place of vectors.
    best = Window.partitionBy("asked").orderBy(F.desc("score"))
    found = found.withColumn("n", F.rank().over(best)).where(F.col("n") <= k + 1).drop("n")
    ids = held.select(F.col("place").alias("found"), "ids")
    found = found.join(ids, "found").join(asked.select(F.col("vec_id").alias("query_id"), F.col("place").alias("asked")), "asked")
    found = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
