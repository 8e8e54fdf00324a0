"""Exact k nearest neighbours in Euclidean distance.

A side of checked size, base or queries, is sent to every task.  When both are
large, the base is dealt to the cells of a tree of random projections (locality-
sensitive hashing with learned cuts); queries search their nearest cells, rank
exactly, and go on to other cells only where a bound does not certify what they
have.  Each cell is worked in blocks of bounded size, of which only the best k
leave, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyrank.contract import SEED
from tallyrank.session import materialize

BROADCAST_VALUES = 4_000_000  # doubles, 32 MB
BLOCK_ROWS = 8_192
EXACT_ROWS = 65_536
# Base rows of a cell, about, as long as the cells stay within their limit.
CELL_ROWS = 2_048
MAX_LEVELS = 12
# Vectors that the cuts are learned from, at most.
SAMPLE_ROWS = 65_536
RESULT = "id bigint, neighbour bigint, distance double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _best(ids, x, base_ids, base, k: int, skip_self: bool) -> pd.DataFrame:
    """Best ``k`` base rows of every query row, within one block."""
    parts = []
    if not len(base_ids):
        return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
    # Around the mean, products lose little of vectors that lie far from the origin.
    centre = base.mean(axis=0)
    near = base - centre
    near_sq = (near * near).sum(axis=1)
    take = min(k, len(base_ids))
    step = max(1, 4_000_000 // len(base_ids))
    rounding = 16 * (base.shape[1] + 4) * np.finfo(float).eps
    for at in range(0, len(ids), step):
        q, qi = x[at : at + step], ids[at : at + step]
        away = q - centre
        rough = near_sq[None, :] - 2.0 * (away @ near.T)
        if skip_self:
            rough[qi[:, None] == base_ids[None, :]] = np.inf
        # All that rounding may hide among the best; differences then give exact distances.
        kth = np.partition(rough, take - 1, axis=1)[:, take - 1]
        kth = kth + rounding * ((away * away).sum(axis=1) + near_sq.max())
        rows, cols = np.nonzero((rough <= kth[:, None]) & np.isfinite(rough))
        exact = np.empty(len(rows))
        for i in range(0, len(rows), EXACT_ROWS):
            part = slice(i, i + EXACT_ROWS)
            exact[part] = np.sqrt(((base[cols[part]] - q[rows[part]]) ** 2).sum(axis=1))
        order = np.lexsort((base_ids[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < k
        parts.append(
            pd.DataFrame(
                {"id": qi[rows[best]], "neighbour": base_ids[cols[best]], "distance": exact[best]}
            )
        )
    return pd.concat(parts) if parts else pd.DataFrame({"id": [], "neighbour": [], "distance": []})


def nearest_neighbours(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "x",
    skip_self: bool = True,
    broadcast_values: int = BROADCAST_VALUES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, neighbour, distance, rank) with rank 1..k, ties by neighbour id.

    Ids are unique on each side; ``skip_self`` leaves out the query's own id.
    """
    q = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("x"))
    b = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("x"))
    width = b.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return q.sparkSession.createDataFrame([], RESULT + ", rank int")
    fits = max(1, broadcast_values // max(1, width))

    def small(side: DataFrame) -> bool:
        # Reads at most one row beyond the limit.
        return side.limit(fits + 1).count() <= fits

    if small(b):
        found = _against_broadcast(q, b, k, skip_self)
    elif small(q):
        found = _against_broadcast_queries(q, b, k, skip_self)
    else:
        found = CellSearch(q, b, k, skip_self, block_rows, broadcast_values).found()
    order = W.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _against_broadcast(q: DataFrame, b: DataFrame, k: int, skip_self: bool) -> DataFrame:
    local = b.toPandas()
    shared = q.sparkSession.sparkContext.broadcast(
        (local["id"].to_numpy(np.int64), _matrix(local["x"]))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base_ids, base = shared.value
        for pdf in batches:
            if len(pdf):
                ids = pdf["id"].to_numpy(np.int64)
                yield _best(ids, _matrix(pdf["x"]), base_ids, base, k, skip_self)

    return q.mapInPandas(run, RESULT)


def _against_broadcast_queries(q: DataFrame, b: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Every task of the base keeps the best of its rows for each of few queries."""
    local = q.toPandas()
    shared = q.sparkSession.sparkContext.broadcast(
        (local["id"].to_numpy(np.int64), _matrix(local["x"]))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = shared.value
        kept = None
        for pdf in batches:
            if len(pdf) and len(ids):
                new = _best(ids, x, pdf["id"].to_numpy(np.int64), _matrix(pdf["x"]), k, skip_self)
                kept = new if kept is None else pd.concat([kept, new])
                order = ["id", "distance", "neighbour"]
                kept = kept.sort_values(order, kind="stable").groupby("id", sort=False).head(k)
        if kept is not None:
            yield kept

    return b.mapInPandas(run, RESULT)


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * x @ c.T


class Cells:
    """Cells of nearest centres, and what bounds the distance to their rows.

    A tree of random projections, each node cut at the median of a sample, hashes the
    sample into as many buckets as there are to be cells; a few rounds then move their
    means to where the sample lies.  The directions are orthonormal, so distances along
    them never exceed those of the vectors.
    """

    def __init__(self, sample: np.ndarray, levels: int, rounds: int = 5):
        d = sample.shape[1]
        rng = np.random.default_rng(SEED)
        self.directions = np.linalg.qr(rng.normal(size=(d, max(levels, min(d, 16)))))[0]
        cuts = sample @ self.directions
        bucket = np.zeros(len(sample), int)
        for level in range(levels):
            along = cuts[:, level % cuts.shape[1]]
            order = np.lexsort((along, bucket))
            place = np.arange(len(order)) - np.searchsorted(bucket[order], bucket[order])
            half = np.bincount(bucket)[bucket[order]] // 2
            bucket[order] = 2 * bucket[order] + (place >= half)
        self.centres = self._means(sample, bucket)
        for _ in range(rounds):
            self.centres = self._means(sample, self.of(sample))
        self.rows = np.zeros(len(self.centres), np.int64)

    @staticmethod
    def _means(x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
        return np.add.reduceat(x[order], starts) / np.diff(np.append(starts, len(x)))[:, None]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: its nearest centre."""
        return np.concatenate([_square(x[i:i + 4_096], self.centres).argmin(axis=1) for i in range(0, len(x), 4_096)])

    def bounded_by(self, stats: list) -> Cells:
        """With count, radius and box of every cell that has rows."""
        n, m = len(self.rows), self.directions.shape[1]
        self.radius, self.low, self.high = np.zeros(n), np.full((n, m), np.inf), np.full((n, m), -np.inf)
        for r in stats:
            c = r["cell"]
            self.rows[c], self.radius[c] = r["n"], r["radius"]
            self.low[c], self.high[c] = r["low"], r["high"]
        self.held = np.flatnonzero(self.rows)
        return self

    def to_centres(self, x: np.ndarray) -> np.ndarray:
        """Distances to the centres of the cells that have rows."""
        return np.sqrt(np.maximum(_square(x, self.centres[self.held]), 0.0))

    def least(self, x: np.ndarray, to_centres: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer than this.

        It lies in the ball around its cell's centre, in the box along the directions, and
        on its centre's side of the plane between that and the query's nearest centre.
        """
        held = self.centres[self.held]
        along = x @ self.directions
        box = np.zeros(to_centres.shape)
        for j in range(along.shape[1]):
            p = along[:, j][:, None]
            out = np.maximum(np.maximum(self.low[self.held, j][None, :] - p, p - self.high[self.held, j][None, :]), 0.0)
            box += out * out
        own = to_centres.argmin(axis=1)
        apart = np.sqrt(np.maximum(_square(held, held), 0.0))[own]
        nearest = to_centres[np.arange(len(x)), own][:, None]
        plane = (to_centres ** 2 - nearest ** 2) / np.maximum(2.0 * apart, 1e-300)
        plane = np.where(apart > 0, plane, 0.0)
        size = np.abs(x).max(initial=0.0) + np.abs(self.centres).max(initial=0.0)
        # Rounding moves a squared distance by as much; between close centres planes lose more.
        slack = 1e-7 * (1.0 + size * np.sqrt(x.shape[1]))
        blur = 1e-14 * x.shape[1] * (1.0 + size * size * x.shape[1]) / np.maximum(apart, 1e-300)
        return np.maximum(np.maximum(to_centres - self.radius[self.held][None, :], np.sqrt(box)) - slack, plane - slack - blur)

    def first(self, to_centres: np.ndarray, need: int) -> list[np.ndarray]:
        """For each query its nearest cells, until they hold ``need`` rows (places in ``held``)."""
        rows = self.rows[self.held]
        if need <= rows.min():
            return list(to_centres.argmin(axis=1)[:, None])
        order = np.argsort(to_centres, axis=1, kind="stable")
        enough = (np.cumsum(rows[order], axis=1) < need).sum(axis=1) + 1
        return [o[:n] for o, n in zip(order, enough)]


class CellSearch:
    """Neighbours of two large sides, exact, by locality-sensitive cells and a certificate.

    1. Equal vectors are one point, with the few smallest of their ids.
    2. A query searches the cells whose centres are nearest until they hold enough
       points; the distance of its last find bounds what it still has to look for.
    3. A query is certified when every other cell's bound lies beyond that distance.
       Those that are not search the cells that could hold something nearer.

    Only queries travel to cells, never the whole of the base; a cell is worked in
    blocks of bounded size.  How many pairs are computed depends on how far the data
    fall into clusters, the result does not: without any, all cells are searched.
    """

    def __init__(self, q: DataFrame, b: DataFrame, k: int, skip_self: bool, block_rows: int = BLOCK_ROWS,
                 broadcast_values: int = BROADCAST_VALUES, cell_rows: int = CELL_ROWS):
        self.k, self.skip_self, self.block_rows = k, skip_self, block_rows
        self.need = k + 1 if skip_self else k
        self.points, self.ids = self._distinct(b, self.need)
        self.asked, self.owners = self._distinct(q, None)
        n = self.points.count()
        width = self.points.agg(F.max(F.size("x"))).first()[0]
        levels = int(np.ceil(np.log2(max(1.0, n / cell_rows))))
        # What is sent to the tasks stays within the limit.
        levels = min(levels, MAX_LEVELS, int(np.log2(max(2, broadcast_values // (width + 40)))))
        take = max(256, min(SAMPLE_ROWS, broadcast_values // max(1, width)))
        sample = self.points.orderBy(F.xxhash64("id"), "id").limit(take).select("x").collect()
        cells = Cells(np.array([r["x"] for r in sample], float).reshape(len(sample), width), levels)
        self.base = materialize(self._dealt(self.points, cells), "cells")
        self.cells = cells.bounded_by(self._stats(self.base, cells))

    @staticmethod
    def _distinct(rows: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
        """Distinct vectors under their smallest id, and that id beside the ids that share it."""
        least = rows.groupBy("x").agg(F.min("id").alias("least"))
        named = rows.join(least, "x")
        if most is not None:
            order = F.row_number().over(W.partitionBy("least").orderBy("id"))
            named = named.withColumn("n", order).filter(F.col("n") <= most)
        named = materialize(named.select("id", "least", F.when(F.col("id") == F.col("least"), F.col("x")).alias("x")), "points")
        return named.filter("id = least").select("id", "x"), named.select("id", "least")

    @staticmethod
    def _dealt(points: DataFrame, cells: Cells) -> DataFrame:
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(cell=cells.of(_matrix(pdf["x"])).astype(np.int32))

        return points.mapInPandas(run, "id bigint, x array<double>, cell int")

    @staticmethod
    def _stats(base: DataFrame, cells: Cells) -> list:
        """Rows, radius around the centre and box along the directions, of each cell (bounded rows)."""
        m = cells.directions.shape[1]

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x, cell = _matrix(pdf["x"]), pdf["cell"].to_numpy()
                away = np.sqrt(((x - cells.centres[cell]) ** 2).sum(axis=1))
                along = x @ cells.directions
                names = np.unique(cell)
                parts = [np.flatnonzero(cell == c) for c in names]
                yield pd.DataFrame({
                    "cell": names.astype(np.int32), "n": [len(p) for p in parts],
                    "radius": [away[p].max() for p in parts],
                    "low": [along[p].min(axis=0) for p in parts], "high": [along[p].max(axis=0) for p in parts],
                })

        found = base.mapInPandas(run, "cell int, n bigint, radius double, low array<double>, high array<double>")
        ends = [F.array(*[f(F.col(c)[j]) for j in range(m)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
        return found.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), *ends).collect()

    def _visits(self, queries: DataFrame, pick) -> DataFrame:
        """Queries beside each cell that ``pick`` names for them."""
        cells = self.cells
        names = queries.sparkSession.sparkContext.broadcast(cells)

        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), 1_024):  # a block of bounds of bounded size
                    part = pdf.iloc[at:at + 1_024]
                    x = _matrix(part["x"])
                    chosen = pick(names.value, x, part)
                    rows = np.repeat(np.arange(len(part)), [len(c) for c in chosen])
                    if len(rows):
                        where = names.value.held[np.concatenate(chosen)].astype(np.int32)
                        yield pd.DataFrame({"id": part["id"].to_numpy()[rows], "x": part["x"].to_numpy()[rows], "cell": where})

        return queries.mapInPandas(run, "id bigint, x array<double>, cell int")

    def first_visits(self) -> DataFrame:
        need = self.need
        return self._visits(self.asked, lambda cells, x, part: cells.first(cells.to_centres(x), need))

    def other_visits(self, reached: DataFrame) -> DataFrame:
        """Visits of queries that are not certified, to cells that may hold nearer points.

        ``reached`` has ``id, reach``, the distance a query is sure to find enough within.
        """
        need = self.need

        def pick(cells: Cells, x: np.ndarray, part: pd.DataFrame) -> list[np.ndarray]:
            away = cells.to_centres(x)
            open_ = cells.least(x, away) <= part["reach"].to_numpy()[:, None]
            for i, seen in enumerate(cells.first(away, need)):
                open_[i, seen] = False
            return [np.flatnonzero(o) for o in open_]

        return self._visits(self.asked.join(reached, "id"), pick)

    def _searched(self, visits: DataFrame) -> DataFrame:
        """The best of every visited cell for every visit."""
        size = self.block_rows
        counts = visits.groupBy("cell").agg(F.count("*").alias("q"))
        counts = counts.join(self.base.groupBy("cell").agg(F.count("*").alias("b")), "cell")
        blocks = F.broadcast(counts.select(  # one row per cell, at most 2 ** MAX_LEVELS
            "cell", F.ceil(F.col("q") / size).cast("int").alias("q_blocks"), F.ceil(F.col("b") / size).cast("int").alias("b_blocks")))

        def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
            mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int")
            each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
            return rows.join(blocks, "cell").select("id", "x", "cell", mine.alias(f"{own}b"), each.alias(f"{other}b"))

        need = self.need

        def block(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(c):
                return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
            return _best(a["id"].to_numpy(np.int64), _matrix(a["x"]), c["id"].to_numpy(np.int64), _matrix(c["x"]), need, False)

        keys = ["cell", "qb", "bb"]
        left, right = dealt(visits, "q", "b"), dealt(self.base, "b", "q")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, RESULT)

    def _ranked(self, found: DataFrame, most: int) -> DataFrame:
        order = W.partitionBy("id").orderBy("distance", "neighbour")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    def found(self) -> DataFrame:
        """(id, neighbour, distance), at least the best ``k`` of every query."""
        near = materialize(self._ranked(self._searched(materialize(self.first_visits(), "visits")), self.need), "near").drop("rank")
        reached = near.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).select(
            "id", F.when(F.col("n") >= self.need, F.col("far")).otherwise(F.lit(float("inf"))).alias("reach"))
        far = self._searched(materialize(self.other_visits(reached), "visits"))
        points = self._ranked(near.union(far), self.need)
        # Points back to ids: the few smallest of every base point, all of every query point.
        pairs = points.select(F.col("id").alias("least"), F.col("neighbour").alias("point"), "distance")
        pairs = pairs.join(self.ids.select(F.col("id").alias("neighbour"), F.col("least").alias("point")), "point")
        pairs = self._ranked(pairs.select(F.col("least").alias("id"), "neighbour", "distance"), self.need).drop("rank")
        pairs = self.owners.join(pairs.withColumnRenamed("id", "least"), "least").select("id", "neighbour", "distance")
        return pairs.filter("id <> neighbour") if self.skip_self else pairs
