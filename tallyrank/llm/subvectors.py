"""Centroid clustering over dictionaries of subvectors, in whole numbers.

The dimensions of the vectors are cut into blocks.  The distinct subvectors of a block
are its dictionary, and a vector is stored, without loss, as one code for each block.  In
a round the exact squared distance of every dictionary entry to every centroid's block
is computed once; a vector's distance to a centroid is the sum of the distances of its
codes.  Blocks are as wide as keeps every dictionary within a fixed number of entries; a
single dimension with more values than that keeps its values in place of codes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.session import materialize

#: Entries of one block's dictionary, at most.  64 blocks of them with 8 centroids are
#: 16 MB of distances.
ENTRIES = 4_096
#: Integers up to here have distances and sums that a long holds.
LARGEST = 2 ** 26


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _distinct(dims: int, entries: int):
    """Distinct values of each dimension in a task, until a dimension has more than ``entries``."""

    def run(batches):
        seen = [np.zeros(0, np.int64)] * dims
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            for i in range(dims):
                if len(seen[i]) <= entries:
                    seen[i] = np.union1d(seen[i], v[:, i])
        lengths = [min(len(s), entries + 1) for s in seen]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(dims, dtype=np.int32), lengths)), pa.array(np.concatenate([s[:n] for s, n in zip(seen, lengths)]))],
            ["dim", "value"])

    return run


def blocks_of(counts: list[int], entries: int) -> list[tuple[int, int]]:
    """First and last dimension (exclusive) of blocks whose values combine to ``entries`` at most."""
    out, at = [], 0
    while at < len(counts):
        end, combined = at + 1, counts[at]
        while end < len(counts) and combined * counts[end] <= entries:
            combined *= counts[end]
            end += 1
        out.append((at, end))
        at = end
    return out


class Codebook:
    """The blocks, and for each its distinct subvectors in order, or None where values stand for themselves."""

    def __init__(self, values: list[np.ndarray | None], blocks: list[tuple[int, int]]):
        self.values, self.blocks = values, blocks
        self.words: list[np.ndarray | None] = [None] * len(blocks)

    def raw(self, v: np.ndarray, block: int) -> np.ndarray:
        """One number for each row's subvector: the places of its values, combined."""
        start, end = self.blocks[block]
        out = np.zeros(len(v), np.int64)
        for i in range(start, end):
            out = out * len(self.values[i]) + np.searchsorted(self.values[i], v[:, i])
        return out

    def learned(self, seen: dict[int, list[int]]) -> Codebook:
        """With the dictionaries of the combined numbers met in each block."""
        self.names: list[np.ndarray | None] = [None] * len(self.blocks)
        for b, (start, end) in enumerate(self.blocks):
            if self.values[start] is not None:
                # Every value of a single dimension was met.
                met = sorted(seen[b]) if end - start > 1 else range(len(self.values[start]))
                self.names[b] = rest = np.array(met, np.int64)
                columns = []
                for i in reversed(range(start, end)):
                    rest, place = np.divmod(rest, len(self.values[i]))
                    columns.append(self.values[i][place])
                self.words[b] = np.stack(columns[::-1], axis=1)
        return self

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Codes, block by block."""
        return np.stack([v[:, start] if self.words[b] is None else np.searchsorted(self.names[b], self.raw(v, b))
                         for b, (start, _) in enumerate(self.blocks)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([codes[:, [b]] if w is None else w[codes[:, b]] for b, w in enumerate(self.words)], axis=1)

    def distances(self, centroids: np.ndarray) -> list[np.ndarray]:
        """For each block the squared distance of each entry to each centroid, or the centroids' values."""
        return [centroids[:, start] if w is None else ((w[:, None, :] - centroids[None, :, start:end]) ** 2).sum(axis=2)
                for w, (start, end) in zip(self.words, self.blocks)]

    def summed(self, codes: np.ndarray, distances: list[np.ndarray]) -> np.ndarray:
        """Squared distance of each coded row to each centroid."""
        out = np.zeros((len(codes), distances[0].shape[-1]), np.int64)
        for b, (w, of) in enumerate(zip(self.words, distances)):
            out += (codes[:, [b]] - of[None, :]) ** 2 if w is None else of[codes[:, b]]
        return out


def _met(codebook: Codebook):
    def run(batches):
        seen = [np.zeros(0, np.int64)] * len(codebook.blocks)
        for batch in batches:
            v = _matrix(batch.column("v"), len(codebook.values))
            for b, (start, end) in enumerate(codebook.blocks):
                if end - start > 1:
                    seen[b] = np.union1d(seen[b], codebook.raw(v, b))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(seen), dtype=np.int32), [len(s) for s in seen])), pa.array(np.concatenate(seen))],
            ["block", "name"])

    return run


def codebook_of(vectors: DataFrame, dims: int, entries: int = ENTRIES) -> Codebook:
    """Blocks and dictionaries of all rows' vectors ``v``.

    What comes to the driver is bounded by ``entries`` for each dimension, then for each block.
    """
    values = vectors.select("v").mapInArrow(_distinct(dims, entries), "dim int, value long").distinct()
    values = materialize(values, "values")
    counts = {row["dim"]: row["count"] for row in values.groupBy("dim").count().collect()}
    few = [i for i in range(dims) if counts[i] <= entries]
    found: dict[int, list[int]] = {i: [] for i in few}
    for row in values.where(F.col("dim").isin(few)).collect():
        found[row["dim"]].append(row["value"])
    book = Codebook([np.array(sorted(found[i]), np.int64) if i in found else None for i in range(dims)],
                    blocks_of([counts[i] for i in range(dims)], entries))
    seen: dict[int, list[int]] = {}
    if any(end - start > 1 for start, end in book.blocks):
        for row in vectors.select("v").mapInArrow(_met(book), "block int, name long").distinct().collect():
            seen.setdefault(row["block"], []).append(row["name"])
    return book.learned(seen)


def _encoded(book):
    def run(batches):
        for batch in batches:
            codes = book.value.encode(_matrix(batch.column("v"), len(book.value.values)))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * codes.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "codes"])

    return run


def _nearest(batch: pa.RecordBatch, book: Codebook, tables: list[np.ndarray]):
    codes = _matrix(batch.column("codes"), len(book.blocks))
    far = book.summed(codes, tables)
    nearest = far.argmin(axis=1)  # the smaller number among equals
    return codes, nearest, far[np.arange(len(far)), nearest]


def _moved(book, tables, k: int):
    """Of each task, rows, sums of the components and summed distance of each cluster."""

    def run(batches):
        dims = len(book.value.values)
        rows, sums, far = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            codes, nearest, distance = _nearest(batch, book.value, tables.value)
            v = book.value.decode(codes)
            for c in np.unique(nearest):
                own = nearest == c
                rows[c] += own.sum()
                sums[c] += v[own].sum(axis=0)
                far[c] += distance[own].sum()
        met = np.flatnonzero(rows)
        ends = np.arange(len(met) + 1, dtype=np.int32) * dims
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(rows[met]), pa.array(far[met]),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[met].ravel()))],
            ["cluster", "n", "far", "sums"])

    return run


def _assigned(book, tables):
    def run(batches):
        for batch in batches:
            _, nearest, distance = _nearest(batch, book.value, tables.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(nearest.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"])

    return run


def whole(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """``vec_id, v`` of vectors of ``dims`` finite components, ``v`` being floor(scale * x)."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.size("x") == dims)
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    beyond = F.raise_error(F.lit(f"a component is beyond {LARGEST} when scaled; its distances may not fit a long"))
    return rows.select("vec_id", F.transform(
        "x", lambda c: F.when(F.abs(c) * scale < LARGEST, F.floor(c * scale)).otherwise(beyond)).alias("v"))


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024,
             seed: int = 3, entries: int = ENTRIES) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    ``vectors`` has ``vec_id, embedding``.  Vectors with exactly ``dims`` components, none
    null or not finite, are kept and become floor(scale * x) in doubles; a null vector or
    one of another length takes no part.  A component of ``LARGEST`` or more when scaled
    is refused, as distances would not fit a long.  Every row counts, repeated ones as
    often as they come; a null ``vec_id`` comes last among the starting rows.

    Centroids 0, 1, ... start as the ``k`` vectors whose hex sha256 of ``seed:vec_id``
    comes first (ties by the vector), and are fewer if fewer vectors are kept.  Each round
    assigns all vectors to their nearest centroid, ties to the smaller number, and moves
    every centroid that has vectors to the floors of their means; then vectors are
    assigned once more.  No rows give none; other columns play no part.

    Vectors are encoded once and stay where they are; a round sends the dictionaries'
    distances to the tasks and gets one row a task and cluster back.
    """
    spark = vectors.sparkSession
    held = materialize(whole(vectors, dims, scale), "whole-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = held.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not start:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in start], np.int64)
    codebook = codebook_of(held, dims, entries)
    book = spark.sparkContext.broadcast(codebook)
    coded = materialize(held.mapInArrow(_encoded(book), "vec_id long, codes array<int>"), "codes")

    def moved():
        tables = spark.sparkContext.broadcast(codebook.distances(centroids))
        found = coded.mapInArrow(_moved(book, tables, len(centroids)), "cluster int, n long, far long, sums array<long>")
        sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
        return tables, found.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *sums).collect()

    for _ in range(rounds):
        tables, found = moved()
        tables.destroy()
        for row in found:
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    tables, found = moved()
    inertia = {row["cluster"]: row["far"] for row in found}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    named = F.array(*map(F.lit, names))
    return coded.mapInArrow(_assigned(book, tables), "vec_id long, cluster int, distance long").select(
        "vec_id", "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), named[F.col("cluster")].alias("centroid_sha256"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The query's SQL: the rounds as a chain of tables in long form."""
    steps = [f"""held AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM held
), starts AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM held QUALIFY c < {k}
), c0 AS MATERIALIZED (SELECT c, i, x AS y FROM starts JOIN cells USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT vec_id, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM cells JOIN c{r} USING (i) GROUP BY ALL
  ) GROUP BY vec_id
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(m, y) AS y FROM c{r} LEFT JOIN (
    SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM cells JOIN a{r} USING (vec_id) GROUP BY ALL
  ) USING (c, i)
)""")
    return f"""WITH {', '.join(steps)}, names AS (
  SELECT c, sha256(string_agg(y, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN names USING (c)"""


SQL = _sql()
