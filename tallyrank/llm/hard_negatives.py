"""Hard negatives by Strassen products of anchor and candidate tiles.

Scores are integer inner products.  A tile of anchors times a tile of candidates is
multiplied by Strassen's recursion on int64 matrices: operands are padded with zeros to
even sides, halved in all three directions, and seven products of sums of the quarters
give the four quarters of the result.  All additions are exact modulo 2**64, so a score
that a long can hold comes out exactly, whatever the sums in between.  Each anchor keeps
bounded heaps, first of its best positives, then of the best negatives in the window
below each positive; heaps of different tiles merge by keeping the best of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.session import materialize

#: Components of the anchors sent to tasks at once, at most about: 32 MB.
SLICE = 4_000_000
#: Rows of the tiles, and the side up to which a product is made without recursion.
ANCHORS, CANDIDATES, LEAF = 256, 2_048, 32
#: Multiplications that a task is planned for.
TASK = 20_000_000_000


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, modulo 2**64, by Strassen's recursion."""
    (m, k), n = a.shape, b.shape[0]
    if min(m, k, n) <= leaf:
        return np.einsum("ik,jk->ij", a, b)
    a, b = (np.pad(x, [(0, side % 2) for side in x.shape]) for x in (a, b))
    h, w = a.shape[0] // 2, a.shape[1] // 2
    g = b.shape[0] // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    # The quarters of b transposed.
    b11, b21, b12, b22 = b[:g, :w], b[:g, w:], b[g:, :w], b[g:, w:]
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * g), np.int64)
    out[:h, :g] = p1 + p4 - p5 + p7
    out[:h, g:] = p3 + p5
    out[h:, :g] = p2 + p4
    out[h:, g:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        sure = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        need = k - len(sure)
        if len(tied) > need:
            tied = tied[np.argpartition(ids[tied], need - 1)[:need]]
        places = np.concatenate([sure, tied])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], ~scores[places]))]  # ~ falls as a long rises, and never overflows


class _Heap:
    """The best ``k`` of all (score, id) it was given."""

    __slots__ = ("scores", "ids", "k")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k and len(scores):  # what the worst kept one beats has no place
            scores, ids = scores[keep := scores >= self.scores[-1]], ids[keep]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            places = best(scores, ids, self.k)
            self.scores, self.ids = scores[places], ids[places]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _tiles(batches, anchors: dict):
    """Anchors' tile, its product with a tile of candidates, and the candidates' ids and labels."""
    for batch in batches:
        widths = np.asarray(batch.column("v").value_lengths())
        for d in np.unique(widths):
            if d in anchors:
                part = batch.filter(pa.array(widths == d))
                for at in range(0, part.num_rows, CANDIDATES):
                    tile = part.slice(at, CANDIDATES)
                    ids, labels = (tile.column(c).to_numpy() for c in ("vec_id", "label"))
                    held = _matrix(tile.column("v"))
                    for block in anchors[d]:
                        yield block, product(block["v"], held), ids, labels


def _positives(sent, k: int):
    def run(batches):
        anchors, heaps = sent.value, {}
        for block, scores, ids, labels in _tiles(batches, anchors):
            for i, (place, own, label) in enumerate(zip(block["place"], block["vec_id"], block["label"])):
                fit = np.flatnonzero((labels == label) & (ids != own))
                heaps.setdefault(place, _Heap(k)).add(scores[i, fit], ids[fit])
        yield _rows(((p, 0, h) for p, h in heaps.items()))

    return run


def _negatives(sent, k: int):
    def run(batches):
        anchors, heaps = sent.value, {}
        for block, scores, ids, labels in _tiles(batches, anchors):
            for i, (place, label, tops) in enumerate(zip(block["place"], block["label"], block["tops"])):
                tops = [p for p in set(tops) if p >= 0]  # below zero no score lies in the window
                if tops:
                    s = scores[i]
                    fit = np.flatnonzero((labels != label) & (s <= max(tops)) & (s >= min(p - p // 5 for p in tops)))
                    s, who = s[fit], ids[fit]
                    for p in tops:
                        inside = (s <= p) & (s >= p - p // 5)  # 80 p <= 100 s, without overflow
                        heaps.setdefault((place, p), _Heap(k)).add(s[inside], who[inside])
        yield _rows(((place, p, h) for (place, p), h in heaps.items()))

    return run


def _rows(heaps) -> pa.RecordBatch:
    place, top, ids, scores = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, p, h in heaps:
        place += [at] * len(h.ids)
        top += [p] * len(h.ids)
        ids.append(h.ids)
        scores.append(h.scores)
    return pa.RecordBatch.from_arrays(
        [pa.array(place, pa.int64()), pa.array(top, pa.int64()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))],
        ["place", "top", "found", "score"])


_FOUND = "place long, top long, found long, score long"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each place and top, of the heaps that tasks kept, and their rank."""
    order = Window.partitionBy("place", "top").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sent(rows: list) -> dict:
    """Blocks of anchors by the length of their vectors."""
    out: dict = {}
    rows = sorted(rows, key=lambda r: (len(r["v"]), r["place"]))
    for d in sorted({len(r["v"]) for r in rows}):
        own = [r for r in rows if len(r["v"]) == d]
        out[d] = [{
            "v": np.array([r["v"] for r in part], np.int64).reshape(len(part), d),
            "place": [r["place"] for r in part], "vec_id": [r["vec_id"] for r in part],
            "label": [r["label"] for r in part], "tops": [r["tops"] if "tops" in r else None for r in part],
        } for part in (own[i:i + ANCHORS] for i in range(0, len(own), ANCHORS))]
    return out


def _swept(anchors: DataFrame, held: DataFrame, slices: int, run, k: int, name: str) -> DataFrame:
    """``run`` of every slice of the anchors over all candidates, heaps merged and written."""
    spark, parts = held.sparkSession, []
    for at in range(slices):
        rows = anchors.where(F.col("slice") == at).drop("slice").collect()  # bounded by SLICE
        if rows:
            sent = spark.sparkContext.broadcast(_sent([r.asDict() for r in rows]))
            parts.append(materialize(_merged(held.mapInArrow(run(sent, k), _FOUND), k), name))
            sent.destroy()
    out = spark.createDataFrame([], _FOUND + ", rank int")
    for part in parts:
        out = out.union(part)
    return out


def quantized(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, ``v`` being floor(scale * x), each row once."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    scaled = F.transform("x", lambda c: F.floor(c * scale))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < 2.0 ** 63))
    rows = vectors.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), x.alias("x"))
    rows = rows.where("vec_id is not null and label is not null and x is not null").where(whole)
    return rows.select("vec_id", "label", scaled.alias("v")).distinct()


def hard_negatives(vectors: DataFrame, label: Column | None = None, every: int = 100, positives: int = 5,
                   negatives: int = 5, scale: int = 256, slice_values: int = SLICE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``.  A component x counts as
    floor(scale * x) in doubles; a score is the integer inner product with the anchor,
    higher scores first, ties by smaller ``vec_id``.  Anchors are the rows whose
    ``vec_id`` is divisible by ``every``; an anchor's positives are its best rows of the
    same label and another ``vec_id``, and each positive's negatives the best rows of
    another label with a score of at least 80 % and at most 100 % of the positive's.
    ``label`` may give another label than the column.

    Rows without ``vec_id`` or label, with a null vector, or with a component that is
    null, not finite or beyond a long when scaled take no part.  A repeated row counts
    once; rows that share a ``vec_id`` with different vectors are rows of their own.
    Vectors are only held against vectors of their length; the empty ones score zero.
    An anchor without positives, or a positive without negatives, gives no row; no rows
    give none.  Other columns play no part.

    Candidates never move: slices of the anchors of bounded size are sent to them one
    after the other, and each task keeps one heap an anchor for all its tiles.  What is
    shuffled is heaps, of at most ``positives`` or ``negatives`` rows a task.
    """
    label = F.col("label") if label is None else label
    held = materialize(quantized(vectors, scale, label), "candidates")
    anchors = held.where(F.col("vec_id") % every == 0)
    size = F.sum(F.size("v") + F.lit(1))
    n_anchors, n_held = (rows.agg(size).first()[0] or 0 for rows in (anchors, held))
    slices = max(1, -(-2 * n_anchors // slice_values))
    anchors = anchors.withColumn("place", F.monotonically_increasing_id())
    anchors = materialize(anchors.withColumn("slice", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(slices))), "anchors")
    rows = anchors.count()
    tasks = -(-n_held * max(1, rows // slices) // TASK)
    if tasks > len(held.inputFiles()):
        held = materialize(held.repartition(int(tasks)), "candidates")

    best_positives = _swept(anchors, held, slices, _positives, positives, "positives")
    best_positives = materialize(best_positives, "positives") if slices > 1 else best_positives
    tops = best_positives.groupBy("place").agg(F.collect_set("score").alias("tops"))
    asked = materialize(anchors.join(tops, "place"), "asked")
    found = _swept(asked, held, slices, _negatives, negatives, "negatives")
    named = best_positives.select("place", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    named = named.join(anchors.select("place", F.col("vec_id").alias("anchor_id")), "place")
    found = found.select("place", F.col("top").alias("positive_score"), "rank",
                         F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found, ["place", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The query's SQL: every anchor's products in long form.
SQL = """
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS (
  SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM held
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM cells a JOIN cells c USING (i) WHERE a.vec_id % 100 = 0 GROUP BY ALL
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores
  WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives JOIN scores s USING (anchor_id)
  WHERE s.label <> s.anchor_label AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""
