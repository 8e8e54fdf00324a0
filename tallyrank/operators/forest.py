"""Random forests whose trees are each grown in a task, stored as those of ``pyspark.ml``.

Rows are cut into bins once, a byte a value, and sent to the tasks; a task grows a tree
to its end with no job between the levels.  A tree follows the rules of ``pyspark.ml``:
rows counted by a Poisson draw, features drawn anew in each node, Gini impurity of the
weighted classes, least rows of a side, and sides of one prediction joined again.  What
a level needs is a sort of its rows by (node, bin) a feature drawn, so its cost is that of
the rows, not of nodes times bins.  The nodes go from the tasks to the shared folder in
the form that ``RandomForestClassificationModel`` reads.
"""

from __future__ import annotations

import json
import math
import pickle
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyrank.operators.boosting import quantile_edges
from tallyrank.session import scratch_path

# Binned values that are sent to the tasks, 64 MB; more are left to ``pyspark.ml``.
SENT_VALUES = 64_000_000
NODES = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
    "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)


@dataclass
class ForestSettings:
    trees: int = 100
    depth: int = 20
    leaf: int = 5
    bins: int = 256
    bootstrap: bool = True
    seed: int = 0


@dataclass
class Rows:
    """Binned rows in an order that doesn't depend on how they were dealt."""

    bins: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    classes: int

    @classmethod
    def of(cls, rows: DataFrame, edges: list[np.ndarray], label: str, weight: str | None) -> Rows:
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        kept = rows.select(F.col(label).cast("int").alias("y"), w.alias("w"), F.xxhash64("x", label).alias("mixed"), "x")
        width = len(edges)

        def run(batches):
            for batch in batches:
                lists = batch.column("x")
                values = lists.flatten()
                if lists.null_count or values.null_count or len(values) != width * len(lists) or batch.column("y").null_count:
                    raise ValueError(f"a row has no label or not {width} features")
                x = values.to_numpy(zero_copy_only=False).reshape(-1, width)
                if not np.isfinite(x).all():
                    raise ValueError("features of a forest must not be NaN or infinite")
                cut = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                packed = pa.array([row.tobytes() for row in cut], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("y", "w", "mixed")), packed], ["y", "w", "mixed", "bins"])

        table = kept.mapInArrow(run, "y int, w double, mixed long, bins binary").toArrow().combine_chunks()
        y, w, mixed = (table.column(c).to_numpy() for c in ("y", "w", "mixed"))
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(y), width)
        order = np.lexsort((*bins[:, :4].T, mixed))
        return cls(np.ascontiguousarray(bins[order]), y[order], w[order], int(y.max()) + 1)


def _gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(axis=-1)
    return np.where(total > 0, 1.0 - (stats * stats).sum(axis=-1) / np.where(total > 0, total * total, 1.0), 0.0)


def _cuts(rows: Rows, use, at, y, w, copies, nodes: int, drawn: np.ndarray, leaf: int):
    """The best gain of each of a level's ``nodes``, with its feature and the last bin below.

    ``use`` are the level's rows, ordered by their node ``at``; ``drawn`` has each node's features.
    """
    best, feature, cut = np.zeros(nodes), np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32)
    n, starts = len(use), np.searchsorted(at, np.arange(nodes))
    if not n:
        return best, feature, cut
    ends = np.append(starts[1:], n) - 1
    shift = max(1, int(n - 1).bit_length())
    place = np.arange(n)

    def running(values):
        """Sums of a node's rows up to each row, and of all of them."""
        upto = np.concatenate([[0.0], np.cumsum(values)])
        return upto[1:] - upto[starts][at], (upto[ends + 1] - upto[starts])[at]

    width = rows.bins.shape[1]
    for slot in drawn.T:
        bins = rows.bins.ravel()[use * width + slot[at]]
        # One sort of whole numbers that hold node, bin and row.
        key = np.sort((((at << 8) | bins) << shift) | place)
        row, cell = key & ((1 << shift) - 1), key >> shift
        sides = [running(np.where(y[row] == c, w[row], 0.0)) for c in range(rows.classes)]
        met, all_met = running(copies[row])
        here = np.flatnonzero((cell[:-1] >> 8 == cell[1:] >> 8) & (cell[:-1] != cell[1:]) & (met[:-1] >= leaf) & (all_met[:-1] - met[:-1] >= leaf))
        if not len(here):
            continue
        below = np.stack([s[0][here] for s in sides], axis=-1)
        whole = np.stack([s[1][here] for s in sides], axis=-1)
        above, total = whole - below, whole.sum(axis=-1)
        gain = _gini(whole) - (below.sum(axis=-1) * _gini(below) + above.sum(axis=-1) * _gini(above)) / np.where(total > 0, total, 1.0)
        node = at[here]
        first = np.flatnonzero(np.diff(node, prepend=-1))
        top = np.maximum.reduceat(gain, first)
        hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(node)))))
        hit = hit[np.flatnonzero(np.diff(node[hit], prepend=-1))]
        hit = hit[gain[hit] > best[node[hit]]]
        best[node[hit]], feature[node[hit]], cut[node[hit]] = gain[hit], slot[node[hit]], cell[here[hit]] & 255
    return best, feature, cut


def grow(rows: Rows, tree: int, s: ForestSettings) -> dict[str, np.ndarray]:
    """A tree's nodes in the order in which ``pyspark.ml`` numbers them, children by number."""
    rng = np.random.default_rng([s.seed, tree])
    n, width = rows.bins.shape
    copies = rng.poisson(1.0, n).astype(float) if s.bootstrap else np.ones(n)
    use = np.flatnonzero(copies)
    at = np.zeros(len(use), np.int64)
    take = max(1, math.ceil(math.sqrt(width)))
    levels = []
    for depth in range(s.depth + 1):
        nodes = int(at[-1]) + 1 if len(at) else 1
        y, c = rows.y[use], copies[use]
        w = rows.weight[use] * c
        stats = np.stack([np.bincount(at[y == k], w[y == k], nodes) for k in range(rows.classes)], axis=-1)
        raw = np.bincount(at, c, nodes)
        level = {"stats": stats, "raw": raw.astype(np.int64), "feature": np.full(nodes, -1, np.int32), "cut": np.zeros(nodes, np.int32)}
        levels.append(level)
        alive = (_gini(stats) > 1e-12) & (raw >= 2 * s.leaf)
        if depth == s.depth or not alive.any():
            break
        keep = alive[at]
        use, at, y, w, c = use[keep], at[keep], y[keep], w[keep], c[keep]
        drawn = np.argpartition(rng.random((nodes, width)), take - 1, axis=1)[:, :take] if take < width else np.tile(np.arange(width), (nodes, 1))
        best, feature, cut = _cuts(rows, use, at, y, w, c, nodes, drawn, s.leaf)
        split = best > 1e-12
        if not split.any():
            break
        level["feature"], level["cut"] = np.where(split, feature, -1).astype(np.int32), cut
        keep = split[at]
        use, at = use[keep], at[keep]
        child = 2 * (np.cumsum(split) - 1)[at] + (rows.bins.ravel()[use * width + feature[at]] > cut[at])
        order = np.argsort(child, kind="stable")
        use, at = use[order], child[order]
    return _numbered(levels)


def _numbered(levels: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Levels as one table: sides of one prediction joined, then numbered as a walk from the left meets them."""
    ends = np.cumsum([0, *(len(level["raw"]) for level in levels)])
    table = {k: np.concatenate([level[k] for level in levels]) for k in levels[0]}
    n = int(ends[-1])
    table["prediction"] = table["stats"].argmax(axis=1).astype(float)
    below = np.full(n, -1, np.int64)
    for i, level in enumerate(levels):
        split = np.flatnonzero(level["feature"] >= 0)
        below[ends[i] + split] = ends[i + 1] + 2 * np.arange(len(split)) if len(split) else below[:0]
    size = np.ones(n, np.int64)
    for i in range(len(levels) - 1, -1, -1):
        at = ends[i] + np.flatnonzero(below[ends[i]:ends[i + 1]] >= 0)
        left, right = below[at], below[at] + 1
        joined = (below[left] < 0) & (below[right] < 0) & (table["prediction"][left] == table["prediction"][right])
        below[at[joined]] = -1
        at, left, right = at[~joined], left[~joined], right[~joined]
        size[at] = 1 + size[left] + size[right]
    number = np.full(n, -1, np.int64)
    number[0] = 0
    for i in range(len(levels)):
        at = ends[i] + np.flatnonzero((below[ends[i]:ends[i + 1]] >= 0) & (number[ends[i]:ends[i + 1]] >= 0))
        number[below[at]] = number[at] + 1
        number[below[at] + 1] = number[at] + 1 + size[below[at]]
    kept = np.flatnonzero(number >= 0)
    kept = kept[np.argsort(number[kept])]
    split = below[kept] >= 0
    out = {k: table[k][kept] for k in ("stats", "raw", "cut", "prediction")}
    out["feature"] = np.where(split, table["feature"][kept], -1)
    out["below"] = np.where(split, number[below[kept]], -1)
    out["above"] = np.where(split, number[np.where(split, below[kept] + 1, 0)], -1)
    out["impurity"] = _gini(out["stats"])
    weight = out["stats"].sum(axis=1)
    sides = sum((weight[out[c]] * out["impurity"][out[c]]) for c in ("below", "above"))
    out["gain"] = np.where(split, out["impurity"] - sides / np.where(weight > 0, weight, 1.0), -1.0)
    return out


def _batch(tree: int, t: dict[str, np.ndarray], edges: list[np.ndarray]) -> pa.RecordBatch:
    n, split = len(t["raw"]), t["feature"] >= 0
    ints = lambda v: pa.array(np.asarray(v), pa.int32())
    each = t["stats"].shape[1]
    stats = pa.ListArray.from_arrays(ints(np.arange(n + 1) * each), pa.array(t["stats"].ravel()))
    thresholds = [float(edges[f][c]) for f, c in zip(t["feature"][split], t["cut"][split])]
    cuts = pa.ListArray.from_arrays(ints(np.concatenate([[0], np.cumsum(split)])), pa.array(thresholds, pa.float64()))
    by = pa.StructArray.from_arrays([ints(t["feature"]), cuts, ints(np.full(n, -1))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    parts = {"id": ints(np.arange(n)), "prediction": pa.array(t["prediction"]), "impurity": pa.array(t["impurity"]), "impurityStats": stats,
             "rawCount": pa.array(t["raw"]), "gain": pa.array(t["gain"]), "leftChild": ints(t["below"]), "rightChild": ints(t["above"]), "split": by}
    nodes = pa.StructArray.from_arrays(list(parts.values()), list(parts))
    return pa.RecordBatch.from_arrays([ints(np.full(n, tree)), nodes], ["treeID", "nodeData"])


def _described(spark: SparkSession, kind: str, uid: str, params: dict, **more) -> str:
    about = {"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid}
    return json.dumps(about | {"paramMap": params, "defaultParamMap": {}} | more)


def fits(rows: int, width: int, bins: int) -> bool:
    """Whether the binned rows may be sent to the tasks."""
    return 0 < rows and 0 < width and bins <= 256 and rows * width <= SENT_VALUES


@dataclass
class GrownForest:
    """A fitted forest: where its nodes are stored, and of each tree what scoring needs.

    A node takes 30 bytes in the driver and the tasks; as a model of ``pyspark.ml`` it would
    take some hundreds in the driver's heap.
    """

    path: str
    trees: list[tuple[np.ndarray, ...]]
    importances: np.ndarray
    width: int

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.importances)

    def _walked(self, column: str, kind: str, found) -> Column:
        sent = SparkContext._active_spark_context.broadcast(self.trees)

        @F.pandas_udf(kind)
        def walked(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object if "array" in kind else float)
            v = np.stack(x.to_numpy()).astype(float)
            rows = np.arange(len(v))
            ends = []
            for tree in sent.value:
                feature, threshold, below, above = tree[:4]
                at, going = np.zeros(len(v), np.int32), rows
                while len(going):
                    here = at[going]
                    f = feature[here]
                    going, here, f = going[f >= 0], here[f >= 0], f[f >= 0]
                    at[going] = np.where(v[going, f] <= threshold[here], below[here], above[here])
                ends.append(found(tree, at))
            return pd.Series(list(np.stack(ends, axis=1))) if "array" in kind else pd.Series(sum(ends) / max(1, len(ends)))

        return walked(F.col(column))

    def probability(self, x: str = "x") -> Column:
        """Mean over trees of the share of class 1 in the leaf that a row falls into."""
        return self._walked(x, "double", lambda tree, at: tree[4][at])

    def leaves(self, x: str = "x") -> Column:
        """The number of each tree's leaf that a row falls into, leaves counted by node."""
        return self._walked(x, "array<int>", lambda tree, at: tree[5][at])

    def save(self, spark: SparkSession, path: str) -> None:
        """Stored as a model of ``pyspark.ml`` is."""
        for part in ("data", "treesMetadata"):
            spark.read.parquet(f"{self.path}/{part}").write.parquet(f"{path}/{part}")
        spark.read.text(f"{self.path}/metadata").coalesce(1).write.text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GrownForest:
        """Trees are packed in tasks, of which the driver gets the bytes alone."""
        width = json.loads(spark.read.text(f"{path}/metadata").first()[0])["numFeatures"]

        def pack(table: pa.Table) -> pa.Table:
            packed = _packed(table, width)
            return pa.table({"tree": pa.array([table.column("treeID")[0].as_py()], pa.int32()), "packed": pa.array([pickle.dumps(packed)], pa.binary())})

        found = spark.read.parquet(f"{path}/data").groupBy("treeID").applyInArrow(pack, "tree int, packed binary").toArrow()
        parts = [pickle.loads(p) for _, p in sorted(zip(found.column("tree").to_pylist(), found.column("packed").to_pylist()))]
        total = sum((own for _, own in parts), np.zeros(width))
        return cls(path, [tree for tree, _ in parts], total / total.sum() if total.sum() > 0 else total, width)


def _packed(table: pa.Table, width: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Feature, threshold, sides, share of class 1 and leaf number by node of a tree, and what its features gain."""
    nodes = table.column("nodeData").combine_chunks()
    nodes = nodes if isinstance(nodes, pa.StructArray) else pa.concat_arrays(nodes.chunks)
    nodes = nodes.take(pa.array(np.argsort(nodes.field("id").to_numpy())))
    below, above, gain = (nodes.field(c).to_numpy() for c in ("leftChild", "rightChild", "gain"))
    split = below >= 0
    stats = nodes.field("impurityStats").flatten().to_numpy().reshape(len(nodes), -1)
    size, by = stats.sum(axis=1), nodes.field("split")
    feature, threshold = np.where(split, by.field("featureIndex").to_numpy(), -1).astype(np.int16), np.zeros(len(nodes))
    threshold[split] = by.field("leftCategoriesOrThreshold").flatten().to_numpy()
    share = stats[:, 1] / np.where(size > 0, size, 1.0) if stats.shape[1] > 1 else np.zeros(len(nodes))
    leaf = np.where(split, -1, np.cumsum(~split) - 1).astype(np.int32)
    own = np.bincount(feature[split], (gain * size)[split], width)
    return (feature, threshold, below.astype(np.int32), above.astype(np.int32), share, leaf), own / own.sum() if own.sum() > 0 else own


def fit(df: DataFrame, s: ForestSettings, label: str = "class", weight: str | None = None) -> GrownForest:
    """A forest on (``x``, label[, weight]) rows, as many as ``fits`` lets through."""
    spark = df.sparkSession
    edges = quantile_edges(df, s.bins)
    rows = Rows.of(df, edges, label, weight)
    sent, width = spark.sparkContext.broadcast((rows, edges)), len(edges)

    def run(batches):
        rows, edges = sent.value
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                yield _batch(tree, grow(rows, tree, s), edges)

    path = scratch_path(spark, "model-grown-forest")
    # Some trees a task: a few tasks a core, as trees differ in size.
    tasks = min(s.trees, 4 * spark.sparkContext.defaultParallelism)
    spark.range(0, s.trees, 1, tasks).mapInArrow(run, NODES).write.parquet(f"{path}/data")
    sent.destroy()
    params = {"labelCol": label, "featuresCol": "features", "maxDepth": s.depth, "minInstancesPerNode": s.leaf, "maxBins": s.bins, "seed": s.seed, "impurity": "gini"}
    params |= {"weightCol": weight} if weight else {}
    of_tree = [(i, _described(spark, "DecisionTreeClassificationModel", f"dtc_{i}", params, numFeatures=width, numClasses=rows.classes), 1.0)
               for i in range(s.trees)]
    spark.createDataFrame(of_tree, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = params | {"numTrees": s.trees, "featureSubsetStrategy": "sqrt", "bootstrap": s.bootstrap}
    uid = f"RandomForestClassifier_{path[-12:]}"
    text = _described(spark, "RandomForestClassificationModel", uid, whole, numFeatures=width, numClasses=rows.classes, numTrees=s.trees)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GrownForest.load(spark, path)
