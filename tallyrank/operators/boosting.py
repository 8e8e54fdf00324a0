"""Gradient-boosted trees of the second order on histograms (Chen, Guestrin, KDD 2016).

Rows are cut into bins once and stay where they are.  Each level of a tree is one
aggregate: every task sums gradients and curvatures by (node, feature, bin), Spark adds
the sums up, and the driver picks each node's split from a histogram whose size depends
on nodes, features and bins only.  Rows that are one task's worth stay in it for all
rounds: one job.  Sums are of whole numbers (a fixed point), so they don't depend on how
rows are dealt.  The loss of the held-out rows comes with the first
level of the next round; after ``patience`` rounds without a better one training ends
and the rounds up to the best are kept.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyrank.contract import SEED
from tallyrank.session import materialize

# Gradients and losses are summed in units of this.
UNIT = 2.0 ** -24
# Rounds after which rows are written anew with their scores; tasks add up the trees since.
REFRESH = 8
# Binned values that are worth a task of their own: 32 MB in it, some minute of 100 rounds.
TASK_VALUES = 32_000_000
NODES = (
    "tree int, node int, feature int, bin int, threshold double, below int, above int, "
    "value double, gain double, cover double"
)


@dataclass
class BoostSettings:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 64
    ridge: float = 1.0
    least_curvature: float = 1.0
    patience: int = 10
    positive_weight: float = 1.0
    seed: int = SEED


def quantile_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Ascending cut values of each feature of ``x``, in one aggregate; NaN lies above all cuts."""
    # A group a feature: a column each would make a plan of features times shares that the driver keeps.
    cells = rows.select(F.size("x").alias("width"), F.posexplode("x").alias("feature", "v"))
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = cells.groupBy("feature").agg(
        F.max("width").alias("width"),
        F.percentile_approx(F.nanvl("v", F.lit(None).cast("double")), shares, 10 * bins).alias("cuts")).collect()
    found = {r["feature"]: r["cuts"] for r in cuts}
    width = max((r["width"] for r in cuts), default=0)
    return [np.unique(np.array(found[i] if found[i] is not None else [], float)) for i in range(width)]


def equal_edges(low: list[float], high: list[float], bins: int) -> list[np.ndarray]:
    return [np.array([a + (b - a) * i / bins for i in range(1, bins)]) for a, b in zip(low, high)]


def _arrays(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def binned(rows: DataFrame, edges: list[np.ndarray], label: str = "class") -> DataFrame:
    """``y, held, mixed, bins, score`` of (x, label[, held_out]) rows; a value's bin counts the cuts below it."""
    held = F.col("held_out") if "held_out" in rows.columns else F.lit(False)
    # Rows without an id of their own are told apart by what they hold.
    mixed = F.xxhash64(*(["id"] if "id" in rows.columns else []), "x", label)
    rows = rows.select(F.col(label).cast("int").alias("y"), held.alias("held"), mixed.alias("mixed"), "x")

    def run(batches):
        for batch in batches:
            x = _arrays(batch.column("x"), float)
            cut = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.int16)
            ends = np.arange(len(cut) + 1, dtype=np.int32) * cut.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("y", "held", "mixed")), pa.ListArray.from_arrays(pa.array(ends), pa.array(cut.ravel())),
                 pa.array(np.zeros(len(cut)))], ["y", "held", "mixed", "bins", "score"])

    return rows.mapInArrow(run, "y int, held boolean, mixed long, bins array<smallint>, score double")


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each whole number and a seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2 ** 64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(11)).astype(float) / 2.0 ** 53


@dataclass
class _Tree:
    """Splits and leaves by node number: root 1, children 2n and 2n + 1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, depth: int) -> _Tree:
        n = 2 ** (depth + 1)
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Where rows are after ``levels`` splits; a row stays at a node without one."""
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            below = bins[rows, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(f < 0, at, 2 * at + ~below)
        return at


def _scores(batch: pa.RecordBatch, bins: np.ndarray, trees: list[_Tree], s: BoostSettings) -> np.ndarray:
    out = batch.column("score").to_numpy().copy()
    for tree in trees:
        out += s.rate * tree.value[tree.node(bins, s.depth)]
    return out


def _loss(y: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, np.where(y > 0, -score, score))


class _Sums:
    """Sums by (node of a level, feature, bin) of a task's rows, in units; at the root their losses and weights too."""

    def __init__(self, s: BoostSettings, rnd: int, level: int, width: int, most: int, used: np.ndarray):
        self.s, self.rnd, self.level, self.used, self.width, self.most = s, rnd, level, used, width, most
        self.g, self.h = (np.zeros(2 ** level * width * most, np.int64) for _ in range(2))
        self.loss = np.zeros((2, 2), np.int64)

    def add(self, batch: pa.RecordBatch, trees: list[_Tree], growing: _Tree) -> None:
        s, nodes = self.s, 2 ** self.level
        bins, y = _arrays(batch.column("bins"), np.int64), batch.column("y").to_numpy()
        held = batch.column("held").to_numpy(zero_copy_only=False)
        score = _scores(batch, bins, trees, s)
        weight = np.where(y > 0, s.positive_weight, 1.0)
        if self.level == 0:
            lost = np.rint(weight * _loss(y, score) / UNIT).astype(np.int64)
            units = np.rint(weight / UNIT).astype(np.int64)
            for i, rows in enumerate((~held, held)):
                self.loss[i] += lost[rows].sum(), units[rows].sum()
        at = growing.node(bins, self.level) - nodes
        use = ~held & (at >= 0) & (_mixed(batch.column("mixed").to_numpy(), s.seed + self.rnd) < s.row_share)
        p = 1.0 / (1.0 + np.exp(-score))
        g = np.rint(weight * (p - y) / UNIT).astype(np.int64)[use]
        h = np.rint(weight * p * (1.0 - p) / UNIT).astype(np.int64)[use]
        start = at[use] * (self.width * self.most)
        for f in self.used:
            key = start + f * self.most + bins[use, f]
            np.add.at(self.g, key, g)
            np.add.at(self.h, key, h)

    def rows(self) -> pa.RecordBatch:
        """``key, g, h`` of the sums that are not zero; losses under keys -1 and -2."""
        keys = np.flatnonzero(self.h)
        more = np.array([-1, -2] if self.level == 0 else [], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([keys, more])), pa.array(np.concatenate([self.g[keys], self.loss[:len(more), 0]])),
             pa.array(np.concatenate([self.h[keys], self.loss[:len(more), 1]]))], ["key", "g", "h"])

    def read(self, table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[float, float]]]:
        """Gradients and curvatures by (node, feature, bin), and losses, of added-up ``rows``."""
        key, *two = (table.column(c).to_numpy() for c in ("key", "g", "h"))
        out = np.zeros((2, len(self.g)))
        own = key >= 0
        for i in range(2):
            out[i, key[own]] = two[i][own] * UNIT
        losses = {int(k): (a * UNIT, b * UNIT) for k, a, b in zip(key[~own], two[0][~own], two[1][~own])}
        return *out.reshape(2, 2 ** self.level, self.width, self.most), losses


def split_gains(g: np.ndarray, h: np.ndarray, s: BoostSettings) -> np.ndarray:
    """Gain of cutting after each bin, of sums by (..., feature, bin); -inf where a side has too little curvature."""
    gl, hl = np.cumsum(g, axis=-1), np.cumsum(h, axis=-1)
    gt, ht = gl[..., -1:], hl[..., -1:]
    gr, hr = gt - gl, ht - hl
    gain = 0.5 * (gl ** 2 / (hl + s.ridge) + gr ** 2 / (hr + s.ridge) - gt ** 2 / (ht + s.ridge))
    return np.where((hl >= s.least_curvature) & (hr >= s.least_curvature), gain, -np.inf)


def _grown(s: BoostSettings, rnd: int, width: int, most: int, sums):
    """A tree, its nodes' gain and cover, and the losses before it; ``sums(level, tree, features)`` gives a level's sums."""
    tree, stats = _Tree.of(s.depth), {}
    order = np.argsort(_mixed(np.arange(width), s.seed + 7919 * (rnd + 1)), kind="stable")
    used = np.sort(order[:max(1, int(np.ceil(s.column_share * width)))])
    losses: tuple[float, float | None] = (0.0, None)
    for level in range(s.depth):
        g, h, lost = sums(level, tree, used)
        if level == 0:
            mean = [lost[k][0] / lost[k][1] if lost.get(k, (0, 0))[1] else None for k in (-1, -2)]
            losses = (mean[0] or 0.0, mean[1])
            total = g[0, used[0]].sum(), h[0, used[0]].sum()
            tree.value[1], stats[1] = -total[0] / (total[1] + s.ridge), (0.0, float(total[1]))
            if rnd == s.rounds:  # the losses of the last round are all that is asked for
                break
        gains = split_gains(g[:, used], h[:, used], s)
        grown = False
        for n in range(2 ** level):
            node = 2 ** level + n
            place = int(np.argmax(gains[n]))
            f, cut = used[place // most], place % most
            gain = gains[n].ravel()[place]
            if not gain > 1e-12:
                continue
            grown = True
            tree.feature[node], tree.cut[node] = f, cut
            stats[node] = (float(gain), float(h[n, f].sum()))
            for child, part in ((2 * node, slice(None, cut + 1)), (2 * node + 1, slice(cut + 1, None))):
                gc, hc = g[n, f, part].sum(), h[n, f, part].sum()
                tree.value[child], stats[child] = -gc / (hc + s.ridge), (0.0, float(hc))
        if not grown:
            break
    return tree, stats, losses


class _Held:
    """The rows of a fit that are one task's worth, and their scores under the trees so far."""

    def __init__(self, s: BoostSettings, width: int, most: int, y, held, mixed, bins: np.ndarray, score):
        self.s, self.width, self.most = s, width, most
        self.y, self.held, self.mixed, self.bins, self.score = y, held, mixed, bins, score
        self.weight = np.where(y > 0, s.positive_weight, 1.0)
        self.at = np.ones(len(y), np.int64)

    @classmethod
    def of(cls, batches, s: BoostSettings, width: int, most: int) -> _Held:
        small = np.uint8 if most <= 256 else np.int16
        parts = [(b.column("y").to_numpy(), b.column("held").to_numpy(zero_copy_only=False), b.column("mixed").to_numpy(),
                  _arrays(b.column("bins"), small), b.column("score").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            parts = [(np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros((0, width), small), np.zeros(0))]
        y, held, mixed, bins, score = (np.concatenate(c) for c in zip(*parts))
        return cls(s, width, most, y, held, mixed, np.asfortranarray(bins), score)

    def add(self, tree: _Tree) -> None:
        self.score = self.score + self.s.rate * tree.value[tree.node(self.bins, self.s.depth)]

    def _units(self, rnd: int) -> None:
        """Gradients and curvatures of the rows a round uses, all at its root."""
        score, weight, y = self.score, self.weight, self.y
        p = 1.0 / (1.0 + np.exp(-score))
        self.use = np.flatnonzero(~self.held & (_mixed(self.mixed, self.s.seed + rnd) < self.s.row_share))
        self.g = np.rint(weight * (p - y) / UNIT)[self.use]
        self.h = np.rint(weight * p * (1.0 - p) / UNIT)[self.use]
        self.at = np.ones(len(self.use), np.int64)

    def _losses(self) -> dict[int, tuple[float, float]]:
        lost = np.rint(self.weight * _loss(self.y, self.score) / UNIT).astype(np.int64)
        units = np.rint(self.weight / UNIT).astype(np.int64)
        sides = {-1: ~self.held, -2: self.held}
        return {k: (int(lost[rows].sum()) * UNIT, int(units[rows].sum()) * UNIT) for k, rows in sides.items()}

    def sums(self, rnd: int, level: int, growing: _Tree, used: np.ndarray):
        """Gradients, curvatures and losses of a level, as ``_Sums.read`` gives them."""
        nodes, most = 2 ** level, self.most
        if level == 0:
            self._units(rnd)
        else:  # one step down; rows at a node without a split are done
            f = growing.feature[self.at]
            down = np.flatnonzero(f >= 0)
            self.use, self.g, self.h, f, at = self.use[down], self.g[down], self.h[down], f[down], self.at[down]
            self.at = 2 * at + (self.bins[self.use, f] > growing.cut[at])
        start = (self.at - nodes) * most
        out = np.zeros((2, nodes, self.width, most))
        # Sums of doubles that hold whole numbers are exact below 2 ** 53.
        exact = len(self.g) * max(np.abs(self.g).max(initial=0.0), self.h.max(initial=0.0)) < 2.0 ** 53
        for f in used:
            key = start + self.bins[:, f][self.use]
            for i, v in enumerate((self.g, self.h)):
                if exact:
                    found = np.bincount(key, v, nodes * most)
                else:
                    found = np.zeros(nodes * most, np.int64)
                    np.add.at(found, key, v.astype(np.int64))
                out[i, :, f] = (found * UNIT).reshape(nodes, most)
        return out[0], out[1], self._losses() if level == 0 else {}


def _best(history: list[tuple[int, float, float | None]]) -> int | None:
    """The first round of the least held-out loss; None without held-out rows."""
    best, place = np.inf, None
    for rnd, _, held in history:
        if held is not None and held < best:
            best, place = held, rnd
    return place


def _rounds(s: BoostSettings, grow, add) -> list[tuple[int, float, float | None]]:
    """Rounds until patience ends; ``grow(round)`` gives a tree and the losses before it, ``add`` keeps it."""
    history: list[tuple[int, float, float | None]] = []
    for rnd in range(s.rounds + 1):
        tree, stats, (train, held) = grow(rnd)
        history.append((rnd, float(train), None if held is None else float(held)))
        best = _best(history)
        if held is not None and best != rnd and rnd - (best or 0) >= s.patience:
            break
        if rnd == s.rounds or tree.feature[1] < 0:
            break
        add(tree, stats)
    return history


@dataclass
class BoostedTrees:
    """Fitted trees as a table of nodes, and the losses of every round tried.

    ``history`` has (round, train loss, held-out loss) for round 0, before any tree, on.
    """

    nodes: pd.DataFrame
    rate: float
    width: int
    history: list[tuple[int, float, float | None]] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return int(self.nodes["tree"].max()) + 1 if len(self.nodes) else 0

    def probability(self, x: str = "x", rounds: int | None = None) -> Column:
        """Probability of the positive class, as a column; ``rounds`` uses the first trees only."""
        table = self.nodes if rounds is None else self.nodes[self.nodes["tree"] < rounds]
        trees, rate = table["tree"].to_numpy(int), self.rate
        size = int(table["node"].max()) + 1 if len(table) else 1
        shape = (int(trees.max()) + 1 if len(trees) else 0, size)
        feature = np.full(shape, -1, np.int32)
        threshold, value = np.zeros(shape), np.zeros(shape)
        at = (trees, table["node"].to_numpy(int))
        feature[at], threshold[at], value[at] = table["feature"], table["threshold"], table["value"]
        depth = int(np.log2(max(size - 1, 1)))

        @F.pandas_udf("double")
        def scored(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype=float)
            v = np.stack(column.to_numpy()).astype(float)
            score, rows = np.zeros(len(v)), np.arange(len(v))
            for f, t, leaf in zip(feature, threshold, value):
                node = np.ones(len(v), np.int64)
                for _ in range(depth):
                    below = v[rows, np.maximum(f[node], 0)] <= t[node]
                    node = np.where(f[node] < 0, node, 2 * node + ~below)
                score += rate * leaf[node]
            return pd.Series(1.0 / (1.0 + np.exp(-score)))

        return scored(F.col(x))

    def importance(self) -> pd.DataFrame:
        """``kind, feature, value``: splits, and mean and total gain and cover, of every feature that splits."""
        by = self.nodes[self.nodes["feature"] >= 0].groupby("feature")
        kinds = {"weight": by.size().astype(float), "gain": by["gain"].mean(), "cover": by["cover"].mean(),
                 "total_gain": by["gain"].sum(), "total_cover": by["cover"].sum()}
        parts = [pd.DataFrame({"kind": k, "feature": v.index.astype("int32"), "value": v.to_numpy()}) for k, v in kinds.items()]
        return pd.concat(parts, ignore_index=True)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODES).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(self.rate, self.width)], "rate double, width int").write.parquet(f"{path}/about")
        spark.createDataFrame(self.history, "round int, train double, held double").coalesce(1).write.parquet(f"{path}/history")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
        about = spark.read.parquet(f"{path}/about").first()
        history = sorted(tuple(r) for r in spark.read.parquet(f"{path}/history").collect())
        return cls(nodes, about["rate"], about["width"], history)


class Booster:
    """One fit: the binned rows, the trees so far and what they cost."""

    def __init__(self, rows: DataFrame, settings: BoostSettings, edges: list[np.ndarray] | None = None, label: str = "class",
                 task_values: int = TASK_VALUES):
        self.s = settings
        train = rows.filter(~F.col("held_out")) if "held_out" in rows.columns else rows
        self.edges = quantile_edges(train, settings.bins) if edges is None else edges
        self.width, self.most = len(self.edges), max([len(e) + 1 for e in self.edges], default=1)
        self.rows = materialize(binned(rows, self.edges, label), "binned")
        # Tasks of about as many values each: a round is many short jobs.
        self.tasks = max(1, -(-self.rows.count() * max(1, self.width) // task_values))
        if self.tasks < len(self.rows.inputFiles()):
            self.rows = materialize(self.rows.coalesce(self.tasks), "binned")
        self.pending: list[_Tree] = []
        self.trees: list[_Tree] = []
        self.gains: list[dict[int, tuple[float, float]]] = []

    def sums(self, rnd: int, level: int, growing: _Tree, used: np.ndarray):
        """The sums of a level over all rows: one aggregate."""
        sent = self.rows.sparkSession.sparkContext.broadcast((self.pending, growing))
        args = (self.s, rnd, level, self.width, self.most, used)

        def run(batches):
            part = _Sums(*args)
            for batch in batches:
                part.add(batch, *sent.value)
            yield part.rows()

        found = self.rows.mapInArrow(run, "key long, g long, h long").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        table = found.toArrow()
        sent.destroy()
        return _Sums(*args).read(table)

    def root_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and curvatures of all rows by (feature, bin), under the scores so far."""
        g, h, _ = self.sums(len(self.trees), 0, _Tree.of(self.s.depth), np.arange(self.width))
        return g[0], h[0]

    def grow(self, rnd: int) -> tuple[_Tree, dict[int, tuple[float, float]], tuple[float, float | None]]:
        """A tree on the current scores, its nodes' gain and cover, and the losses before it."""
        return _grown(self.s, rnd, self.width, self.most, lambda *a: self.sums(rnd, *a))

    def rounds_in_one_task(self) -> list[tuple[int, float, float | None]]:
        """All rounds in the task that holds the rows; the history, and the trees as ``add`` keeps them.

        No job is needed between the levels and rounds: the task adds up the same whole
        numbers and picks the same splits.
        """
        args = (self.s, self.width, self.most)

        def run(batches):
            held = _Held.of(batches, *args)
            trees = []

            def grow(rnd):
                return _grown(args[0], rnd, *args[1:], lambda *a: held.sums(rnd, *a))

            def add(tree, stats):
                trees.append((tree, stats))
                held.add(tree)

            history = _rounds(args[0], grow, add)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((trees, history))], pa.binary())], ["fitted"])

        # All of the output is read: a worker that is left before its end is lost to the next job.
        found = self.rows.coalesce(1).mapInArrow(run, "fitted binary").toArrow().column("fitted").to_pylist()
        trees, history = pickle.loads(found[0])
        self.trees, self.gains = [t for t, _ in trees], [g for _, g in trees]
        return history

    def add(self, tree: _Tree, stats: dict[int, tuple[float, float]]) -> None:
        self.trees.append(tree)
        self.gains.append(stats)
        self.pending = [*self.pending, tree]
        if len(self.pending) >= REFRESH:
            sent, s = self.rows.sparkSession.sparkContext.broadcast(self.pending), self.s

            def run(batches):
                for batch in batches:
                    scores = _scores(batch, _arrays(batch.column("bins"), np.int64), sent.value, s)
                    yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(scores))

            self.rows = materialize(self.rows.mapInArrow(run, self.rows.schema), "boosted")
            self.pending = []

    def model(self, rounds: int, history: list[tuple[int, float, float | None]]) -> BoostedTrees:
        out = []
        for t, (tree, stats) in enumerate(zip(self.trees[:rounds], self.gains)):
            for node, (gain, cover) in sorted(stats.items()):
                f = int(tree.feature[node])
                split = f >= 0
                # A cut after the last bin can't win, so there is an edge above every cut.
                out.append((t, node, f, int(tree.cut[node]), float(self.edges[f][tree.cut[node]]) if split else 0.0,
                            2 * node if split else -1, 2 * node + 1 if split else -1, float(tree.value[node]), gain, cover))
        return BoostedTrees(pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")]), self.s.rate, self.width, history)


def fit(rows: DataFrame, settings: BoostSettings | None = None, edges: list[np.ndarray] | None = None, label: str = "class",
        task_values: int = TASK_VALUES) -> BoostedTrees:
    """Boosted trees on (x, label[, id, held_out]) rows.

    Rows marked ``held_out`` are never trained on; with some, training ends after
    ``patience`` rounds without a smaller loss of theirs, and the rounds up to the best
    are kept.  Losses are weighted means of the logistic loss, positive rows by
    ``positive_weight`` as in training.  No rows give a model without trees.
    """
    s = settings or BoostSettings()
    booster = Booster(rows, s, edges, label, task_values)
    history: list[tuple[int, float, float | None]] = []
    if booster.width:
        history = booster.rounds_in_one_task() if booster.tasks == 1 else _rounds(s, booster.grow, booster.add)
    best = _best(history)
    return booster.model(len(booster.trees) if best is None else best, history)
