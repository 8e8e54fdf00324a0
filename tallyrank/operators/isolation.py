"""Isolation forest (Liu, Ting, Zhou, ICDM 2008).

Sampling, grouping and scoring are Spark jobs; one tree is grown from at most
256 rows inside a task.  The forest is a table of nodes whose size depends on
the tree count only, so it may be sent to every task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyrank.contract import SEED
from tallyrank.functions.numeric import clip01
from tallyrank.operators.ordered import values_at_ranks

TREES = 100
SAMPLE = 256
CONTAMINATION = 0.002
NODES = (
    "tree int, node int, feature int, threshold double, below int, above int, "
    "size int, depth int"
)


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def tree_samples(df: DataFrame, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, x): ``sample`` rows per tree, drawn without replacement by hash.

    Whether a row may enter a tree depends on the hash of both, at every size, so a row
    may enter several trees.  Trees a row does not enter leave before it is repeated.
    """
    keep = min(1.0, 2.5 * sample / max(n, 1))

    def draw(tree: Column) -> Column:
        return (F.xxhash64("id", tree, F.lit(seed)) / F.lit(2.0**64)) + F.lit(0.5)

    entered = F.sequence(F.lit(0), F.lit(trees - 1))
    if keep < 1.0:
        entered = F.filter(entered, lambda tree: draw(tree) < keep)
    dealt = df.select("id", "x", F.explode(entered).alias("tree")).withColumn("u", draw(F.col("tree")))
    order = W.partitionBy("tree").orderBy("u", "id")
    return (
        dealt.withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= sample)
        .select(F.col("tree").cast("int").alias("tree"), "id", "x")
    )


def _grow(pdf: pd.DataFrame, sample: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    pdf = pdf.sort_values("id")
    x = np.stack(pdf["x"].to_numpy()).astype(float)
    rng = np.random.default_rng([seed, tree])
    limit = max(1, math.ceil(math.log2(max(sample, 2))))
    nodes, todo = [], [(np.arange(len(x)), 0, 0)]
    count = 1
    while todo:
        rows, depth, node = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((tree, node, -1, 0.0, -1, -1, len(rows), depth))
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(low[f], high[f]))
        goes_below = part[:, f] <= t
        below, above = count, count + 1
        count += 2
        nodes.append((tree, node, f, t, below, above, len(rows), depth))
        todo.append((rows[goes_below], depth + 1, below))
        todo.append((rows[~goes_below], depth + 1, above))
    names = [c.split()[0] for c in NODES.split(", ")]
    return pd.DataFrame(nodes, columns=names)


@dataclass
class IsolationForest:
    """A fitted forest: its nodes, and what scores looked like on the train rows."""

    nodes: pd.DataFrame
    sample: int
    offset: float | None = None
    score_min: float | None = None
    score_max: float | None = None

    def score(self, df: DataFrame, out: str = "raw_score") -> DataFrame:
        """Add the raw score; more negative is more anomalous.  Needs column ``x``."""
        table = self.nodes.sort_values(["tree", "node"])
        trees = sorted(table["tree"].unique())
        width = int(table["node"].max()) + 1
        shape = (len(trees), width)
        feature = np.full(shape, -1, dtype=np.int32)
        threshold, leaf = np.zeros(shape), np.zeros(shape)
        below, above = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=np.int32)
        at = (np.searchsorted(trees, table["tree"]), table["node"].to_numpy())
        feature[at], threshold[at] = table["feature"], table["threshold"]
        below[at], above[at] = table["below"], table["above"]
        leaf[at] = table["depth"].to_numpy() + [mean_path(int(s)) for s in table["size"]]
        depth, scale = int(table["depth"].max()), mean_path(self.sample)
        forest = df.sparkSession.sparkContext.broadcast((feature, threshold, below, above, leaf))

        def run(batches):
            feature, threshold, below, above, leaf = forest.value
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["x"].to_numpy()).astype(float)
                rows, total = np.arange(len(x)), np.zeros(len(x))
                for t in range(len(feature)):
                    node = np.zeros(len(x), dtype=np.int32)
                    for _ in range(depth):
                        f = feature[t, node]
                        down = np.where(
                            x[rows, np.maximum(f, 0)] <= threshold[t, node],
                            below[t, node], above[t, node],
                        )
                        node = np.where(f >= 0, down, node)
                    total += leaf[t, node]
                path = total / len(feature)
                yield pdf.assign(**{out: -np.power(2.0, -path / (scale or 1.0))})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, f"{schema}, {out} double")

    def probability(self, raw: str = "raw_score") -> Column:
        return normalised_score(F.col(raw), self.score_min, self.score_max)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODES).write.parquet(f"{path}/nodes")
        state = [(self.sample, self.offset, self.score_min, self.score_max)]
        names = "sample int, offset double, score_min double, score_max double"
        spark.createDataFrame(state, names).write.parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForest":
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(nodes, *spark.read.parquet(f"{path}/state").first())


def grow_forest(
    df: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED
) -> tuple[DataFrame, int]:
    """Node table of a forest grown on (id, x), and the rows used per tree."""
    n = df.count()
    size = min(sample, n)
    dealt = tree_samples(df, n, trees, size, seed)
    return dealt.groupBy("tree").applyInPandas(lambda p: _grow(p, size, seed), NODES), size


def fit(df: DataFrame, trees=TREES, sample=SAMPLE, contamination=CONTAMINATION, seed=SEED) -> IsolationForest:
    """Grow the forest and keep the train-time offset and bounds of its scores."""
    nodes, size = grow_forest(df, trees, sample, seed)
    forest = IsolationForest(nodes.toPandas(), size)
    scored = forest.score(df.select("id", "x")).select("raw_score").persist()
    low, high = score_bounds(scored, "raw_score").first()
    offset = score_offset(scored, "raw_score", contamination)
    scored.unpersist()
    return replace(forest, offset=offset, score_min=low, score_max=high)


def score_bounds(df: DataFrame, raw: str) -> DataFrame:
    """Train-time bounds of the flipped score."""
    return df.agg(F.min(-F.col(raw)).alias("score_min"), F.max(-F.col(raw)).alias("score_max"))


def score_offset(df: DataFrame, raw: str, contamination: float = CONTAMINATION) -> float:
    """Exact score quantile at the contamination share, linear between rows."""
    n = df.count()
    place = contamination * (n - 1)
    low = math.floor(place)
    _, (a, b) = values_at_ranks(df, raw, [low, min(low + 1, n - 1)])
    return a + (b - a) * (place - low)


def anomaly_label(raw: Column, offset: float) -> Column:
    """-1 below the offset, else 1."""
    return F.when(raw - F.lit(offset) < 0, -1).otherwise(1)


def normalised_score(raw: Column, score_min: float | None, score_max: float | None) -> Column:
    """Flip and scale into [0, 1] with train-time bounds; no range gives 0.5."""
    if score_min is None or score_max is None:
        raise RuntimeError("score bounds are unknown: fit the forest first")
    if score_max == score_min:
        return F.lit(0.5)
    return clip01((-raw - F.lit(score_min)) / F.lit(score_max - score_min))
