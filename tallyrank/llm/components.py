"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.session import materialize


def _hooked(neighbours: DataFrame, keep) -> DataFrame:
    """Link the kept neighbours ``v`` of each ``u`` to the smallest of ``u`` and its neighbours."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return neighbours.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v``, which is no ``u`` itself; so it is for no edges."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` (longs, in either order).

    ``component`` is the smallest node reachable.  Loops and repeated edges do no
    harm; no edges give no rows.  Each round is two grouped minima and two joins,
    written to the shared folder, and the rounds grow with the logarithm of the
    longest path.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialize(both.distinct(), "edges")
    while not _is_star_forest(now):
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(around, F.col("v") > F.col("u")).where("u <> v").distinct()
        small = _hooked(large, F.lit(True))
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        now = materialize(small.union(least).where("u <> v").distinct(), "edges")
    # A star forest: every node points at its smallest.
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(roots.distinct())
