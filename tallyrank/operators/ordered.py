"""Ordered work over whole tables without putting a group into one task.

All tools are built on passes that count rows by coarse buckets first:

* ``order_points`` finds the key at given ranks of a hash order, per label;
* ``prefix_sums`` gives running totals over an ordered value;
* ``rank_brackets`` finds, per key, few rows around a wanted rank;
* ``values_at_ranks`` and ``group_percentiles`` give exact order statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyrank.functions.hashing import HASH_BITS
from tallyrank.session import materialize

BUCKET_BITS = 16
# Classes times wanted ranks; a column with more than that is not a label.
MAX_EDGES = 400
# Rows of a bracket that one task may order.
SLACK = 100_000


def order_points(
    df: DataFrame, label: str, hash_col: str, ties: Sequence[str], ranks: Column, total: str = "n"
) -> dict:
    """Keys ``(hash, *ties)`` sitting at the 1-based ``ranks`` of each label.

    ``ranks`` is an array column over ``total``, the rows of the label.  One
    pass counts rows per (label, hash bucket); only rows of the few buckets
    holding a wanted rank are then ordered, so the data itself never moves.
    Returns ``{label: {index of the rank: key}}``, at most ``MAX_EDGES`` keys.
    """
    bucket = F.shiftright(F.col(hash_col), HASH_BITS - BUCKET_BITS)
    keyed = df.select(label, F.col(hash_col).alias("_h"), *ties, bucket.alias("_b"))
    by_label = W.partitionBy(label)
    counts = (
        keyed.groupBy(label, "_b")
        .agg(F.count("*").alias("_c"))
        .withColumn("_before", F.sum("_c").over(by_label.orderBy("_b")) - F.col("_c"))
        .withColumn(total, F.sum("_c").over(by_label))
    )
    edges = (
        counts.select(label, "_b", "_before", "_c", F.posexplode(ranks).alias("_i", "_r"))
        .filter((F.col("_before") < F.col("_r")) & (F.col("_r") <= F.col("_before") + F.col("_c")))
        .select(label, "_b", "_i", (F.col("_r") - F.col("_before")).alias("_rest"))
    )
    found = edges.limit(MAX_EDGES + 1).collect()
    if len(found) > MAX_EDGES:
        raise ValueError(f"{label} has too many classes for a label column")
    out: dict = {}
    if not found:
        return out

    def at(r) -> Column:
        return F.col(label).eqNullSafe(F.lit(r[label])) & (F.col("_b") == F.lit(r["_b"]))

    spots = {(r[label], r["_b"]): r for r in found}
    in_edge = reduce(lambda a, b: a | b, [at(r) for r in spots.values()])
    is_hit = reduce(
        lambda a, b: a | b, [at(r) & (F.col("_rn") == F.lit(r["_rest"])) for r in found]
    )
    order = W.partitionBy(label, "_b").orderBy("_h", *ties)
    hits = keyed.filter(in_edge).withColumn("_rn", F.row_number().over(order)).filter(is_hit)
    keys = {
        (r[label], r["_b"], r["_rn"]): tuple(r[c] for c in ["_h", *ties]) for r in hits.collect()
    }
    for r in found:
        out.setdefault(r[label], {})[r["_i"]] = keys[(r[label], r["_b"], r["_rest"])]
    return out


def at_or_below(hash_col: str, ties: Sequence[str], point: tuple) -> Column:
    """Whether a row's ``(hash, *ties)`` is at or before ``point``."""
    names = [hash_col, *ties]
    test = F.col(names[-1]) <= F.lit(point[-1])
    for name, value in list(zip(names, point))[-2::-1]:
        test = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & test)
    return test


def range_cuts(df: DataFrame, value: str, buckets: int = 1024) -> list[float]:
    """Cut points that spread the values of a column evenly over buckets.

    Holds at most ``buckets - 1`` numbers whatever the table size.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.approxQuantile(value, shares, 1.0 / (4 * buckets))
    return sorted(set(cuts))


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points at or below ``value``, by binary search."""
    if not cuts:
        return F.lit(0)
    step, steps = 1, []
    while step <= len(cuts):
        steps.insert(0, step)
        step *= 2
    table = F.array(*[F.lit(float(c)) for c in cuts])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, jump: F.when(F.get(table, at + jump - 1) <= value, at + jump).otherwise(at),
    )


def prefix_sums(
    df: DataFrame, group: str, value: str, totals: Sequence[str], bucket: Column, descending=False
) -> DataFrame:
    """Running totals of ``totals`` over the order of ``value`` within ``group``.

    ``df`` holds one row per (group, value).  Totals of whole buckets are
    cumulated on the small bucket table; the running sum inside a bucket only
    ever sees that bucket.  ``bucket`` must not decrease with ``value``.  Adds
    ``cum_<t>`` (this row included) and ``all_<t>`` (whole group).
    """
    way = F.desc if descending else F.asc
    # The filter the join below would add to one side only; on both sides it keeps
    # the two uses of the input alike, so its shuffle is computed once.
    binned = df.withColumn("_b", bucket).filter(F.col(group).isNotNull() & F.col("_b").isNotNull())
    by_group = W.partitionBy(group)
    before = by_group.orderBy(way("_b")).rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = binned.groupBy(group, "_b").agg(*[F.sum(t).alias(f"_s_{t}") for t in totals])
    for t in totals:
        bins = bins.withColumn(f"_o_{t}", F.sum(f"_s_{t}").over(before) - F.col(f"_s_{t}"))
        bins = bins.withColumn(f"all_{t}", F.sum(f"_s_{t}").over(by_group))
    bins = bins.drop(*[f"_s_{t}" for t in totals])
    inside = (
        W.partitionBy(group, "_b")
        .orderBy(way(value))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    out = binned.join(bins, [group, "_b"])
    for t in totals:
        out = out.withColumn(f"cum_{t}", F.sum(t).over(inside) + F.col(f"_o_{t}"))
    return out.drop("_b", *[f"_o_{t}" for t in totals])


def values_at_ranks(df: DataFrame, value: str, ranks: Sequence[int], window: int = 1_000_000):
    """Exact values at 0-based ``ranks`` of the sorted column.

    A sketch brackets each rank; the bracket is narrowed until it holds at most
    ``window`` distinct values, and only those are sorted.
    """
    column = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    n = column.count()
    answers = []
    for rank in ranks:
        inside, below, size = column, 0, n
        while True:
            distinct = inside.groupBy("v").agg(F.count("*").alias("c"))
            if size <= window or distinct.limit(window + 1).count() <= window:
                break
            share = (rank - below) / size
            low, high = inside.approxQuantile(
                "v", [max(0.0, share - 1e-3), min(1.0, share + 1e-3)], 2e-4
            )
            counted = column.agg(
                F.sum((F.col("v") < low).cast("bigint")).alias("below"),
                F.sum(F.col("v").between(low, high).cast("bigint")).alias("size"),
            ).first()
            if not counted["below"] <= rank < counted["below"] + counted["size"]:
                raise RuntimeError("quantile sketch missed its error bound")
            if counted["size"] == size:
                break
            below, size = counted["below"], counted["size"]
            inside = column.filter(F.col("v").between(low, high))
        running = W.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
        hit = (
            distinct.withColumn("upto", F.sum("c").over(running) + F.lit(below))
            .filter(F.col("upto") > F.lit(rank))
            .agg(F.min("v"))
            .first()[0]
        )
        answers.append(hit)
    return n, answers


def rank_brackets(
    rows: DataFrame, on: Sequence[str], keys: Sequence[str], value: str, weight: str, wanted: DataFrame,
    slack: int = SLACK, parts: int = 64,
) -> DataFrame:
    """(keys, need, low, high, below): where the running weight of each key reaches ``need``.

    ``rows`` has the columns ``on``, a number ``value`` and its positive ``weight``;
    ``wanted`` has ``keys``, which hold ``on``, and ``need``.  Between ``low`` and ``high``,
    both values that occur, lie at most ``slack`` rows (or rows of one value); ``below`` is
    the weight of the rows under ``low`` and less than ``need``.  A ``need`` beyond the
    whole weight counts as the whole; keys without rows give none, null values none.

    Each round counts the rows of brackets that are still too large in ``parts`` equal
    parts, map-side first, and keeps the one that the rank falls into.
    """
    column = rows.select(*on, F.col(value).alias("v"), F.col(weight).alias("w")).filter("v is not null")
    whole = column.groupBy(*on).agg(
        F.count("*").alias("rows"), F.sum("w").alias("all"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = wanted.join(whole, list(on)).select(
        *keys, F.least("need", "all").alias("need"), F.lit(0).cast("bigint").alias("below"), "rows", "low", "high")
    state = materialize(state, "brackets")
    half = lambda c: F.col(c).cast("double") * F.lit(0.5)  # noqa: E731  differences can't overflow
    wide = (half("high") - half("low")) / F.lit(float(parts))
    open_ = (F.col("rows") > slack) & (wide > 0)
    while state.filter(open_).limit(1).count():
        inside = column.join(state.filter(open_).drop("rows"), list(on)).filter(F.col("v").between(F.col("low"), F.col("high")))
        part = F.least(F.floor((half("v") - half("low")) / wide), F.lit(parts - 1))
        counted = inside.groupBy(*keys, "need", "below", part.alias("part")).agg(
            F.count("*").alias("rows"), F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"))
        order = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
        upto = counted.withColumn("upto", F.col("below") + F.sum("w").over(order))
        found = upto.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("w") < F.col("need")))
        found = found.withColumn("below", F.col("upto") - F.col("w")).select(state.columns)
        state = materialize(state.filter(~open_).union(found), "brackets")
    return state.drop("rows")


def group_percentiles(df: DataFrame, group: str, value: str, shares: Sequence[float], slack: int = SLACK) -> DataFrame:
    """Exact value at index ``floor(n * share)`` of each group's sorted values.

    Returns (group, share, value).  Brackets are narrowed by counting until they hold at
    most ``slack`` distinct values, and only those are ordered, so no task orders more,
    however large a group is.
    """
    distinct = df.select(F.col(group), F.col(value).alias("v")).groupBy(group, "v").agg(F.count("*").alias("w"))
    distinct = materialize(distinct.filter(F.col("v").isNotNull() & F.col(group).isNotNull()), "distinct")
    n = distinct.groupBy(group).agg(F.sum("w").alias("n")).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    wanted = n.select(group, "share", (F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1) + 1).alias("need"))
    brackets = rank_brackets(distinct, [group], [group, "share"], "v", "w", wanted, slack)
    inside = distinct.join(brackets, group).filter(F.col("v").between(F.col("low"), F.col("high")))
    running = W.partitionBy(group, "share").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        inside.withColumn("upto", F.col("below") + F.sum("w").over(running))
        .filter(F.col("upto") >= F.col("need"))
        .groupBy(group, "share")
        .agg(F.min("v").alias(value))
    )
