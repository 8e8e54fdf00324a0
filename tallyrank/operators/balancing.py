"""Oversampling of the minority class between near neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyrank.contract import SEED
from tallyrank.functions.hashing import key_hash, unit_interval
from tallyrank.functions.vectors import between
from tallyrank.operators.neighbours import nearest_neighbours
from tallyrank.operators.ordered import at_or_below, order_points

# Copies of one parent made by one task; more are spread by a shuffle first.
CHUNK = 10_000


@dataclass
class ClassCounts:
    minority: int
    minority_rows: int
    majority_rows: int

    @property
    def missing(self) -> int:
        return self.majority_rows - self.minority_rows


def count_classes(df: DataFrame, label: str) -> ClassCounts:
    counts = {r[0]: r[1] for r in df.groupBy(label).count().limit(3).collect()}
    if len(counts) != 2:
        raise ValueError(f"balancing needs two classes, found {sorted(counts)}")
    small, large = sorted(counts, key=lambda c: (counts[c], -c))
    return ClassCounts(small, counts[small], counts[large])


def _neighbour_lists(minority: DataFrame, k: int) -> DataFrame:
    """Per minority row its neighbours with their vectors, nearest first (at most k)."""
    pairs = nearest_neighbours(minority, minority, k)
    entry = F.struct("rank", "neighbour", F.col("x").alias("nx"))
    return (
        pairs.join(minority.withColumnRenamed("id", "neighbour"), "neighbour")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(entry)).alias("near"))
    )


def _synthesise(parents: DataFrame, copies: Column, most: int, seed: int) -> DataFrame:
    """Rows between each parent and a drawn neighbour, ``copies`` per parent."""
    rows = parents.withColumn("copies", copies).filter(F.col("copies") > 0)
    chunks = F.ceil(F.col("copies") / F.lit(CHUNK)).cast("int")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    if most > CHUNK:
        rows = rows.repartition("id", "chunk")
    low = F.col("chunk").cast("bigint") * CHUNK + 1
    high = F.least(F.col("copies"), (F.col("chunk").cast("bigint") + 1) * CHUNK)
    rows = rows.withColumn("copy", F.explode(F.sequence(low, high)))
    pick = (key_hash(f"{seed}-pick", "id", "copy") % F.size("near")).cast("int")
    rows = rows.select(
        F.col("id").alias("parent"), "copy", "x",
        F.get("near", pick).alias("other"),
        unit_interval(key_hash(f"{seed}-share", "id", "copy")).alias("share"),
    )
    return rows.select(
        "parent", "copy", F.col("other.neighbour").alias("neighbour"), "share",
        between(F.col("x"), F.col("other.nx"), F.col("share")).alias("x"),
    )


def smote(df: DataFrame, label: str = "class", k: int = 5, seed: int = SEED) -> DataFrame:
    """Synthetic minority rows (parent, copy, neighbour, share, x).

    ``df`` has (id, x, label).  Every minority row gets the same number of
    copies; the remainder goes to the rows with the least hash.
    """
    counts = count_classes(df, label)
    minority = df.filter(F.col(label) == counts.minority).select("id", "x")
    if counts.minority_rows < 2:
        raise ValueError("the minority class needs at least two rows")
    each, extra = divmod(counts.missing, counts.minority_rows)
    hashed = minority.withColumn("_hash", key_hash(f"{seed}-extra", "id"))
    copies = F.lit(each).cast("bigint")
    if extra:
        point = order_points(
            hashed.withColumn("_all", F.lit(0)), "_all", "_hash", ["id"],
            F.array(F.lit(extra).cast("bigint")),
        )[0][0]
        copies = copies + at_or_below("_hash", ["id"], point).cast("bigint")
    lists = _neighbour_lists(minority, min(k, counts.minority_rows - 1))
    return _synthesise(hashed.join(lists, "id"), copies, each + 1, seed)


def adasyn_counts(df: DataFrame, label: str = "class", k: int = 5) -> DataFrame:
    """(id, majority_share, copies): more copies where more neighbours are majority."""
    counts = count_classes(df, label)
    minority = df.filter(F.col(label) == counts.minority).select("id", "x")
    pairs = nearest_neighbours(minority, df.select("id", "x"), k)
    labels = df.select(F.col("id").alias("neighbour"), (F.col(label) != counts.minority).alias("other"))
    shares = (
        pairs.join(labels, "neighbour")
        .groupBy("id")
        .agg((F.sum(F.col("other").cast("bigint")) / F.lit(float(k))).alias("majority_share"))
    )
    total = shares.agg(F.sum("majority_share").alias("s")).scalar()
    wanted = F.rint(F.col("majority_share") / total * F.lit(float(counts.missing))).cast("bigint")
    return shares.withColumn(
        "copies",
        F.when(total > 0, wanted).otherwise(
            F.raise_error(F.lit("no minority row has a majority neighbour"))
        ),
    )


def adasyn(df: DataFrame, label: str = "class", k: int = 5, seed: int = SEED) -> DataFrame:
    """Synthetic minority rows as ``smote``, their number by local difficulty."""
    counts = count_classes(df, label)
    minority = df.filter(F.col(label) == counts.minority).select("id", "x")
    lists = _neighbour_lists(minority, min(k, counts.minority_rows - 1))
    wanted = adasyn_counts(df, label, k).select("id", "copies")
    parents = minority.join(lists, "id").join(wanted.withColumnRenamed("copies", "_n"), "id")
    return _synthesise(parents, F.col("_n"), counts.missing, seed)


def balance(df: DataFrame, label: str = "class", method: str = "smote", **kw) -> DataFrame:
    """Original rows and the synthetic ones, as (x, label)."""
    makers = {"smote": smote, "adasyn": adasyn}
    if method not in makers:
        raise ValueError(f"unsupported balancing method: {method}")
    counts = count_classes(df, label)
    made = makers[method](df, label, **kw)
    return df.select("x", label).unionByName(
        made.select("x", F.lit(counts.minority).cast("int").alias(label))
    )


def balance_report(before: DataFrame, after: DataFrame, label: str = "class") -> DataFrame:
    def counted(df, stage):
        return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("records")).withColumn(
            "stage", F.lit(stage)
        )

    return counted(before, "before").unionByName(counted(after, "after"))
