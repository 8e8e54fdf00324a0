"""Mixing of sources to target weights by weighted fair queueing.

Every source serves its documents in a shuffled order.  A copy's virtual finish time is
the tokens its source has served by its end, over the source's target; copies of all
sources are sorted by that time.  Since the targets add up to the budget, the sorted
stream reaches the budget at time one, where it is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Fixed value: what counts as a word.
WORDS = r"[^\x20\x09-\x0D]+"


def _key(source):
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """``key, source_size, target`` of every source of ``source, size`` rows.

    Sources by code point, null last, take the weights in turn and share ``share`` of
    all sizes; none gets more than ``copies`` times its size, and what it can't take
    the others share by weight.  Sources are few; their rows alone are ordered here.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (turn % len(weights) + 1).cast("int"))
    total = total.select(_key(F.col("source")).alias("key"), "source_size", weight.cast("double").alias("weight"))
    total = total.withColumn("cap", (copies * F.col("source_size")).cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    full = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    total = total.withColumn("level", (budget - full) / left)
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    # The first source that is not filled to its cap sets the level of it and all after
    # it; levels reckoned from later ones are lower.
    level = F.max(F.when(fits, F.col("level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return total.select("key", "source_size", target.alias("target"))


def served(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = MOST_COPIES, share: float = 1.0,
           seed: str = "mix") -> DataFrame:
    """``docs`` with ``size, source_size, target, start, taken``: where a document lies in
    its source's order and how many words of it, repeats counted, the mix takes.

    ``docs`` has ``doc_id, source`` and ``text``; other columns are kept, but for those
    of the names given here.  A null or empty text has size 0 and takes nothing, a null
    source is a source, a null ``doc_id`` is shuffled as an empty one; repeated rows are
    documents of their own; a corpus without words has targets of 0; no rows give none.

    Running sums are taken in two steps, within and over pieces of a source's shuffled
    order, so a hot source is spread over as many tasks as it has pieces.
    """
    digits = max(2, (len(f"{16 * int(docs.sparkSession.conf.get('spark.sql.shuffle.partitions')):x}")))
    names = ("size", "source_size", "target", "start", "taken", "key", "place", "piece")
    kept = docs.drop(*names)
    sized = kept.withColumn("size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long"))
    place = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = sized.withColumn("key", _key(F.col("source"))).withColumn("place", place)
    sized = sized.withColumn("piece", F.substring("place", 1, digits))
    pieces = sized.groupBy("key", "piece").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    pieces = pieces.join(targets(sized, weights, copies, share), "key")
    within = Window.partitionBy("key", "piece").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = sized.join(pieces, ["key", "piece"]).withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size"))
    limit = F.floor("target")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), limit - (F.col("start") + e * F.col("source_size"))))
                 for e in range(copies)), F.lit(0))
    return out.withColumn("taken", taken.cast("long")).drop("key", "piece", "place", "before")


def mixed(docs: DataFrame, copies: int = MOST_COPIES, **how) -> DataFrame:
    """The mix itself: ``docs`` once for every copy that is taken, with ``copy`` and
    ``finish``, range-sorted by finish time.

    The copy that time one falls into is taken if at least half of it is served by then,
    so documents stay whole.  Documents of no words come once if their place is served.
    """
    out = served(docs.drop("copy", "finish"), copies=copies, **how).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    begun = F.col("start") + F.col("copy") * F.col("source_size")
    half = 2 * (F.col("target") - begun) >= F.col("size")
    out = out.where(half & ((F.col("size") > 0) | (F.col("copy") == 0)))
    finish = F.when(F.col("target") > 0, (begun + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    out = out.withColumn("finish", finish)
    return out.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


#: The same in DuckDB SQL over a table ``documents``.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
      FROM d GROUP BY source),
c AS (SELECT *, (3 * source_size)::DOUBLE AS cap, coalesce('=' || source, '') AS key FROM s),
f AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, key
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
               / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM c),
t AS (SELECT source, source_size, least(cap, coalesce((max(CASE WHEN level <= cap / weight THEN level END) OVER ()) * weight,
             cap)) AS target FROM f),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source
             ORDER BY d.place, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size))
        + greatest(0, least(size, floor(target) - start - 2 * source_size)))::BIGINT AS taken FROM o
"""
