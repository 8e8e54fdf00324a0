"""Confusion counts, curves, areas and threshold search per model.

Input is the long score table ``(model, y, p)``.  Everything but the curves is
an aggregate with map-side combine.  The curves work on one row per distinct
score: that table is written once to the shared folder, since its running totals
read it twice, and the scores themselves are read and computed only once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyrank.functions.numeric import ratio
from tallyrank.operators.ordered import bucket_of, prefix_sums, range_cuts
from tallyrank.session import materialize

CONFUSION = ["true_negatives", "false_positives", "false_negatives", "true_positives"]


def confusion(scored: DataFrame, cut: float = 0.5) -> DataFrame:
    """The four counts per model, label 1 where ``p > cut``."""
    hit = F.col("p") > F.lit(cut)
    positive = F.col("y") == 1

    def count(test: Column) -> Column:
        return F.sum(test.cast("bigint"))

    return scored.groupBy("model").agg(
        count(~positive & ~hit).alias("true_negatives"),
        count(~positive & hit).alias("false_positives"),
        count(positive & ~hit).alias("false_negatives"),
        count(positive & hit).alias("true_positives"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity and error rates, 0 if undefined."""
    tn, fp, fn, tp = [F.col(c) for c in CONFUSION]
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "specificity": ratio(tn, tn + fp),
            "false_positive_rate": ratio(fp, fp + tn),
            "false_negative_rate": ratio(fn, fn + tp),
        }
    )


def class_report(confusion_df: DataFrame) -> DataFrame:
    """(model, class, precision, recall, f1, support): each class held as the positive one."""
    tp, fp, fn, tn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))
    sides = F.array(
        F.struct(F.lit(0).alias("class"), tn.alias("hit"), fn.alias("wrong"), fp.alias("lost")),
        F.struct(F.lit(1).alias("class"), tp.alias("hit"), fp.alias("wrong"), fn.alias("lost")))
    rows = confusion_df.select("model", F.inline(sides))
    hit = F.col("hit").cast("double")
    return rows.select(
        "model", "class", ratio(hit, F.col("hit") + F.col("wrong")).alias("precision"), ratio(hit, F.col("hit") + F.col("lost")).alias("recall"),
        ratio(2 * hit, 2 * F.col("hit") + F.col("wrong") + F.col("lost")).alias("f1"), (F.col("hit") + F.col("lost")).alias("support"))


def positive_class_report(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = [F.col(c) for c in CONFUSION]
    return counts.select(
        "model",
        ratio(tp, tp + fn).alias("detection_rate"),
        ratio(fp, fp + tn).alias("false_alarm_rate"),
        ratio(tp, tp + fp).alias("positive_precision"),
        tp.alias("detected"),
        fn.alias("missed"),
        fp.alias("false_alarms"),
        (tp + fn).alias("total_positives"),
    )


def score_counts(scored: DataFrame) -> DataFrame:
    """One row per model and distinct score: positives and negatives."""
    return scored.groupBy("model", "p").agg(
        F.sum((F.col("y") == 1).cast("bigint")).alias("pos"),
        F.sum((F.col("y") != 1).cast("bigint")).alias("neg"),
    )


def counted(scored: DataFrame) -> DataFrame:
    """The score counts, stored."""
    return materialize(score_counts(scored), "score-counts")


def confusion_of_counts(counts: DataFrame, cut: float = 0.5) -> DataFrame:
    """As ``confusion``, from one row per distinct score."""
    hit = F.col("p") > F.lit(cut)

    def total(name: str, test: Column) -> Column:
        return F.sum(F.when(test, F.col(name)).otherwise(F.lit(0)))

    return counts.groupBy("model").agg(
        total("neg", ~hit).alias("true_negatives"),
        total("neg", hit).alias("false_positives"),
        total("pos", ~hit).alias("false_negatives"),
        total("pos", hit).alias("true_positives"),
    )


def score_bucket(counts: DataFrame, decimals: int | None) -> Column:
    """Coarse bucket of ``p``.

    Scores kept to ``decimals`` places have at most ``10^decimals + 1`` distinct
    values, so a fixed grid bounds every bucket.  Free scores get cut points
    from the data.
    """
    if decimals is not None:
        return F.floor(F.col("p") * F.lit(float(10 ** (decimals // 2)))).cast("int")
    return bucket_of(F.col("p"), range_cuts(counts, "p"))


def running(counts: DataFrame, decimals: int | None = None, descending: bool = True) -> DataFrame:
    """Running totals over stored score counts."""
    rows = counts.withColumn("one", F.lit(1).cast("bigint"))
    return prefix_sums(
        rows, "model", "p", ["pos", "neg", "one"], score_bucket(counts, decimals), descending
    )


def cumulated(scored: DataFrame, decimals: int | None = None, descending: bool = True) -> DataFrame:
    """Distinct scores with running positives and negatives."""
    return running(counted(scored), decimals, descending)


def roc_auc(scored: DataFrame, decimals: int | None = None) -> DataFrame:
    """Exact area: pairs won, ties as half; null when only one class occurs."""
    return area_of_counts(counted(scored), decimals)


def area_of_counts(counts: DataFrame, decimals: int | None = None) -> DataFrame:
    c = running(counts, decimals, descending=False)
    below = F.col("cum_neg") - F.col("neg")
    won = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / F.lit(2.0)))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return (
        c.groupBy("model")
        .agg(won.alias("won"), pairs.alias("pairs"))
        .select("model", F.when(F.col("pairs") > 0, F.col("won") / F.col("pairs")).alias("roc_auc"))
    )


def _start(points: DataFrame, **values) -> DataFrame:
    start = points.select("model").distinct()
    for name, value in values.items():
        start = start.withColumn(name, value)
    return start


def roc_curve(scored: DataFrame, decimals: int | None = None) -> DataFrame:
    """(model, threshold, fpr, tpr), one point per distinct score and the origin."""
    points = cumulated(scored, decimals).select(
        "model",
        F.col("p").alias("threshold"),
        ratio("cum_neg", "all_neg").alias("fpr"),
        ratio("cum_pos", "all_pos").alias("tpr"),
    )
    origin = _start(
        points, threshold=F.lit(float("inf")), fpr=F.lit(0.0), tpr=F.lit(0.0)
    )
    return points.unionByName(origin)


def pr_points(scored: DataFrame, decimals: int | None = None) -> DataFrame:
    """Precision and recall at every distinct score, without the closing point."""
    return cumulated(scored, decimals).select(
        "model",
        F.col("p").alias("threshold"),
        ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio("cum_pos", "all_pos").alias("recall"),
    )


def pr_curve(scored: DataFrame, decimals: int | None = None) -> DataFrame:
    """Precision-recall points with the closing point (recall 0, precision 1)."""
    points = pr_points(scored, decimals)
    end = _start(
        points,
        threshold=F.lit(None).cast("double"),
        precision=F.lit(1.0),
        recall=F.lit(0.0),
    )
    return points.unionByName(end)


def pr_auc(scored: DataFrame, decimals: int | None = None) -> DataFrame:
    """Trapezoid area under the precision-recall points.

    The neighbour of a point is rebuilt from its own counts (running sum less
    the row itself), so no second ordering is needed.  Before the first score
    stands the closing point.
    """
    c = cumulated(scored, decimals)
    before_pos = F.col("cum_pos") - F.col("pos")
    before_all = before_pos + F.col("cum_neg") - F.col("neg")
    precision = ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg"))
    previous = F.when(before_all == 0, F.lit(1.0)).otherwise(ratio(before_pos, before_all))
    width = ratio("pos", "all_pos")
    return c.groupBy("model").agg(
        F.sum(width * (precision + previous) / F.lit(2.0)).alias("pr_auc")
    )


def evaluate(scored: DataFrame, cut: float = 0.5, decimals: int | None = None) -> DataFrame:
    """Five headline metrics per model, all from one pass over the scores."""
    counts = counted(scored)
    rates = with_rates(confusion_of_counts(counts, cut))
    return rates.join(area_of_counts(counts, decimals), "model").select(
        "model", "accuracy", "precision", "recall", "f1", "roc_auc"
    )


def compare(metrics: DataFrame) -> DataFrame:
    """Models ranked by area, name as tie-break.  One row per model, so small."""
    order = W.orderBy(F.desc("roc_auc"), F.asc("model"))
    return metrics.withColumn("rank", F.row_number().over(order))


def best(metrics: DataFrame) -> DataFrame:
    top = F.max(F.struct(F.col("roc_auc"), F.col("model"))).alias("top")
    # Equal areas: the ranking takes the first name, so compare on it negated.
    ranked = metrics.groupBy("roc_auc").agg(F.min("model").alias("model"))
    return ranked.agg(top).select("top.model", "top.roc_auc")


# The search grid has 100 evenly spaced cuts from 0 to 1.
GRID_STEPS = 99


def grid_index(p: Column) -> Column:
    """Largest i with ``p >= i / 99``; -1 below the grid.

    The rounded product can be off by one at a cut, so its neighbours are tried.
    """
    step = F.lit(1.0 / GRID_STEPS)
    guess = F.floor(p * F.lit(float(GRID_STEPS))).cast("int")

    def cut(i: Column) -> Column:
        return F.when(i >= GRID_STEPS, F.lit(1.0)).otherwise(i.cast("double") * step)

    at = F.when((guess < GRID_STEPS) & (p >= cut(guess + 1)), guess + 1).when(
        p < cut(guess), guess - 1
    ).otherwise(guess)
    return F.least(at, F.lit(GRID_STEPS))


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 at each grid cut with label 1 where ``p >= cut``.

    Rows shrink to at most 100 per model before anything is ordered.
    """
    cells = scored.groupBy("model", grid_index(F.col("p")).alias("i")).agg(
        F.sum((F.col("y") == 1).cast("bigint")).alias("pos"),
        F.sum((F.col("y") != 1).cast("bigint")).alias("neg"),
    )
    models = cells.groupBy("model").agg(F.sum("pos").alias("all_pos"))
    grid = models.select(
        "model", "all_pos", F.explode(F.sequence(F.lit(0), F.lit(GRID_STEPS))).alias("i")
    )
    down = W.partitionBy("model").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    swept = grid.join(cells, ["model", "i"], "left").select(
        "model",
        "i",
        "all_pos",
        F.coalesce(F.sum("pos").over(down), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("neg").over(down), F.lit(0)).alias("fp"),
    )
    fn = F.col("all_pos") - F.col("tp")
    return swept.select(
        "model",
        F.when(F.col("i") == GRID_STEPS, F.lit(1.0))
        .otherwise(F.col("i") * F.lit(1.0 / GRID_STEPS))
        .alias("threshold"),
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio("tp", "all_pos").alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn).alias("f1"),
    )


def optimal_threshold(scored: DataFrame, metric: str = "f1") -> DataFrame:
    """First grid cut with the largest metric; 0.5 when none is above 0."""
    if metric not in ("f1", "precision", "recall"):
        raise ValueError(f"unsupported metric: {metric}")
    pick = F.max(F.struct(F.col(metric).alias("score"), (-F.col("threshold")).alias("t"))).alias("b")
    return (
        threshold_sweep(scored)
        .groupBy("model")
        .agg(pick)
        .select(
            "model",
            F.lit(metric).alias("metric"),
            F.when(F.col("b.score") > 0, -F.col("b.t")).otherwise(F.lit(0.5)).alias("threshold"),
            F.col("b.score").alias("score"),
        )
    )


def chart_curves(scored: DataFrame, decimals: int | None = None, most: int | None = None) -> DataFrame:
    """(model, threshold, fpr, tpr, precision) at every distinct score.

    ``most`` thins each curve to at most so many points; without it curves are whole.
    """
    c = cumulated(scored, decimals)
    if most is not None:
        c = thin(c, "cum_one", "all_one", most)
    return c.select(
        "model",
        F.col("p").alias("threshold"),
        ratio("cum_neg", "all_neg").alias("fpr"),
        ratio("cum_pos", "all_pos").alias("tpr"),
        ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
    )


def thin(points: DataFrame, rank: str, total: str, most: int) -> DataFrame:
    """Keep at most ``most`` points of each curve, spread over its ranks."""
    slot = F.floor((F.col(rank) - 1) * (most - 1) / F.col(total))
    previous = F.floor((F.col(rank) - 2) * (most - 1) / F.col(total))
    last = F.col(rank) == F.col(total)
    starts = (F.col(rank) == 1) | (slot != previous)
    return points.filter(F.when(F.col(total) <= most, F.lit(True)).otherwise(starts | last))
