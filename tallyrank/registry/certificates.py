"""Fitted models held against the rows they were fitted on, and scores against each other."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyrank.contract import RISK_CUTS, SEED
from tallyrank.functions.risk import hard_label, risk_band
from tallyrank.operators import certificates as ce, isolation
from tallyrank.plans import training as tr
from tallyrank.registry import models
from tallyrank.registry.base import query
from tallyrank.registry.sql import hash32, with_views
from tallyrank.session import materialize
from tallyrank.streaming import flows

#: A slope counts as none below this share of what single rows pull.
SLOPE = 1e-3
CLOSE = 1e-6
TREES = 20
PENALTIES = ("l1", "l2", "elasticnet", "none")

_TERMS = "SELECT unnest(range(-1, (SELECT max(len(x)) FROM emb))) AS feature"
_PARTS = f"""
  , hashed AS (SELECT *, {hash32(SEED, "vec_id")} AS h, {hash32(SEED + 1, "vec_id")} AS g FROM emb),
  halves AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY h, vec_id) <=
      floor(count(*) OVER (PARTITION BY class) * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS test FROM hashed),
  train AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY g, vec_id) AS rk,
      count(*) OVER (PARTITION BY class) AS n FROM halves WHERE NOT test)"""


def _still(residuals):
    return (F.col("residual") <= SLOPE * F.greatest("scale", F.lit(CLOSE))).alias("stationary")


@query("penalty_certificates", with_views("emb", f"""
  SELECT penalty, CAST(feature AS INTEGER) AS feature, true AS stationary
  FROM ({_TERMS}), (SELECT unnest(['l1', 'l2', 'elasticnet', 'none']) AS penalty)"""))
def penalty_certificates(spark, root):
    """Whether each weight of the logistic fits leaves no slope of loss and penalty, for the four penalties."""
    run = models._run(spark, root)
    out = None
    for penalty in PENALTIES:
        model = run.logistic_with(penalty)
        strength, mix = tr.penalty_of(run.balanced_rows, replace(run.settings, penalty=penalty))
        found = ce.logistic_residuals(run.balanced, list(model.coefficients), model.intercept, strength, mix, weight="weight")
        one = found.select(F.lit(penalty).alias("penalty"), "feature", _still(found))
        out = one if out is None else out.unionByName(one)
    return out


@query("stacking_certificate", "SELECT CAST(unnest(range(-1, 4)) AS INTEGER) AS feature, true AS stationary")
def stacking_certificate(spark, root):
    """The same for the model on the out-of-fold scores of the base models."""
    run = models._run(spark, root)
    scores = run.out_of_fold.withColumn("x", F.array(*tr.BASES))
    strength, mix = tr.penalty_of(scores.count(), run.settings)
    meta = run.ensemble.meta
    found = ce.logistic_residuals(scores, list(meta.coefficients), meta.intercept, strength, mix)
    return found.select("feature", _still(found))


@query("forest_recount", f"""SELECT CAST(unnest(range({TREES})) AS INTEGER) AS tree,
  true AS counts, true AS impurities, true AS gains""")
def forest_recount(spark, root):
    """By tree: whether all nodes hold the counts, impurities and gains that their rows give."""
    run = models._run(spark, root)
    model = run.forest_without_bags(TREES)
    path = tr.save_path(spark, "forest-recount")
    model.write().save(path)
    rows = model.setLeafCol("leaf").transform(run.balanced).withColumn("leaf", vector_to_array("leaf"))
    found = ce.forest_recount(ce.stored_nodes(spark, path), rows, weight="weight")
    return found.groupBy("tree").agg(
        (F.max(F.greatest("stats_gap", "rows_gap")) < CLOSE).alias("counts"),
        (F.max("impurity_gap") < CLOSE).alias("impurities"), (F.max("gain_gap") < CLOSE).alias("gains"))


@query("forest_votes", with_views("emb", "SELECT vec_id AS id, true AS equal FROM emb"))
def forest_votes(spark, root):
    """Every row scored by the stored forest's leaves, beside the forest's own probability."""
    run = models._run(spark, root)
    path = tr.save_path(spark, "forest-votes")
    run.forest.save(spark, path)
    rows = run.scaler.apply(run.data).select("id", "x")
    rows = rows.select("id", run.forest.leaves().alias("leaf"), run.forest.probability().alias("own"))
    found = ce.forest_votes(ce.stored_nodes(spark, path), rows.select("id", "leaf"))
    return rows.join(found, "id", "left").select("id", F.coalesce(F.abs(F.col("own") - F.col("p")) < CLOSE, F.lit(False)).alias("equal"))


@query("importance_certificate", with_views("emb", f"SELECT CAST(feature AS INTEGER) AS feature, true AS equal FROM ({_TERMS}) WHERE feature >= 0"))
def importance_certificate(spark, root):
    """Importances of the forest added up from its stored nodes, beside those it states."""
    run = models._run(spark, root)
    path = tr.save_path(spark, "forest-importance")
    run.forest.save(spark, path)
    stated = [(i, float(v)) for i, v in enumerate(run.forest.featureImportances.toArray())]
    stated = spark.createDataFrame(stated, "feature int, stated double")
    found = stated.join(ce.forest_importances(ce.stored_nodes(spark, path)), "feature", "left")
    return found.select("feature", (F.abs(F.col("stated") - F.coalesce("value", F.lit(0.0))) < CLOSE).alias("equal"))


@query("isolation_recount", f"""SELECT CAST(unnest(range({isolation.TREES})) AS INTEGER) AS tree, true AS counts, true AS rooted""")
def isolation_recount(spark, root):
    """By tree: whether every node holds as many rows of the tree's sample as it says, and the root all of them."""
    run = models._run(spark, root)
    s, n = run.settings, run.train.count()
    size = min(s.isolation_sample, n)
    nodes = ce.node_table(spark, run.isolated)
    sample = isolation.tree_samples(run.train, n, s.isolation_trees, size, s.seed)
    found = ce.isolation_recount(materialize(sample.select("tree", "x"), "isolation-sample"), nodes)
    return found.groupBy("tree").agg(
        F.bool_and(F.col("size") == F.col("found")).alias("counts"),
        F.max(F.when(F.col("node") == 0, F.col("size") == size)).alias("rooted"))


@query("isolation_rescored", with_views("emb", "SELECT vec_id AS id, true AS equal, true AS in_range, true AS labelled FROM emb"))
def isolation_rescored(spark, root):
    """Every row's anomaly score beside the one found by walking the stored trees in joins."""
    run = models._run(spark, root)
    forest, scaler = run.stored_base("isolation_forest")
    rows = scaler.apply(run.data).select("id", "x")
    again = ce.isolation_recomputed(rows, ce.node_table(spark, forest), forest.sample).withColumnRenamed("raw_score", "again")
    own = forest.score(rows).select("id", "raw_score", isolation.anomaly_label(F.col("raw_score"), forest.offset).alias("label"))
    below = F.col("again") < F.lit(forest.offset)
    near = F.abs(F.col("again") - F.lit(forest.offset)) < 1e-9  # the row that sets the offset may fall on either side
    return own.join(again, "id").select(
        "id", (F.abs(F.col("raw_score") - F.col("again")) < 1e-9).alias("equal"), F.col("again").between(-1.0, 0.0).alias("in_range"),
        (near | (below == (F.col("label") == -1))).alias("labelled"))


@query("oof_folds", with_views("emb", f"""{_PARTS}
  SELECT vec_id AS id, class, CAST(list_sum([CASE WHEN rk > floor(n * CAST(i / CAST({tr.FOLDS} AS DOUBLE) AS DOUBLE) + CAST(0.5 AS DOUBLE))
      THEN 1 ELSE 0 END for i in range(1, {tr.FOLDS})]) AS INTEGER) AS fold, true AS scored FROM train"""))
def oof_folds(spark, root):
    """Each train row once, with the fold it was held out of and whether all base scores lie in [0, 1]."""
    out = models._run(spark, root).out_of_fold
    good = [F.coalesce(F.col(b).between(0.0, 1.0), F.lit(False)) for b in tr.BASES]
    return out.select("id", "class", "fold", (good[0] & good[1] & good[2] & good[3]).alias("scored"))


@query("training_sizes", with_views("emb", f"""{_PARTS}
  , per AS (SELECT class, count(*) FILTER (NOT test) AS kept, count(*) FILTER (test) AS held FROM halves GROUP BY class)
  SELECT model, CAST(sum(kept) AS BIGINT) AS train_records, CAST(sum(held) AS BIGINT) AS test_records,
    CAST(max(kept) * count(*) AS BIGINT) AS balanced_records,
    CAST((SELECT max(len(x)) FROM emb) AS INTEGER) AS features, true AS areas
  FROM per, (SELECT unnest([{", ".join(f"'{m}'" for m in models.ALL)}]) AS model) GROUP BY model"""))
def training_sizes(spark, root):
    """The training report's sizes, and whether its areas lie in [0, 1]."""
    report = models.training_report(spark, root)
    areas = F.col("train_auc").between(0.0, 1.0) & F.col("test_auc").between(0.0, 1.0)
    return report.select("model", "train_records", "test_records", "balanced_records", "features", areas.alias("areas"))


@query("history_falls", "SELECT unnest(['logistic_regression', 'xgboost']) AS model, true AS numbered, true AS falls")
def history_falls(spark, root):
    """By model: whether the loss is told of every iteration and the last one kept is no higher than the first."""
    history = models.training_history(spark, root)
    return history.groupBy("model").agg(
        (F.max("iteration") + 1 == F.countDistinct("iteration")).alias("numbered"),
        (F.min("loss") <= F.min_by("loss", "iteration")).alias("falls"))


@query("scores_agree", with_views("emb", """
  SELECT vec_id AS id, class, true AS in_range, true AS banded, true AS labelled, true AS single, true AS streamed FROM emb"""))
def scores_agree(spark, root):
    """Every row scored in four ways: the ensemble, its bands and labels, each stored model alone, and a stream."""
    run = models._run(spark, root)
    scored, alone = run.all_scores, run.single_scores
    stream = models.stream_score(spark, root).withColumnRenamed("p", "streamed")
    p = F.col("stacking_ensemble")
    low, middle, high = RISK_CUTS
    names = F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"), F.lit("CRITICAL"))
    reached = sum(((p >= c).cast("int") for c in (low, middle, high)), F.lit(0))
    ranges = [F.coalesce(F.col(b).between(0.0, 1.0), F.lit(False)) for b in (*tr.BASES, "stacking_ensemble")]
    wide = alone.groupBy("id").pivot("model", tr.BASES).agg(F.first("p"))
    wide = wide.select("id", *[F.col(b).alias(f"alone_{b}") for b in tr.BASES])
    near = [F.abs(F.col(b) - F.col(f"alone_{b}")) < 1e-9 for b in tr.BASES]
    return scored.join(wide, "id").join(stream, "id").select(
        "id", "class", (ranges[0] & ranges[1] & ranges[2] & ranges[3] & ranges[4]).alias("in_range"),
        (risk_band("stacking_ensemble") == F.get(names, reached)).alias("banded"),
        (hard_label("stacking_ensemble") == (p > 0.5).cast("int")).alias("labelled"),
        (near[0] & near[1] & near[2] & near[3]).alias("single"), (F.abs(F.col("streamed") - p) < 1e-5).alias("streamed"))
