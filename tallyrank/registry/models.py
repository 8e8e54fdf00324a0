"""Balancing, model fitting, ensembles and what is read off fitted models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyrank.contract import SEED, TX_KEY
from tallyrank.functions.numeric import rounded
from tallyrank.functions.vectors import with_names
from tallyrank.operators import balancing, boosting, evaluation as ev, factors, isolation, neighbours
from tallyrank.operators.preferences import user_product_affinity
from tallyrank.plans import training as tr
from tallyrank.registry.base import query
from tallyrank.registry.sql import R, TX_KEY_SQL, hash32, with_views
from tallyrank.session import scratch_path
from tallyrank.sources import tables
from tallyrank.sources.store import ModelRegistry
from tallyrank.streaming import flows

ALL = [*tr.BASES, "stacking_ensemble"]
HEADLINE = ["accuracy", "precision", "recall", "f1", "roc_auc"]
K = 5
FEATURES = [f"e{i}" for i in range(64)]


def _rows(spark, root):
    return with_names(tables.vectors(spark, root).withColumnRenamed("vec_id", "id"), FEATURES)


def _run(spark, root) -> tr.TrainingRun:
    return tr.shared_run(_rows(spark, root), root)


# Balancing.

_MINORITY = f"""
  , minority AS (SELECT vec_id AS id, x FROM emb WHERE class = 1),
  near AS (SELECT a.id, b.id AS neighbour, b.x AS nx, list_distance(a.x, b.x) AS distance,
      row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rk
    FROM minority a JOIN minority b ON a.id <> b.id),
  sizes AS (SELECT count(*) FILTER (class = 1) AS m, count(*) FILTER (class = 0) AS mj FROM emb)"""
_HARD = f"""
  , allnear AS (SELECT a.id, e.class, row_number() OVER (PARTITION BY a.id
      ORDER BY list_distance(a.x, e.x), e.vec_id) AS rk
    FROM minority a JOIN emb e ON a.id <> e.vec_id),
  shares AS (SELECT id, sum(1 - class) / CAST({K} AS DOUBLE) AS share FROM allnear
    WHERE rk <= {K} GROUP BY id)"""
_MAKE = f"""
  , copies AS (SELECT id, x, unnest(range(1, n + 1)) AS copy FROM parents),
  drawn AS (SELECT id AS parent, copy, x, 1 + {hash32(f"{SEED}-pick", "id", "copy")} % {K} AS pick,
      {hash32(f"{SEED}-share", "id", "copy")} / CAST(4294967296 AS DOUBLE) AS share FROM copies)
  SELECT parent, copy, neighbour, {R("share")} AS share,
    {R("x[1] + share * (nx[1] - x[1])")} AS first_value,
    {R("x[64] + share * (nx[64] - x[64])")} AS last_value
  FROM drawn JOIN near ON near.id = parent AND rk = pick"""


def _ends(made):
    return made.select(
        "parent", "copy", "neighbour", rounded("share").alias("share"),
        rounded(F.get("x", F.lit(0))).alias("first_value"),
        rounded(F.element_at("x", -1)).alias("last_value"),
    )


@query("knn_minority", with_views("emb", f"""{_MINORITY}
  SELECT id, neighbour, CAST(rk AS INTEGER) AS "rank", {R("distance")} AS distance
  FROM near WHERE rk <= {K}"""))
def knn_minority(spark, root):
    minority = _rows(spark, root).filter("class = 1")
    found = neighbours.nearest_neighbours(minority, minority, K)
    return found.select("id", "neighbour", "rank", rounded("distance").alias("distance"))


@query("smote", with_views("emb", f"""{_MINORITY}
  , parents AS (SELECT id, x, (mj - m) // m + CASE WHEN row_number() OVER
      (ORDER BY {hash32(f"{SEED}-extra", "id")}, id) <= (mj - m) % m THEN 1 ELSE 0 END AS n
    FROM minority, sizes){_MAKE}"""))
def smote(spark, root):
    return _ends(balancing.smote(_rows(spark, root), k=K))


@query("adasyn", with_views("emb", f"""{_MINORITY}{_HARD}
  , parents AS (SELECT id, x, CAST(round_even(share / (SELECT sum(share) FROM shares)
      * (mj - m), 0) AS BIGINT) AS n FROM minority JOIN shares USING (id), sizes){_MAKE}"""))
def adasyn(spark, root):
    return _ends(balancing.adasyn(_rows(spark, root), k=K))


@query("balance_report", with_views("emb", """
  SELECT 'before' AS stage, class AS label, count(*) AS records FROM emb GROUP BY class
  UNION ALL SELECT 'after', l, (SELECT max(n) FROM (SELECT count(*) AS n FROM emb GROUP BY class))
  FROM (SELECT unnest([0, 1]) AS l)"""))
def balance_report(spark, root):
    rows = _rows(spark, root)
    return balancing.balance_report(rows, balancing.balance(rows))


# Anomaly scores: the rules around the score, on a stored score column.

_RAW = "-isolation_forest"


def _stored(spark, root):
    wide = tables.wide_scores(spark, root)
    return wide.select(*TX_KEY, (-F.col("isolation_forest")).alias("raw"))


@query("iforest_labels", with_views("wide", f"""
  SELECT {TX_KEY_SQL}, {R("raw - o")} AS decision, CASE WHEN raw - o < 0 THEN -1 ELSE 1 END AS label
  FROM (SELECT *, {_RAW} AS raw FROM wide),
    (SELECT quantile_cont({_RAW}, {isolation.CONTAMINATION}) AS o FROM wide)"""))
def iforest_labels(spark, root):
    stored = _stored(spark, root)
    offset = isolation.score_offset(stored, "raw")
    return stored.select(
        *TX_KEY,
        rounded(F.col("raw") - F.lit(offset)).alias("decision"),
        isolation.anomaly_label(F.col("raw"), offset).alias("label"),
    )


@query("iforest_bounds", with_views("wide", """
  SELECT min(isolation_forest) AS score_min, max(isolation_forest) AS score_max FROM wide"""))
def iforest_bounds(spark, root):
    return isolation.score_bounds(_stored(spark, root), "raw")


@query("iforest_probability", with_views("wide", f"""
  SELECT {TX_KEY_SQL}, {R("greatest(0, least(1, (isolation_forest - lo) / (hi - lo)))")} AS p
  FROM wide, (SELECT min(isolation_forest) AS lo, max(isolation_forest) AS hi FROM wide)"""))
def iforest_probability(spark, root):
    stored = _stored(spark, root)
    low, high = isolation.score_bounds(stored, "raw").first()
    p = isolation.normalised_score(F.col("raw"), low, high)
    return stored.select(*TX_KEY, rounded(p).alias("p"))


@query("train_isolation_forest")
def train_isolation_forest(spark, root):
    """The node table of a forest grown on the unbalanced train rows."""
    nodes, _ = isolation.grow_forest(_run(spark, root).train)
    return nodes


@query("iforest_scores")
def iforest_scores(spark, root):
    """Every row of the table, scored by the stored forest."""
    run = _run(spark, root)
    forest, scaler = run.stored_base("isolation_forest")
    scored = forest.score(scaler.apply(run.data))
    return scored.select(
        "id", rounded("raw_score").alias("raw_score"),
        rounded(forest.probability()).alias("p"),
        isolation.anomaly_label(F.col("raw_score"), forest.offset).alias("label"),
    )


# Fitted models.


@query("train_logistic")
def train_logistic(spark, root):
    model = _run(spark, root).logistic
    return tr.vector_rows(spark, "logistic_regression", "coefficient", model.coefficients)


@query("train_logistic_l1")
def train_logistic_l1(spark, root):
    """Coefficients under each of the four penalties."""
    out = None
    for penalty in ("l1", "l2", "elasticnet", "none"):
        model = _run(spark, root).logistic_with(penalty)
        one = tr.vector_rows(spark, penalty, "coefficient", model.coefficients)
        out = one if out is None else out.unionByName(one)
    return out


@query("train_random_forest")
def train_random_forest(spark, root):
    model = _run(spark, root).forest
    return tr.vector_rows(spark, "random_forest", "impurity", model.featureImportances.toArray())


@query("train_gbt")
def train_gbt(spark, root):
    """Loss of every boosting round tried, on train and held-out rows, and whether its trees are kept."""
    model = _run(spark, root).boosted
    rows = [(r, float(train), held, r <= model.rounds) for r, train, held in model.history]
    return spark.createDataFrame(rows, "round int, train_loss double, held_out_loss double, kept boolean")


BINS = 16
_CUT = f"lo + (hi - lo) * i / {BINS}"


@query("boosted_split_gains", with_views("emb", f"""
  , cells AS (SELECT unnest(range(64)) AS feature, unnest(x) AS v, class FROM emb),
  bounds AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM cells GROUP BY feature),
  cut AS (SELECT feature, len(list_filter(range(1, {BINS}), lambda i: v > {_CUT})) AS bin, class
    FROM cells JOIN bounds USING (feature)),
  sums AS (SELECT feature, bin, sum(0.5 - class) AS g, sum(0.25) AS h FROM cut GROUP BY feature, bin),
  run AS (SELECT *, sum(g) OVER below AS gl, sum(h) OVER below AS hl,
      sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht
    FROM sums WINDOW below AS (PARTITION BY feature ORDER BY bin))
  SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, {R("g")} AS gradient, {R("h")} AS curvature,
    {R("(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) / 2")} AS gain
  FROM run WHERE hl >= 1 AND ht - hl >= 1"""))
def boosted_split_gains(spark, root):
    """Histograms of the first boosting round, and the gain of a cut after every bin."""
    rows = _rows(spark, root)
    cells = rows.select(F.posexplode("x").alias("feature", "v"))
    ends = cells.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("feature").collect()
    edges = boosting.equal_edges([r["lo"] for r in ends], [r["hi"] for r in ends], BINS)
    s = boosting.BoostSettings(row_share=1.0, column_share=1.0)
    g, h = boosting.Booster(rows, s, edges).root_sums()
    gains = boosting.split_gains(g, h, s)
    met = [(int(f), int(b), *map(float, (g[f, b], h[f, b], gains[f, b]))) for f, b in zip(*((h > 0) & (gains > -math.inf)).nonzero())]
    found = spark.createDataFrame(met, "feature int, bin int, gradient double, curvature double, gain double")
    return found.withColumns({c: rounded(c) for c in ("gradient", "curvature", "gain")})


@query("feature_importance")
def feature_importance(spark, root):
    boosted = tr.boosted_importance(spark, _run(spark, root).boosted)
    return (
        train_logistic(spark, root)
        .unionByName(train_random_forest(spark, root))
        .unionByName(boosted.withColumn("model", F.lit("xgboost")))
    )


@query("top_features", with_views("emb", f"""
  SELECT feature, {R("value")} AS value FROM (
    SELECT CAST(i AS INTEGER) AS feature, avg(v) FILTER (class = 1) - avg(v) FILTER (class = 0) AS value
    FROM (SELECT unnest(range(64)) AS i, unnest(x) AS v, class FROM emb) GROUP BY i)
  ORDER BY abs(value) DESC, feature LIMIT 20"""))
def top_features(spark, root):
    """Features ranked by the size of the mean difference between the classes."""
    cells = _rows(spark, root).select("class", F.posexplode("x").alias("feature", "v"))

    def mean(label: int):
        return F.avg(F.when(F.col("class") == label, F.col("v")))

    gaps = cells.groupBy("feature").agg((mean(1) - mean(0)).alias("value"))
    return tr.top_features(gaps, 20).withColumn("value", rounded("value"))


@query("train_stacking")
def train_stacking(spark, root):
    """Weights and intercept of the model on top of the base scores."""
    ensemble = _run(spark, root).ensemble
    rows = [*ensemble.weights(), ("intercept", float(ensemble.meta.intercept))]
    return spark.createDataFrame(rows, "term string, value double")


@query("ensemble_weights")
def ensemble_weights(spark, root):
    weights = _run(spark, root).ensemble.weights()
    return spark.createDataFrame(weights, "model string, weight double")


@query("oof_scores")
def oof_scores(spark, root):
    out = _run(spark, root).out_of_fold
    return out.select("id", "class", "fold", *[rounded(b).alias(b) for b in tr.BASES])


@query("training_report")
def training_report(spark, root):
    """Areas on train and test rows, with the sizes behind each fit."""
    run = _run(spark, root)
    train = tr.area(run.ensemble.score(run.train), ALL).withColumnRenamed("roc_auc", "train_auc")
    test = tr.area(run.test_scores, ALL).withColumnRenamed("roc_auc", "test_auc")
    sizes = run.rows.agg(
        F.sum((F.col("split") == "train").cast("bigint")).alias("train_records"),
        F.sum((F.col("split") == "test").cast("bigint")).alias("test_records"),
        F.first(F.size("x")).alias("features"),
    ).withColumn("balanced_records", F.lit(run.balanced_rows).cast("bigint"))
    trees = {"random_forest": run.forest.getNumTrees, "xgboost": run.boosted.rounds,
             "isolation_forest": run.settings.isolation_trees}
    pairs = [F.lit(x) for kv in trees.items() for x in kv]
    named = sizes.select(F.struct("*").alias("s")).scalar()
    return train.join(test, "model").withColumn("s", named).select(
        "model", rounded("train_auc").alias("train_auc"), rounded("test_auc").alias("test_auc"), "s.*",
        F.try_element_at(F.create_map(*pairs), F.col("model")).alias("trees"),
    )


@query("training_history")
def training_history(spark, root):
    """Loss by iteration: logistic objective, boosted loss on the held-out rows."""
    run = _run(spark, root)
    loss = run.logistic.summary.objectiveHistory
    rows = [("logistic_regression", i, float(v)) for i, v in enumerate(loss)]
    rows += [("xgboost", r, held) for r, _, held in run.boosted.history]
    return spark.createDataFrame(rows, "model string, iteration int, loss double")


@query("training_summary")
def training_summary(spark, root):
    """Headline metrics of all five models on the test rows, registered with the run and read back."""
    run = _run(spark, root)
    registry = ModelRegistry.at(spark, scratch_path(spark, "models"))
    run.register(registry, ev.compare(ev.evaluate(tr.long_scores(run.test_scores, ALL))).select("model", *HEADLINE), "training")
    return registry.latest().select(
        "model", "kind", "version", "dataset_size", F.size("features").alias("features"), (F.col("train_seconds") > 0).alias("timed"),
        *[rounded(F.col("metrics")[c]).alias(c) for c in HEADLINE])


# Scoring with fitted models.


@query("score_transactions")
def score_transactions(spark, root):
    """Every row of the table, scored by the stored ensemble."""
    scored = _run(spark, root).all_scores
    from tallyrank.functions.risk import hard_label, risk_band

    return scored.select(
        "id", "class", rounded("stacking_ensemble").alias("p"),
        risk_band("stacking_ensemble").alias("band"),
        hard_label("stacking_ensemble").alias("label"),
    )


@query("base_model_scores")
def base_model_scores(spark, root):
    """Every row with the scores of all models, in columns and as one text by name."""
    from tallyrank.operators.scoring import score_map

    out = _run(spark, root).all_scores.select("id", *[rounded(c).alias(c) for c in ALL])
    return out.withColumn("scores", F.to_json(score_map(ALL)))


@query("score_single_model")
def score_single_model(spark, root):
    """Every row of the table scored by each stored base model alone."""
    from tallyrank.functions.risk import hard_label

    return _run(spark, root).single_scores.select("id", "model", rounded("p").alias("p"), hard_label("p").alias("label"))


@query("model_roundtrip", with_views("emb", "SELECT vec_id AS id, class, true AS equal, true AS in_range FROM emb"))
def model_roundtrip(spark, root):
    """Every raw row scored by the fitted ensemble and by the one read back, features taken by their names."""
    run = _run(spark, root)
    before = run.ensemble.score_raw(run.data).select("id", "class", F.col("stacking_ensemble").alias("before"))
    columns = [F.get("x", F.lit(i)).alias(f) for i, f in reversed(list(enumerate(FEATURES)))]
    after = run.stored.score_raw(run.data.select("id", *columns)).select("id", F.col("stacking_ensemble").alias("after"))
    return before.join(after, "id").select(
        "id", "class", (F.abs(F.col("before") - F.col("after")) < 1e-9).alias("equal"),
        F.col("after").between(0.0, 1.0).alias("in_range"))


@query("reload_and_evaluate")
def reload_and_evaluate(spark, root):
    """A stored run evaluated by class on its test rows, found again in the raw table by the stored split."""
    run = _run(spark, root)
    path = tr.save_path(spark, "run")
    run.save(path)
    metrics, report = tr.evaluate_stored(spark, path, _rows(spark, root))
    out = report.join(metrics.select("model", "roc_auc"), "model")
    return out.withColumns({c: rounded(c) for c in ("precision", "recall", "f1", "roc_auc")})


@query("als_scores")
def als_scores(spark, root):
    """Implicit-feedback factors on user and product, scaled into [0, 1]."""
    affinity = user_product_affinity(tables.valid_interactions(spark, root))
    scored = factors.fit_factors(affinity).score(affinity)
    return scored.withColumn("score", rounded("score"))


@query("als_fold_in", with_views("inter", """
  SELECT user_id, count(DISTINCT product_id) AS products, true AS equal FROM inter GROUP BY user_id HAVING sum(w) > 0"""))
def als_fold_in(spark, root):
    """Users solved anew from their own products, beside the factors of the fit: the last step of a fit."""
    affinity = user_product_affinity(tables.valid_interactions(spark, root))
    fitted = factors.fit_factors(affinity)
    again = fitted.fold_in(affinity).withColumnRenamed("u", "again").join(fitted.users, "user_id")
    apart = F.array_max(F.zip_with("again", "u", lambda a, b: F.abs(a - b)))
    counts = affinity.groupBy("user_id").agg(F.count("*").alias("products"))
    return again.join(counts, "user_id").select("user_id", "products", (apart < 1e-3).alias("equal"))


@query("stream_score")
def stream_score(spark, root):
    """Every row of the table arriving as a stream, scored by the stored ensemble."""
    run = _run(spark, root)
    path = tr.save_path(spark, "arriving")
    run.data.write.parquet(path)
    arriving = spark.readStream.schema(run.data.schema).parquet(path)
    stored = flows.score_stream(
        arriving, lambda s: run.stored.score_raw(s).select("id", "stacking_ensemble")
    )
    return stored.select("id", rounded("stacking_ensemble").alias("p"))
