"""Scoring with fixed linear scorers, and everything that evaluates scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrank.contract import (
    LINEAR_SCORERS, META_WEIGHTS, MODEL_NAMES, RISK_CUTS, STRICT_RISK_CUTS, TX_FEATURES, TX_KEY, TX_LABEL,
)
from tallyrank.functions.numeric import rounded
from tallyrank.functions.risk import confidence, hard_label, risk_action, risk_band
from tallyrank.operators import evaluation as ev, scaling, scoring
from tallyrank.registry.base import query
from tallyrank.registry.quality import FEATURES_SQL, _scaled_sql, _spread
from tallyrank.registry.sql import R, TX_KEY_SQL, div, with_views
from tallyrank.session import materialize, scratch_path
from tallyrank.sources import tables
from tallyrank.sources.store import ModelRegistry, model_entries

DECIMALS = 4
ENSEMBLE = "stacking_ensemble"
# Fixed coefficients of the scaled linear score, in feature order, and bias.
SCALED_WEIGHTS = (0.4, 0.9, -0.6, 0.3, 0.7)
SCALED_BIAS = -0.5


def _band_sql(p: str, cuts) -> str:
    a, b, c = cuts
    return (f"CASE WHEN {p} < {a} THEN 'LOW' WHEN {p} < {b} THEN 'MEDIUM' "
            f"WHEN {p} < {c} THEN 'HIGH' ELSE 'CRITICAL' END")


def _ensemble(spark, root):
    return tables.wide_scores(spark, root).select(*TX_KEY, "y", F.col(ENSEMBLE).alias("p"))


_Z = " + ".join(f"CAST({w} AS DOUBLE) * {f}" for w, f in zip(SCALED_WEIGHTS, FEATURES_SQL.split(", ")))
_ONE = "CAST(1 AS DOUBLE)"


@query("logistic_score", with_views("tx", f"""
  SELECT {TX_KEY_SQL}, {R(f"{_ONE} / ({_ONE} + exp(-(CAST({SCALED_BIAS} AS DOUBLE) + {_Z})))")} AS p
  FROM ({_scaled_sql("tx", "tx")})"""))
def logistic_score(spark, root):
    tx = tables.transactions(spark, root)
    scaled = scaling.scale(tx, TX_FEATURES, scaling.scaler_state(tx, TX_FEATURES))
    # Six places on the inputs keep the score repeatable across engines.
    scaled = scaled.withColumns({f: rounded(f) for f in TX_FEATURES})
    p = scoring.linear_score(TX_FEATURES, SCALED_WEIGHTS, SCALED_BIAS)
    return scaled.select(*TX_KEY, rounded(p).alias("p"))


def flagship(spark, root):
    """Load, scale, score, band and evaluate: one row per band and label."""
    tx = tables.transactions(spark, root)
    scaled = scaling.scale(tx, TX_FEATURES, scaling.scaler_state(tx, TX_FEATURES))
    p = scoring.linear_score(TX_FEATURES, SCALED_WEIGHTS, SCALED_BIAS)
    scored = scaled.select(F.col(TX_LABEL).alias("y"), F.round(p, 4).alias("p"))
    # The rows are read once; what follows works on a handful of counts.
    cells = scored.groupBy(risk_band("p").alias("band"), "y", (F.col("p") > 0.5).alias("hit")).agg(F.count("*").alias("n"))
    counts = ev.with_rates(cells.agg(*[
        F.sum(F.when((F.col("y") == y) & (F.col("hit") == hit), F.col("n")).otherwise(0)).alias(name)
        for name, y, hit in (("true_negatives", 0, False), ("false_positives", 0, True),
                             ("false_negatives", 1, False), ("true_positives", 1, True))]))
    m = counts.select(F.struct("accuracy", "precision", "recall", "f1").alias("m"))
    banded = cells.groupBy("band", "y").agg(F.sum("n").alias("records"))
    return banded.withColumn("m", m.scalar()).select(
        "band", "y", "records",
        *[rounded(F.col(f"m.{c}")).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
    )


_FLAG_STATS = ", ".join(
    f"avg({f}) AS m_{n}, {_spread(f)} AS s_{n}" for f, n in zip(FEATURES_SQL.split(", "), TX_FEATURES))
_FLAG_Z = " + ".join(
    f"CAST({w} AS DOUBLE) * (({f} - m_{n}) / s_{n})"
    for w, f, n in zip(SCALED_WEIGHTS, FEATURES_SQL.split(", "), TX_FEATURES))


@query("risk_report", with_views("tx", f"""
  , s AS (SELECT class AS y,
      round({_ONE} / ({_ONE} + exp(-(CAST({SCALED_BIAS} AS DOUBLE) + {_FLAG_Z}))), 4) AS p
    FROM tx, (SELECT {_FLAG_STATS} FROM tx)),
  c AS (SELECT count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p > 0.5) AS fp,
      count(*) FILTER (y = 1 AND p <= 0.5) AS fn, count(*) FILTER (y = 0 AND p <= 0.5) AS tn FROM s)
  SELECT band, y, records, {R(div("tp + tn", "tp + tn + fp + fn"))} AS accuracy,
    {R(div("tp", "tp + fp"))} AS "precision", {R(div("tp", "tp + fn"))} AS recall,
    {R(div("2 * tp", "2 * tp + fp + fn"))} AS f1
  FROM (SELECT {_band_sql("p", RISK_CUTS)} AS band, y, count(*) AS records FROM s GROUP BY 1, 2), c
  """))
def risk_report(spark, root):
    return flagship(spark, root)


@query("risk_band", with_views("wide", f"""
  SELECT {TX_KEY_SQL}, {ENSEMBLE} AS p, {_band_sql(ENSEMBLE, RISK_CUTS)} AS band FROM wide"""))
def risk_band_query(spark, root):
    return _ensemble(spark, root).select(*TX_KEY, "p", risk_band("p").alias("band"))


@query("risk_band_strict", with_views("wide", f"""
  SELECT {TX_KEY_SQL}, {ENSEMBLE} AS p, {_band_sql(ENSEMBLE, STRICT_RISK_CUTS)} AS band FROM wide"""))
def risk_band_strict(spark, root):
    return _ensemble(spark, root).select(*TX_KEY, "p", risk_band("p", STRICT_RISK_CUTS).alias("band"))


@query("risk_action", with_views("wide", f"""
  SELECT {TX_KEY_SQL}, band, CASE band WHEN 'LOW' THEN 'approve' WHEN 'MEDIUM' THEN 'verify'
    WHEN 'HIGH' THEN 'review' ELSE 'block' END AS action
  FROM (SELECT *, {_band_sql(ENSEMBLE, STRICT_RISK_CUTS)} AS band FROM wide)"""))
def risk_action_query(spark, root):
    banded = _ensemble(spark, root).select(*TX_KEY, risk_band("p", STRICT_RISK_CUTS).alias("band"))
    return banded.withColumn("action", risk_action("band"))


@query("hard_label", with_views("wide", f"""
  SELECT {TX_KEY_SQL}, {ENSEMBLE} AS p, CASE WHEN {ENSEMBLE} > 0.5 THEN 1 ELSE 0 END AS label
  FROM wide"""))
def hard_label_query(spark, root):
    return _ensemble(spark, root).select(*TX_KEY, "p", hard_label("p").alias("label"))


@query("confidence", with_views("wide", f"""
  SELECT {TX_KEY_SQL}, {R(f"greatest({ENSEMBLE}, 1 - {ENSEMBLE})")} AS confidence FROM wide"""))
def confidence_query(spark, root):
    return _ensemble(spark, root).select(*TX_KEY, rounded(confidence("p")).alias("confidence"))


@query("batch_summary", with_views("wide", f"""
  SELECT w.supp_key AS batch_id, count(*) AS total_transactions,
    count(*) FILTER ({ENSEMBLE} > 0.5) AS positives_detected,
    {R(div(f"count(*) FILTER ({ENSEMBLE} > 0.5)", "count(*)") + " * 100")} AS positive_rate,
    {R("sum(CAST(line_no AS DOUBLE) / 8)")} AS total_processing_time_ms
  FROM wide w GROUP BY w.supp_key"""))
def batch_summary(spark, root):
    rows = _ensemble(spark, root).withColumn("duration", F.col("line_no").cast("double") / 8)
    out = scoring.batch_summary(rows, "supp_key", "p", "duration")
    return out.withColumns(
        {c: rounded(c) for c in ("positive_rate", "total_processing_time_ms")}
    )


_CHOICE = "CASE model_name " + " ".join(f"WHEN '{n}' THEN {n}" for n in LINEAR_SCORERS) + " END"
_ROUTE = ("CASE supp_key % 6 " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(LINEAR_SCORERS)) + " END")


@query("select_model_score", with_views("wide", f"""
  SELECT {TX_KEY_SQL}, model_name, {R(f"CASE WHEN model_name IS NULL THEN {ENSEMBLE} ELSE {_CHOICE} END")}
    AS score FROM (SELECT *, {_ROUTE} AS model_name FROM wide)"""))
def select_model_score(spark, root):
    """Every sixth supplier names no model and gets the default one."""
    names = list(LINEAR_SCORERS)
    asked = F.get(F.array(*[F.lit(n) for n in names]), (F.col("supp_key") % 6).cast("int"))
    rows = tables.wide_scores(spark, root).withColumn("model_name", asked)
    out = scoring.select_model_score(rows, names)
    return out.select(*TX_KEY, "model_name", rounded("score").alias("score"))


@query("model_contributions", with_views("wide", " UNION ALL ".join(
    f"SELECT '{n}' AS model, {R(f'avg({n})')} AS mean_score, {R(f'abs(avg({n}) * {w})')} AS contribution"
    " FROM wide" for n, w in META_WEIGHTS.items())))
def model_contributions(spark, root):
    out = scoring.model_contributions(tables.wide_scores(spark, root), META_WEIGHTS)
    return out.select("model", *[rounded(c).alias(c) for c in ("mean_score", "contribution")])


_CONFUSION_SQL = ("tn AS true_negatives, fp AS false_positives, fn AS false_negatives, "
                  "tp AS true_positives")


@query("confusion_matrix", with_views("counts", f"SELECT model, {_CONFUSION_SQL} FROM counts"))
def confusion_matrix(spark, root):
    return ev.confusion(tables.scores(spark, root))


_RATES = ["accuracy", "precision", "recall", "f1", "specificity", "false_positive_rate",
          "false_negative_rate"]


def _rounded_sql(names) -> str:
    return ", ".join(f'{R(chr(34) + n + chr(34))} AS "{n}"' for n in names)


@query("classification_metrics", with_views("rates counts", f"""
  SELECT model, {_CONFUSION_SQL}, {_rounded_sql(_RATES)} FROM rates JOIN counts USING (model)"""))
def classification_metrics(spark, root):
    out = ev.with_rates(ev.confusion(tables.scores(spark, root)))
    return out.withColumns({c: rounded(c) for c in _RATES})


@query("roc_auc", with_views("auc", f"SELECT model, {R('roc_auc')} AS roc_auc FROM auc"))
def roc_auc(spark, root):
    return ev.roc_auc(tables.scores(spark, root), DECIMALS).withColumn("roc_auc", rounded("roc_auc"))


@query("roc_curve", with_views("curve", f"""
  SELECT model, p AS threshold, {R(div("cn", "nn"))} AS fpr, {R(div("cp", "np"))} AS tpr FROM curve
  UNION ALL SELECT DISTINCT model, CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  FROM curve"""))
def roc_curve(spark, root):
    out = ev.roc_curve(tables.scores(spark, root), DECIMALS)
    return out.withColumns({c: rounded(c) for c in ("fpr", "tpr")})


@query("pr_curve", with_views("curve", f"""
  SELECT model, p AS threshold, {R(div("cp", "cp + cn"))} AS "precision",
    {R(div("cp", "np"))} AS recall FROM curve
  UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)
  FROM curve"""))
def pr_curve(spark, root):
    out = ev.pr_curve(tables.scores(spark, root), DECIMALS)
    return out.withColumns({c: rounded(c) for c in ("precision", "recall")})


@query("pr_auc", with_views("curve", f"""
  SELECT model, {R('sum((recall - r0) * ("precision" + p0) / 2)')} AS pr_auc FROM (
    SELECT model, recall, "precision", lag(recall, 1, 0) OVER w AS r0,
      lag("precision", 1, 1) OVER w AS p0
    FROM (SELECT model, p, cp / (cp + cn) AS "precision", {div("cp", "np")} AS recall FROM curve)
    WINDOW w AS (PARTITION BY model ORDER BY p DESC)) GROUP BY model"""))
def pr_auc(spark, root):
    return ev.pr_auc(tables.scores(spark, root), DECIMALS).withColumn("pr_auc", rounded("pr_auc"))


_HEADLINE = ["accuracy", "precision", "recall", "f1", "roc_auc"]


@query("evaluate_model", with_views("metrics", f"""
  SELECT model, {_rounded_sql(_HEADLINE)} FROM metrics WHERE model = '{ENSEMBLE}'"""))
def evaluate_model(spark, root):
    one = _ensemble(spark, root).select(F.lit(ENSEMBLE).alias("model"), "y", "p")
    return ev.evaluate(one, decimals=DECIMALS).withColumns({c: rounded(c) for c in _HEADLINE})


@query("evaluate_all", with_views("metrics", f"SELECT model, {_rounded_sql(_HEADLINE)} FROM metrics"))
def evaluate_all(spark, root):
    out = ev.evaluate(tables.scores(spark, root), decimals=DECIMALS)
    return out.withColumns({c: rounded(c) for c in _HEADLINE})


@query("model_registry_latest", with_views("metrics scores", f"""
  SELECT model, CAST(2 AS BIGINT) AS entries, CAST(2 AS BIGINT) AS version,
    (SELECT count(*) FROM scores s WHERE s.model = m.model) AS dataset_size, {_rounded_sql(_HEADLINE)}
  FROM metrics m"""))
def model_registry_latest(spark, root):
    """The newest entry of every model after two runs of evaluation, the second one tried twice."""
    scores = tables.scores(spark, root)
    registry = ModelRegistry.at(spark, scratch_path(spark, "models"))
    rows = scores.groupBy("model").count().agg(F.max("count")).first()[0]
    kinds = {m: m for m in MODEL_NAMES}
    found = materialize(ev.evaluate(scores, decimals=DECIMALS).select("model", *_HEADLINE), "metrics")
    early = found.withColumns({c: F.lit(0.5) for c in _HEADLINE})
    registry.register(model_entries(early, kinds, 0, TX_FEATURES), "early")
    for _ in range(2):
        registry.register(model_entries(found, kinds, rows, TX_FEATURES, settings={"decimals": DECIMALS}), "whole")
    return registry.latest().select(
        "model", "entries", "version", "dataset_size", *[rounded(F.col("metrics")[c]).alias(c) for c in _HEADLINE])


@query("class_report", with_views("counts", " UNION ALL ".join(f"""
  SELECT model, {c} AS class, {R(div(h, f"{h} + {w}"))} AS "precision", {R(div(h, f"{h} + {l}"))} AS recall,
    {R(div(f"2 * {h}", f"2 * {h} + {w} + {l}"))} AS f1, {h} + {l} AS support FROM counts"""
  for c, h, w, l in ((0, "tn", "fn", "fp"), (1, "tp", "fp", "fn")))))
def class_report(spark, root):
    """Precision, recall, f1 and support of both classes for every model."""
    out = ev.class_report(ev.confusion(tables.scores(spark, root)))
    return out.withColumns({c: rounded(c) for c in ("precision", "recall", "f1")})


@query("fraud_metrics", with_views("counts", f"""
  SELECT model, {R(div("tp", "tp + fn"))} AS detection_rate, {R(div("fp", "fp + tn"))} AS false_alarm_rate,
    {R(div("tp", "tp + fp"))} AS positive_precision, tp AS detected, fn AS missed, fp AS false_alarms,
    tp + fn AS total_positives FROM counts"""))
def fraud_metrics(spark, root):
    out = ev.positive_class_report(ev.confusion(tables.scores(spark, root)))
    return out.withColumns(
        {c: rounded(c) for c in ("detection_rate", "false_alarm_rate", "positive_precision")}
    )


_RANKED = "row_number() OVER (ORDER BY roc_auc DESC, model)"


@query("compare_models", with_views("metrics", f"""
  SELECT CAST({_RANKED} AS INTEGER) AS "rank", model, {_rounded_sql(_HEADLINE)} FROM metrics"""))
def compare_models(spark, root):
    out = ev.compare(ev.evaluate(tables.scores(spark, root), decimals=DECIMALS))
    return out.withColumns({c: rounded(c) for c in _HEADLINE})


@query("best_model", with_views("metrics", f"""
  SELECT model, {R("roc_auc")} AS roc_auc FROM (SELECT *, {_RANKED} AS rn FROM metrics) WHERE rn = 1"""))
def best_model(spark, root):
    out = ev.best(ev.roc_auc(tables.scores(spark, root), DECIMALS))
    return out.withColumn("roc_auc", rounded("roc_auc"))


_SWEEP = f"""
  , grid AS (SELECT i, CASE WHEN i = 99 THEN CAST(1 AS DOUBLE)
      ELSE i * (CAST(1 AS DOUBLE) / CAST(99 AS DOUBLE)) END AS t FROM range(100) r(i)),
  agg AS (SELECT model, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
    FROM scores GROUP BY model, p),
  tot AS (SELECT model, sum(pos) AS np FROM agg GROUP BY model),
  cells AS (SELECT model, i, t, np, coalesce(sum(CASE WHEN p >= t THEN pos END), 0) AS tp,
      coalesce(sum(CASE WHEN p >= t THEN neg END), 0) AS fp
    FROM agg JOIN tot USING (model), grid GROUP BY model, i, t, np),
  sweep AS (SELECT model, i, t AS threshold, {div("tp", "tp + fp")} AS "precision",
      {div("tp", "np")} AS recall, {div("2 * tp", "tp + fp + np")} AS f1 FROM cells)"""


@query("threshold_sweep", with_views("scores", f"""{_SWEEP}
  SELECT model, {R("threshold")} AS threshold, {_rounded_sql(["precision", "recall", "f1"])} FROM sweep"""))
def threshold_sweep(spark, root):
    out = ev.threshold_sweep(tables.scores(spark, root))
    return out.withColumns({c: rounded(c) for c in ("threshold", "precision", "recall", "f1")})


def _best_cut(metric: str) -> str:
    return f"""SELECT model, '{metric}' AS metric,
      {R('CASE WHEN s > 0 THEN threshold ELSE 0.5 END')} AS threshold, {R('s')} AS score
    FROM (SELECT model, threshold, "{metric}" AS s,
        row_number() OVER (PARTITION BY model ORDER BY "{metric}" DESC, i) AS rn FROM sweep)
    WHERE rn = 1"""


@query("optimal_threshold", with_views("scores", _SWEEP + " UNION ALL ".join(
    _best_cut(m) for m in ("f1", "precision", "recall"))))
def optimal_threshold(spark, root):
    scored = tables.scores(spark, root)
    out = None
    for metric in ("f1", "precision", "recall"):
        one = ev.optimal_threshold(scored, metric)
        out = one if out is None else out.unionByName(one)
    return out.withColumns({c: rounded(c) for c in ("threshold", "score")})


# Tables behind the charts.


@query("chart_label_distribution", with_views("tx", f"""
  SELECT class AS label, count(*) AS records,
    {R(div("count(*)", "(SELECT count(*) FROM tx)") + " * 100")} AS percent FROM tx GROUP BY class"""))
def chart_label_distribution(spark, root):
    tx = tables.transactions(spark, root)
    counts = tx.groupBy(F.col(TX_LABEL).alias("label")).agg(F.count("*").alias("records"))
    total = counts.agg(F.sum("records").alias("n"))
    return counts.withColumn("percent", rounded(F.col("records") / total.scalar() * 100))


@query("chart_confusion_long", with_views("counts", """
  SELECT model, 0 AS actual, 0 AS predicted, tn AS records FROM counts
  UNION ALL SELECT model, 0, 1, fp FROM counts UNION ALL SELECT model, 1, 0, fn FROM counts
  UNION ALL SELECT model, 1, 1, tp FROM counts"""))
def chart_confusion_long(spark, root):
    cells = {"true_negatives": (0, 0), "false_positives": (0, 1),
             "false_negatives": (1, 0), "true_positives": (1, 1)}
    rows = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(c).alias("records"))
        for c, (a, b) in cells.items()
    ])
    return ev.confusion(tables.scores(spark, root)).select("model", F.inline(rows))


@query("chart_model_comparison", with_views("metrics", " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, {R(chr(34) + m + chr(34))} AS value FROM metrics"
    for m in _HEADLINE)))
def chart_model_comparison(spark, root):
    metrics = ev.evaluate(tables.scores(spark, root), decimals=DECIMALS)
    long = metrics.unpivot(["model"], _HEADLINE, "metric", "value")
    return long.withColumn("value", rounded("value"))


@query("chart_threshold_analysis", with_views("curve", f"""
  SELECT model, p AS threshold, 'precision' AS metric, {R("cp / (cp + cn)")} AS value FROM curve
  UNION ALL SELECT model, p, 'recall', {R(div("cp", "np"))} FROM curve"""))
def chart_threshold_analysis(spark, root):
    points = ev.pr_points(tables.scores(spark, root), DECIMALS)
    long = points.unpivot(["model", "threshold"], ["precision", "recall"], "metric", "value")
    return long.withColumn("value", rounded("value"))


CHART_POINTS = 200
_SLOT = "CAST(floor((rn - {k}) * " + str(CHART_POINTS - 1) + " / CAST(total AS DOUBLE)) AS BIGINT)"


@query("chart_curves", with_views("curve", f"""
  SELECT model, p AS threshold, {R(div("cn", "nn"))} AS fpr, {R(div("cp", "np"))} AS tpr,
    {R("cp / (cp + cn)")} AS "precision" FROM curve"""))
def chart_curves(spark, root):
    """Every point of both curves of each model."""
    out = ev.chart_curves(tables.scores(spark, root), DECIMALS)
    return out.withColumns({c: rounded(c) for c in ("fpr", "tpr", "precision")})


@query("chart_curves_thinned", with_views("curve", f"""
  SELECT model, p AS threshold, {R(div("cn", "nn"))} AS fpr, {R(div("cp", "np"))} AS tpr,
    {R("cp / (cp + cn)")} AS "precision" FROM curve
  WHERE total <= {CHART_POINTS} OR rn = 1 OR rn = total
    OR {_SLOT.format(k=1)} <> {_SLOT.format(k=2)}"""))
def chart_curves_thinned(spark, root):
    """A drawing's worth of points of each model, thinning being asked for."""
    out = ev.chart_curves(tables.scores(spark, root), DECIMALS, CHART_POINTS)
    return out.withColumns({c: rounded(c) for c in ("fpr", "tpr", "precision")})
