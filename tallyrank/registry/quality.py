"""Sources, data quality, splitting and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrank.contract import (
    BATCH_MAX, CARD_FEATURES, CARD_LABEL, INTERACTION_WEIGHTS, MODEL_NAMES, SEED, TX_FEATURES,
    TX_KEY, TX_LABEL,
)
from tallyrank.functions.numeric import rounded
from tallyrank.operators import quality, scaling, split
from tallyrank.registry.base import query
from tallyrank.registry.sql import R, TX_KEY_SQL, div, with_views
from tallyrank.session import materialize, scratch_path
from tallyrank.sources import tables
from tallyrank.sources.store import INTERACTIONS, Store
from tallyrank.sources.transactions import read_checked

FEATURES_SQL = '"time", v1, v2, v3, amount'


@query("load_transactions", with_views("tx", f"SELECT {TX_KEY_SQL}, {FEATURES_SQL}, class FROM tx"))
def load_transactions(spark, root):
    return tables.transactions(spark, root)


@query("load_with_quarantine", with_views("tx", """
  SELECT order_key, line_no, CASE order_key % 50 WHEN 0 THEN 'value' WHEN 1 THEN 'fields' ELSE 'good' END AS route,
    CASE WHEN order_key % 50 > 1 THEN amount END AS amount FROM tx"""))
def load_with_quarantine(spark, root):
    """Transactions written as CSV, some with a broken value or cut off, and read with those set aside."""
    fields = ["order_key", "line_no", *TX_FEATURES, TX_LABEL]
    tx = tables.transactions(spark, root).select(*fields)
    line = F.concat_ws(",", *[F.when((F.col("order_key") % 50 == 0) & F.lit(f == "v2"), F.lit("n/a")).otherwise(F.col(f).cast("string"))
                              for f in fields])
    path = scratch_path(spark, "lines")
    tx.select(F.when(F.col("order_key") % 50 == 1, F.substring_index(line, ",", 4)).otherwise(line)).write.text(path)
    good, bad = read_checked(spark, path, tx.schema, header=False)
    cut = F.split("line", ",")
    routed = bad.select(cut[0].cast("bigint").alias("order_key"), cut[1].cast("int").alias("line_no"), F.col("reason").alias("route"),
                        F.lit(None).cast("double").alias("amount"))
    return good.select("order_key", F.col("line_no").cast("int"), F.lit("good").alias("route"), "amount").union(routed)


@query("load_processed", with_views("split", f"SELECT {TX_KEY_SQL}, amount, class, split FROM split"))
def load_processed(spark, root):
    """Prepared train and test tables, written once by split and read back."""
    parts = split.train_test_split(tables.transactions(spark, root), TX_LABEL, TX_KEY)
    stored = materialize(
        parts.select(*TX_KEY, "amount", TX_LABEL, "split"), "processed", partition_by=["split"]
    )
    train = stored.filter(F.col("split") == "train")
    test = stored.filter(F.col("split") == "test")
    return train.unionByName(test)


@query("dq_profile", with_views("tx_raw", """
  SELECT count(*) AS total_records, 4 AS total_columns,
    CAST(sum(CASE WHEN v1 IS NULL THEN 1 ELSE 0 END + CASE WHEN v2 IS NULL THEN 1 ELSE 0 END
      + CASE WHEN v3 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_values,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tx_raw)) AS duplicate_records,
    CAST(sum(CASE WHEN isinf(v1) OR isinf(v2) OR isinf(v3) THEN 1 ELSE 0 END) AS BIGINT)
      AS infinite_values
  FROM tx_raw"""))
def dq_profile(spark, root):
    return quality.profile(tables.raw_transactions(spark, root))


@query("dq_required_columns", with_views("tx", """
  SELECT c AS "column", 'missing' AS issue, (SELECT count(*) FROM tx) AS records
  FROM (SELECT unnest(['v' || i FOR i IN range(1, 29)] || ['time', 'amount', 'class']) AS c)
  WHERE c NOT IN ('v1', 'v2', 'v3', 'time', 'amount', 'class')"""))
def dq_required_columns(spark, root):
    required = [c.lower() for c in [*CARD_FEATURES, CARD_LABEL]]
    return quality.required_columns(tables.transactions(spark, root), required)


@query("dq_label_domain", """
  SELECT label, count(*) AS records FROM embeddings
  WHERE label IS NULL OR label NOT IN (0, 1) GROUP BY label""")
def dq_label_domain(spark, root):
    return quality.label_domain(tables.table(spark, root, "embeddings"), "label")


@query("class_distribution", with_views("tx", f"""
  SELECT count(*) AS total, CAST(sum(class) AS BIGINT) AS positives,
    CAST(count(*) - sum(class) AS BIGINT) AS negatives,
    {R(div("sum(class)", "count(*)") + " * 100")} AS positive_rate FROM tx"""))
def class_distribution(spark, root):
    out = quality.class_distribution(tables.transactions(spark, root), TX_LABEL)
    return out.withColumn("positive_rate", rounded("positive_rate"))


@query("missing_by_column", with_views("tx_raw", """
  SELECT * FROM (
    SELECT 'v2' AS "column", count(*) FILTER (v2 IS NULL) AS missing FROM tx_raw
    UNION ALL SELECT 'v3', count(*) FILTER (v3 IS NULL) FROM tx_raw
    UNION ALL SELECT 'v1', count(*) FILTER (v1 IS NULL) FROM tx_raw
    UNION ALL SELECT 'class', count(*) FILTER (class IS NULL) FROM tx_raw) WHERE missing > 0"""))
def missing_by_column(spark, root):
    return quality.missing_by_column(tables.raw_transactions(spark, root))


@query("clean_data", with_views("tx_raw", """
  SELECT DISTINCT v1, v2, v3, class FROM tx_raw WHERE v1 IS NOT NULL AND v2 IS NOT NULL
    AND v3 IS NOT NULL AND class IS NOT NULL"""))
def clean_data(spark, root):
    return quality.clean(tables.raw_transactions(spark, root))


@query("feature_order_check", with_views("tx", "SELECT count(*) AS records, true AS matches FROM tx"))
def feature_order_check(spark, root):
    tx = tables.transactions(spark, root).select(*TX_FEATURES, TX_LABEL)
    return quality.feature_order_check(tx, TX_FEATURES, TX_LABEL)


_REASONS = ", ".join(
    [f"CASE WHEN {f} IS NULL THEN '{n}:missing' END"
     for f, n in zip(FEATURES_SQL.split(", "), TX_FEATURES)]
    + ["CASE WHEN \"time\" < 0 THEN 'time:negative' END",
       "CASE WHEN amount < 0 THEN 'amount:negative' END",
       "CASE WHEN model_name NOT IN (" + ", ".join(f"'{m}'" for m in MODEL_NAMES)
       + ") THEN 'model_name:unknown' END"]
)


@query("record_validation", with_views("records", f"""
  SELECT {TX_KEY_SQL}, concat_ws(',', {_REASONS}) AS issues,
    concat_ws(',', {_REASONS}) = '' AS valid FROM records"""))
def record_validation(spark, root):
    checked = quality.validate_records(tables.scoring_records(spark, root), TX_FEATURES)
    return checked.select(*TX_KEY, F.concat_ws(",", "issues").alias("issues"), "valid")


_KINDS = ", ".join(f"'{k}'" for k in INTERACTION_WEIGHTS)


@query("interaction_validation", with_views("feed", f"""
  SELECT event_id, user_id, product_id, kind,
    CASE WHEN kind IN ({_KINDS}) THEN '' ELSE 'kind:unknown' END AS issues,
    kind IN ({_KINDS}) AS valid FROM feed"""))
def interaction_validation(spark, root):
    checked = quality.validate_interactions(tables.interactions(spark, root))
    return checked.select(
        "event_id", "user_id", "product_id", "kind",
        F.concat_ws(",", "issues").alias("issues"), "valid",
    )


@query("interaction_ingest", with_views("inter", "SELECT event_id, user_id, product_id, kind FROM inter"))
def interaction_ingest(spark, root):
    """Good interactions appended to a store, the run tried twice with a failure between, then read from it."""
    checked = quality.validate_interactions(tables.interactions(spark, root))
    good = checked.filter("valid").select("event_id", "user_id", "product_id", "kind")
    store = Store(spark, scratch_path(spark, "interactions"), INTERACTIONS)
    store.append(good, "first")
    store.stage(good)  # a run that ends before it is named
    store.append(good, "first")
    return store.read().drop("run_id")


@query("batch_size_check", with_views("tx", f"""
  SELECT supp_key AS batch_id, count(*) AS records, count(*) BETWEEN 1 AND {BATCH_MAX} AS accepted
  FROM tx GROUP BY supp_key"""))
def batch_size_check(spark, root):
    return quality.batch_sizes(tables.transactions(spark, root), "supp_key")


@query("stratified_split", with_views("split", f"SELECT {TX_KEY_SQL}, class, split FROM split"))
def stratified_split(spark, root):
    parts = split.train_test_split(tables.transactions(spark, root), TX_LABEL, TX_KEY)
    return parts.select(*TX_KEY, TX_LABEL, "split")


@query("split_report", with_views("split", f"""
  SELECT split, count(*) AS records, CAST(sum(class) AS BIGINT) AS positives,
    {R(div("sum(class)", "count(*)") + " * 100")} AS positive_rate FROM split GROUP BY split"""))
def split_report(spark, root):
    parts = split.train_test_split(tables.transactions(spark, root), TX_LABEL, TX_KEY)
    return split.split_report(parts, TX_LABEL).withColumn("positive_rate", rounded("positive_rate"))


@query("feature_projection", with_views("tx", f"SELECT {FEATURES_SQL} FROM tx"))
def feature_projection(spark, root):
    return tables.transactions(spark, root).select(*TX_FEATURES)


def _spread(f: str) -> str:
    return f"CASE WHEN stddev_pop({f}) = 0 THEN CAST(1 AS DOUBLE) ELSE stddev_pop({f}) END"


@query("scaler_stats", with_views("tx", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {R(f'avg({f})', 3)} AS mean, {R(_spread(f), 3)} AS scale FROM tx"
    for f, n in zip(FEATURES_SQL.split(", "), TX_FEATURES))))
def scaler_stats(spark, root):
    out = scaling.scaler_stats(tables.transactions(spark, root), TX_FEATURES)
    return out.select("feature", rounded("mean", 3).alias("mean"), rounded("scale", 3).alias("scale"))


def _scaled_sql(source: str, rows: str) -> str:
    stats = ", ".join(
        f"avg({f}) AS m_{n}, {_spread(f)} AS s_{n}"
        for f, n in zip(FEATURES_SQL.split(", "), TX_FEATURES)
    )
    cols = ", ".join(
        f'{R(f"({f} - m_{n}) / s_{n}")} AS {f}' for f, n in zip(FEATURES_SQL.split(", "), TX_FEATURES)
    )
    return f"SELECT {TX_KEY_SQL}, {cols} FROM {rows}, (SELECT {stats} FROM {source})"


@query("scale_features", with_views("tx", _scaled_sql("tx", "tx")))
def scale_features(spark, root):
    tx = tables.transactions(spark, root)
    out = scaling.scale(tx, TX_FEATURES, scaling.scaler_state(tx, TX_FEATURES))
    return out.select(*TX_KEY, *[rounded(f).alias(f) for f in TX_FEATURES])


@query("prepare_inference", with_views(
    "split", _scaled_sql("split WHERE split = 'train'", "(SELECT * FROM split WHERE split = 'test')")))
def prepare_inference(spark, root):
    """Test rows scaled with the state of the train rows."""
    parts = split.train_test_split(tables.transactions(spark, root), TX_LABEL, TX_KEY)
    state = scaling.scaler_state(parts.filter(F.col("split") == "train"), TX_FEATURES)
    out = scaling.inference_frame(parts.filter(F.col("split") == "test"), TX_FEATURES, state)
    return out.select(*TX_KEY, *[rounded(f).alias(f) for f in TX_FEATURES])


@query("class_weights", with_views("emb", f"""
  SELECT class AS label, n AS records, {R(div("total", "k * n"))} AS weight
  FROM (SELECT class, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
          count(*) OVER () AS k FROM emb GROUP BY class)"""))
def class_weights(spark, root):
    out = scaling.class_weights(tables.vectors(spark, root), "class")
    return out.withColumn("weight", rounded("weight"))
