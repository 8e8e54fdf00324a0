"""Streaming flows over the given tables, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrank.contract import TX_FEATURES, TX_KEY, LINEAR_SCORERS
from tallyrank.functions.numeric import rounded
from tallyrank.registry.base import query
from tallyrank.registry.quality import _REASONS
from tallyrank.registry.sql import R, TX_KEY_SQL, with_views
from tallyrank.sources import tables
from tallyrank.streaming import flows


def _feed(spark, root):
    return flows.stream_table(spark, root, "events").select(
        "event_id", "ts", "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
        F.col("event_type").alias("kind"),
    )


def _log(spark, root):
    return flows.stream_table(spark, root, "events").select(
        "event_id", "ts", "user_id", F.col("value").alias("duration_ms")
    )


@query("stream_quarantine", with_views("records", f"""
  SELECT {TX_KEY_SQL}, concat_ws(',', {_REASONS}) AS issues,
    CASE WHEN concat_ws(',', {_REASONS}) = '' THEN 'good' ELSE 'bad' END AS route FROM records"""))
def stream_quarantine(spark, root):
    lines = flows.stream_table(spark, root, "lineitem")
    seconds = F.unix_seconds("l_shipdate")
    names = F.array(*[F.lit(n) for n in [*LINEAR_SCORERS, "unknown_model"]])
    records = lines.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        seconds.alias("ship_s"),
        (seconds - F.lit(804556800)).cast("double").alias("time"),
        F.col("l_quantity").alias("v1"),
        (F.col("l_discount") + F.lit(0.0)).alias("v2"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("v3"),
        (F.col("l_extendedprice") - F.lit(2000.0)).alias("amount"),
        F.get(names, (F.col("l_suppkey") % 6).cast("int")).alias("model_name"),
    )
    good, bad = flows.quarantine_stream(records, TX_FEATURES)
    both = good.withColumn("route", F.lit("good")).unionByName(bad.withColumn("route", F.lit("bad")))
    return both.select(*TX_KEY, F.concat_ws(",", "issues").alias("issues"), "route")


@query("stream_interactions", with_views("inter", """
  SELECT event_id, user_id, product_id, kind, epoch_us(ts) AS ts_us FROM inter"""))
def stream_interactions(spark, root):
    """The feed arrives twice; every interaction is stored once."""
    twice = _feed(spark, root).unionByName(_feed(spark, root))
    stored = flows.ingest_stream(twice, within="1 hour")
    return stored.select(
        "event_id", "user_id", "product_id", "kind", F.unix_micros("ts").alias("ts_us")
    )


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM {source})"


@query("stream_trending", with_views("inter", f"""
  SELECT CAST(epoch(window_end) AS BIGINT) AS window_end, product_id, weight, events, "rank" FROM (
    SELECT window_end, product_id, sum(w) AS weight, count(*) AS events,
      CAST(row_number() OVER (PARTITION BY window_end ORDER BY sum(w) DESC, product_id) AS INTEGER)
        AS "rank"
    FROM (SELECT product_id, w,
            date_trunc('hour', ts) + INTERVAL 1 HOUR + to_hours(unnest(range(24))) AS window_end
          FROM inter)
    WHERE window_end <= {_CLOSED.format(source="inter")}
    GROUP BY window_end, product_id) WHERE "rank" <= 20"""))
def stream_trending(spark, root):
    feed = _feed(spark, root).filter(F.col("kind").isin("view", "click", "purchase"))
    out = flows.trending_stream(feed)
    return out.select(
        F.unix_seconds("window_end").alias("window_end"), "product_id", "weight", "events", "rank"
    )


@query("stream_rate_limit", with_views("reqlog", f"""
  SELECT user_id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS window_start, count(*) AS requests
  FROM reqlog
  WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {_CLOSED.format(source="reqlog")}
  GROUP BY user_id, date_trunc('minute', ts) HAVING count(*) > 1"""))
def stream_rate_limit(spark, root):
    out = flows.rate_limit_stream(_log(spark, root), limit=1)
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query("stream_runtime_stats", with_views("reqlog", f"""
  SELECT count(*) AS predictions, {R("avg(duration_ms)", 4)} AS mean_ms FROM reqlog"""))
def stream_runtime_stats(spark, root):
    out = flows.runtime_stats_stream(_log(spark, root))
    return out.withColumn("mean_ms", rounded("mean_ms", 4))
