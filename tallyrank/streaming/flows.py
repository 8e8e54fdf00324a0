"""Structured Streaming forms of scoring, validation, ingest and statistics.

Each flow takes a streaming DataFrame, runs until the source is exhausted
(``availableNow``; a long-running job passes another trigger) and writes to a
folder with a checkpoint beside it, so a restart continues where it stopped.
Batches written by hand go to a folder per batch id and overwrite it, so a
retried batch leaves no second copy.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallyrank.operators.preferences import interaction_weight
from tallyrank.operators.quality import validate_interactions, validate_records
from tallyrank.session import scratch_path
from tallyrank.sources.tables import epoch_micros

LATENESS = "10 minutes"
STATE = "spark.sql.streaming.stateStore.providerClass"
# Keeps state off the heap, on the executors' disks, and in the checkpoint folder.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The given table as a stream of files.

    Event times without a zone become the instants of UTC, whatever the session's zone.
    """
    path = os.path.join(root, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    # A pattern lets the table be one file as well as a folder of files.
    out = spark.readStream.schema(schema).parquet(os.path.join(root, f"{name}.parque[t]"))
    for field in schema:
        if field.dataType.simpleString() == "timestamp_ntz":
            out = out.withColumn(field.name, F.timestamp_micros(epoch_micros(field.name)))
    return out


def run(writer, path: str, spark: SparkSession) -> list:
    """Run a stream to the end of its source; what it reported of each batch."""
    before = spark.conf.get(STATE, None)
    spark.conf.set(STATE, ROCKSDB)  # a query takes its settings when it starts
    try:
        query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STATE)
        else:
            spark.conf.set(STATE, before)
    query.awaitTermination()
    return query.recentProgress


def to_files(stream: DataFrame, name: str, progress: list | None = None) -> DataFrame:
    """Append the stream to parquet files and return them as a table; ``progress`` gets the batches' reports."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/data")
    reports = run(writer, path, spark)
    if progress is not None:
        progress += reports
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def to_batches(
    stream: DataFrame, name: str, outputs: dict[str, Callable[[DataFrame], DataFrame]], mode="append"
) -> str:
    """Run the outputs on every micro-batch, each into its own folder; returns the root."""
    path = scratch_path(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist() if len(outputs) > 1 else batch
        for output, make in outputs.items():
            made = make(held)
            made.write.mode("overwrite").parquet(f"{path}/{output}/batch={batch_id}")
        if len(outputs) > 1:
            held.unpersist()

    run(stream.writeStream.outputMode(mode).foreachBatch(write), path, stream.sparkSession)
    return path


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score rows with fitted models; stateless, so equal to the batch result."""
    return to_files(score(stream), "stream-score")


def quarantine_stream(stream: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good and rejected scoring records, routed to two folders in one pass."""
    spark = stream.sparkSession
    checked = validate_records(stream, features)
    path = to_batches(
        checked,
        "stream-quarantine",
        {"good": lambda b: b.filter("valid"), "bad": lambda b: b.filter("NOT valid")},
    )
    read = spark.read.schema(checked.schema)
    return read.parquet(f"{path}/good/*"), read.parquet(f"{path}/bad/*")


def ingest_stream(stream: DataFrame, key: str = "event_id", within: str = "1 hour", progress: list | None = None) -> DataFrame:
    """Valid interactions, a repeated key within the delay stored once.

    A key is remembered for the delay only, so the state holds the keys of about that
    long; a row that comes later than the delay after newer ones is dropped.
    """
    good = validate_interactions(stream).filter("valid").drop("issues", "valid")
    return to_files(
        good.withWatermark("ts", within).dropDuplicatesWithinWatermark([key]), "stream-interactions", progress
    )


def trending_stream(stream: DataFrame, limit: int = 20, lateness: str = LATENESS) -> DataFrame:
    """Top products of every sliding 24 h window, hourly, once the window closes.

    Events are summed per hour first; the 24-fold spread over windows then acts
    on hourly totals instead of events.
    """
    hourly = (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("hour"), "product_id")
        .agg(F.sum(interaction_weight()).alias("weight"), F.count("*").alias("events"))
    )
    daily = hourly.groupBy(
        F.window(F.window_time("hour"), "24 hours", "1 hour").alias("w"), "product_id"
    ).agg(F.sum("weight").alias("weight"), F.sum("events").alias("events"))

    def top(batch: DataFrame) -> DataFrame:
        order = W.partitionBy("window_end").orderBy(F.desc("weight"), F.asc("product_id"))
        flat = batch.select(F.col("w.end").alias("window_end"), "product_id", "weight", "events")
        ranked = flat.withColumn("rank", F.row_number().over(order))
        return ranked.filter(F.col("rank") <= limit)

    path = to_batches(daily, "stream-trending", {"top": top})
    return stream.sparkSession.read.parquet(f"{path}/top").drop("batch")


def rate_limit_stream(
    stream: DataFrame, limit: int, seconds: int = 60, lateness: str = LATENESS
) -> DataFrame:
    """Callers above the limit in a closed tumbling window; late rows are dropped."""
    counted = (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "user_id")
        .agg(F.count("*").alias("requests"))
        .filter(F.col("requests") > limit)
        .select("user_id", F.col("w.start").alias("window_start"), "requests")
    )
    return to_files(counted, "stream-rate-limit")


def runtime_stats_stream(stream: DataFrame) -> DataFrame:
    """Running totals; the last batch holds the totals of everything read."""
    totals = stream.groupBy().agg(
        F.count("*").alias("predictions"), F.avg("duration_ms").alias("mean_ms")
    )
    path = to_batches(totals, "stream-stats", {"totals": lambda b: b}, mode="complete")
    all_batches = stream.sparkSession.read.parquet(f"{path}/totals")
    newest = all_batches.agg(F.max("batch").alias("b")).scalar()
    return all_batches.filter(F.col("batch") == newest).drop("batch")
