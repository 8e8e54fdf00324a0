import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyrank.operators.traffic import rate_limit_offenders
from tallyrank.session import scratch_path
from tallyrank.streaming import flows

START = dt.datetime(2024, 1, 1, 12, 0, 0)


def arriving(spark, batches, schema):
    """A file stream that reads one written batch at a time, in order."""
    path = scratch_path(spark, "arriving")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_are_dropped_and_open_windows_wait(spark):
    def at(seconds, user=1):
        return (user, START + dt.timedelta(seconds=seconds))

    batches = [[at(1), at(2), at(3)], [at(3600), at(3601)], [at(3700)], [at(4)], [at(7200)]]
    stream = arriving(spark, batches, "user_id long, ts timestamp")
    got = flows.rate_limit_stream(stream, limit=1, lateness="10 minutes").collect()
    # The fourth call of the first minute came an hour late, after a batch that
    # already knew the watermark.
    assert sorted((r["window_start"], r["requests"]) for r in got) == [
        (START, 3), (START + dt.timedelta(seconds=3600), 2)]


def test_repeated_keys_across_batches_are_stored_once(spark):
    row = (1, START, 5, 9, "click")
    other = (2, START, 5, 9, "error")
    stream = arriving(spark, [[row, row], [row, other]],
                      "event_id long, ts timestamp, user_id long, product_id long, kind string")
    assert [r["event_id"] for r in flows.ingest_stream(stream).collect()] == [1]


def test_quarantine_keeps_every_record_once(spark):
    rows = [[(1.0, 1.0, None), (-1.0, 1.0, "xgboost")], [(2.0, None, "nope")]]
    stream = arriving(spark, rows, "time double, amount double, model_name string")
    good, bad = flows.quarantine_stream(stream, ["time", "amount"])
    assert good.count() == 1 and bad.count() == 2


def test_running_totals_end_with_everything(spark):
    stream = arriving(spark, [[(1.0,)], [(3.0,)], [(8.0,)]], "duration_ms double")
    got = flows.runtime_stats_stream(stream).collect()
    assert [tuple(r) for r in got] == [(3, 4.0)]


def test_batch_offenders_use_the_limit(spark):
    rows = [(1, START)] * 101 + [(2, START)] * 100
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    assert [r["user_id"] for r in rate_limit_offenders(df).collect()] == [1]


def test_duplicate_state_holds_the_delay_and_not_the_feed(spark):
    """Thirty days of events, a batch a day and each again in the next: keys of one batch's last hour stay."""
    def day(n):
        return [(n * 1000 + i, START + dt.timedelta(days=n, minutes=14 * i), 5, 9, "click") for i in range(100)]

    batches = []
    for n in range(30):
        batches.append(day(n) + day(n)[-3:])
    progress = []
    stream = arriving(spark, batches, "event_id long, ts timestamp, user_id long, product_id long, kind string")
    stored = flows.ingest_stream(stream, progress=progress)
    assert stored.count() == 3000 and stored.select("event_id").distinct().count() == 3000
    held = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    assert held and max(held) <= 210
    assert any("rocksdb" in k for p in progress for op in p["stateOperators"] for k in op["customMetrics"])


def test_event_times_do_not_depend_on_the_session_zone(spark, root):
    from tallyrank.registry import QUERIES

    def rows(name):
        return sorted(map(str, QUERIES[name](spark, root).collect()))

    names = ["stream_interactions", "stream_rate_limit"]
    before, zone = [rows(n) for n in names], spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert [rows(n) for n in names] == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
