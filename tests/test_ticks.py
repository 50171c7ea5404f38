"""Poll and report ticks as streams: each tick once, carry-forward over restarts, late rows of all batches."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import agent
from tallyfold.session import scratch_path
from tallyfold.streaming import streams, ticks

from conftest import rows

SAMPLES = "host bigint, ts timestamp_ntz, seq bigint, id string, value double"


def at(day, hour=5, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def write(spark, path, *samples):
    spark.createDataFrame(list(samples), SAMPLES).coalesce(1).write.mode("append").parquet(path)


def run(spark, start, path, every, lateness, out, checkpoint):
    """One run over the files that are there; (late rows, batches)."""
    schema = spark.createDataFrame([], SAMPLES).schema
    with ticks.LateRows(spark) as late:
        streams.run_to_end(start(streams.file_stream(spark, path, schema, max_files=1), every, lateness, out, checkpoint))
    return late.rows, late.batches


def folder(spark, *names):
    return [scratch_path(spark, n) for n in names]


def reports_of(samples, every="1 day"):
    """The same reports from tables: carry-forward and the samples of each interval."""
    gauges = agent.carry_forward(samples, every).select(
        "host", "tick", "id", F.lit("gauge").alias("type"), F.lit(None).cast("bigint").alias("delta"), "value")
    step = F.expr(f"INTERVAL {every}")
    n = samples.groupBy(F.col("host").alias("h"), (F.window("ts", every)["start"] + step).alias("t")).count()
    all_ticks = gauges.select("host", "tick").distinct().join(n, F.col("h").eqNullSafe(F.col("host")) & (F.col("t") == F.col("tick")), "left")
    return gauges.unionByName(all_ticks.select(
        "host", "tick", F.lit("PollCount").alias("id"), F.lit("counter").alias("type"),
        F.coalesce("count", F.lit(0)).alias("delta"), F.lit(None).cast("double").alias("value")))


def as_set(df):
    return sorted(map(str, df.select("host", "tick", "id", "type", "delta", "value").collect()))


def test_reports_over_batches_and_a_restart(spark):
    src, out, checkpoint = folder(spark, "ticks-in", "ticks-out", "ckpt")
    first = [[(1, at(1), 1, "a", 1.0), (1, at(1, 6), 2, "a", 2.0), (2, at(1, 7), 3, "b", 5.0)],
             [(1, at(2), 4, "b", 3.0), (None, at(2), 9, "n", 8.0)],
             [(3, at(2, 4), 5, "a", 7.0), (3, at(1, 23, 30), 6, "x", 6.0)]]       # an earlier tick of a new host
    then = [[(1, at(5), 11, "a", 9.0), (2, at(5), 12, "c", 1.0)], [(2, at(5, 4), 13, "c", 4.0), (1, at(6, 0), 14, "a", None)]]
    for part in first:
        write(spark, src, *part)
    late, batches = run(spark, ticks.stream_reports, src, "1 day", "6 hours", out, checkpoint)
    assert late == 0 and batches >= 3
    day1 = rows(spark.read.parquet(out).where(F.col("tick") == at(2, 0)), "host", "id", "delta")
    assert day1 == []  # the watermark is at 23:00 of day 1
    for part in then:
        write(spark, src, *part)
    schema = spark.createDataFrame([], SAMPLES).schema
    end = ticks.last_tick(at(6, 0), dt.timedelta(days=1))
    assert end == at(7, 0)
    ticks.heartbeat(spark, src, schema, "ts", end + dt.timedelta(hours=6))
    late, batches = run(spark, ticks.stream_reports, src, "1 day", "6 hours", out, checkpoint)
    assert late == 0 and batches >= 3
    written = spark.read.parquet(out)
    want = reports_of(spark.createDataFrame([r for part in first + then for r in part], SAMPLES))
    assert as_set(written) == as_set(want)
    # the count starts again at every tick, also where nothing came
    assert [r.delta for r in written.where("host = 1 AND id = 'PollCount'").orderBy("tick").collect()] == [2, 1, 0, 0, 1, 1]
    # a third run over the same checkpoint adds nothing
    run(spark, ticks.stream_reports, src, "1 day", "6 hours", out, checkpoint)
    assert spark.read.parquet(out).count() == want.count()


def test_hosts_share_buckets(spark):
    src, out, checkpoint = folder(spark, "buckets-in", "buckets-out", "ckpt")
    hosts = [None, 0, 1, 2, 3, -4, 2**53 + 1]
    parts = [[(h, at(1 + i % 3, 5, i), i, "ab"[i % 2], float(i)) for i, h in enumerate(hosts)],
             [(h, at(4, 5, i), 10 + i, "a", 9.0 + i) for i, h in enumerate(hosts) if i % 3]]
    for part in parts:
        write(spark, src, *part)
    ticks.heartbeat(spark, src, spark.createDataFrame([], SAMPLES).schema, "ts", at(5, 6))

    def start(*args):
        return ticks.stream_reports(*args, buckets=2)

    late, _ = run(spark, start, src, "1 day", "6 hours", out, checkpoint)
    want = reports_of(spark.createDataFrame([r for part in parts for r in part], SAMPLES))
    written = as_set(spark.read.parquet(out))
    assert late == 0 and written == as_set(want) and any("host=None" in r for r in written)


def test_poll_ticks_are_written_once_and_late_rows_counted(spark):
    src, out, checkpoint = folder(spark, "polls-in", "polls-out", "ckpt")
    on_time = [[(1, at(1, 5, 1), 1, "a", 1.0), (1, at(1, 5, 50), 2, "a", 2.0)], [(1, at(1, 5, 55), 3, "a", 3.0), (2, at(1, 8), 4, "a", 4.0)],
               [(2, at(1, 8, 30), 6, "a", 6.0)], [(1, at(1, 12), 7, "b", 7.0)]]
    too_late = [(1, at(1, 5, 59), 5, "a", 99.0), (2, at(1, 6, 10), 8, "c", 98.0)]
    for part in on_time[:3]:
        write(spark, src, *part)
    write(spark, src, *too_late)
    write(spark, src, *on_time[3])
    ticks.heartbeat(spark, src, spark.createDataFrame([], SAMPLES).schema, "ts", at(1, 14))
    late, _ = run(spark, ticks.stream_poll_sampling, src, "1 hour", "1 hour", out, checkpoint)
    assert late == 2
    columns = ("host", "window_start", "id", "value")
    want = agent.poll_sampling(spark.createDataFrame([r for part in on_time for r in part], SAMPLES), "1 hour")
    assert rows(spark.read.parquet(out), *columns) == rows(want, *columns)


def test_late_rows_of_more_batches_than_progress_reports_are_kept(spark):
    src, checkpoint = (p.removeprefix("file:") for p in folder(spark, "many-in", "ckpt"))
    days = [at(1), at(5), at(6), at(1, 6)] + [at(7) + dt.timedelta(minutes=i) for i in range(100)]
    os.makedirs(src)
    for i, day in enumerate(days):
        one = pa.table({"host": [1], "ts": pa.array([day], pa.timestamp("us")), "seq": [i], "id": ["a"], "value": [float(i)]})
        pq.write_table(one, f"{src}/{i:03}.parquet")
        os.utime(f"{src}/{i:03}.parquet", (1_700_000_000 + i,) * 2)  # files are taken in order of their times
    quick = {"spark.sql.shuffle.partitions": "1", "spark.sql.streaming.noDataMicroBatches.enabled": "false",
             "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"}
    before = {k: spark.conf.get(k) for k in quick}
    schema = spark.createDataFrame([], SAMPLES).schema
    samples = streams.file_stream(spark, src, schema, max_files=1).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    try:
        for k, v in quick.items():
            spark.conf.set(k, v)
        with ticks.LateRows(spark) as late:
            query = agent.poll_sampling(samples, "1 day").writeStream.format("noop").outputMode("append").option(
                "checkpointLocation", checkpoint).trigger(availableNow=True).start()
            streams.run_to_end(query)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert late.batches == len(days) and late.rows == 1
    assert len(query.recentProgress) <= 100 < late.batches


def test_lateness_of_a_span(spark):
    assert streams.lateness_of(None) == "1 seconds"
    assert streams.lateness_of((at(1), at(3)), 4) == f"{12 * 3600 + 1} seconds"
    assert streams.time_span(spark.createDataFrame([], SAMPLES), "ts") is None
    df = spark.createDataFrame([(1, at(2), 1, "a", 1.0), (1, at(1), 2, "a", 2.0), (1, None, 3, "a", 3.0)], SAMPLES)
    assert streams.time_span(df, "ts") == (at(1), at(2))


@pytest.mark.parametrize("slices", [1, 3])
def test_slices_hold_every_row_in_order_of_time(spark, slices):
    df = spark.createDataFrame([(1, at(1 + i % 9), i, "a", 1.0) for i in range(90)] + [(1, None, 99, "a", 1.0)], SAMPLES)
    path, = folder(spark, "slices")
    counts = [spark.read.parquet(p).count() for p in streams.staged_slices(df, path, "ts", streams.time_span(df, "ts"), slices)]
    assert len(counts) == slices and counts[-1] == 91 and counts == sorted(counts)
    empty, = folder(spark, "no-slices")
    none = spark.createDataFrame([], SAMPLES)
    assert [spark.read.schema(SAMPLES).parquet(p).count() for p in streams.staged_slices(none, empty, "ts", None, slices)][-1] == 0
