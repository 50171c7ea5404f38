"""Stream sinks: runs, replays, half-written batches, late rows, complete input."""

import os

import pytest
from pyspark.sql import functions as F

from tallyfold.schemas import STATE_SCHEMA
from tallyfold.session import scratch_path
from tallyfold.sinks import snapshot as snap
from tallyfold.sources.snapshot import read_state_table
from tallyfold.streaming import streams

KEYS = ["name", "type"]


def state(spark, *rows):
    return spark.createDataFrame(list(rows), STATE_SCHEMA)


def as_dict(df):
    return {(r.name, r.type): (r.delta, r.value) for r in df.collect()}


def test_change_log_replay_and_latest(spark):
    table = scratch_path(spark, "changes")
    w = streams.change_log_writer(table, "run1")
    w(state(spark, ("c", "counter", 1, None), ("g", "gauge", None, 1.0)), 0)
    w(state(spark, ("c", "counter", 5, None)), 1)
    w(state(spark, ("c", "counter", 99, None)), 1)      # a replayed batch is skipped
    assert as_dict(streams.read_change_log(spark, table, KEYS)) == {("c", "counter"): (5, None), ("g", "gauge"): (None, 1.0)}


def test_change_log_order_beyond_ten_batches(spark):
    table = scratch_path(spark, "changes-many")
    w = streams.change_log_writer(table, "run1")
    for i in range(12):
        w(state(spark, ("c", "counter", i, None)), i)
    assert as_dict(streams.read_change_log(spark, table, KEYS)) == {("c", "counter"): (11, None)}


def test_second_run_with_a_fresh_checkpoint(spark):
    changes, table = scratch_path(spark, "changes-two"), scratch_path(spark, "snaps-two")
    for run, name in (("run1", "a"), ("run2", "b")):
        streams.change_log_writer(changes, run)(state(spark, (name, "counter", 1, None)), 0)
        streams.upsert_batch_writer(table, run)(state(spark, (name, "counter", 1, None)), 0)
    want = {("a", "counter"): (1, None), ("b", "counter"): (1, None)}
    assert as_dict(streams.read_change_log(spark, changes, KEYS)) == want
    assert as_dict(read_state_table(spark, table)) == want
    assert streams.run_name("/x/ckpt-1") != streams.run_name("/x/ckpt-2")


def test_change_log_with_base(spark):
    table = scratch_path(spark, "changes-base")
    base = state(spark, ("c", "counter", 10, None), ("old", "gauge", None, 2.0))
    streams.change_log_writer(table, "r", base)(state(spark, ("c", "counter", 3, None)), 0)
    got = as_dict(streams.read_change_log(spark, table, KEYS, base=base))
    assert got == {("c", "counter"): (13, None), ("old", "gauge"): (None, 2.0)}


def test_snapshot_writer_replay(spark):
    table = scratch_path(spark, "snaps")
    w = streams.upsert_batch_writer(table, "r")
    w(state(spark, ("c", "counter", 1, None)), 0)
    w(state(spark, ("c", "counter", 7, None)), 0)
    assert snap.committed_versions(spark, table) == [0]
    assert as_dict(read_state_table(spark, table)) == {("c", "counter"): (1, None)}


def test_stream_on_a_table_written_in_batch(spark):
    table = scratch_path(spark, "snaps-batch")
    snap.write_snapshot(state(spark, ("c", "counter", 1, None), ("k", "gauge", None, 4.0)), table)   # version = time in ms
    streams.upsert_batch_writer(table, "r")(state(spark, ("c", "counter", 8, None)), 0)
    assert as_dict(read_state_table(spark, table)) == {("c", "counter"): (8, None), ("k", "gauge"): (None, 4.0)}


def test_half_written_batches_do_not_stop_the_stream(spark):
    changes, table = scratch_path(spark, "changes-half"), scratch_path(spark, "snaps-half")
    streams.change_log_writer(changes, "r")(state(spark, ("c", "counter", 1, None)), 0)
    streams.upsert_batch_writer(table, "r")(state(spark, ("c", "counter", 1, None)), 0)
    done = streams.committed_changes(spark, changes)[0].removeprefix("file:")
    os.remove(f"{done}/_SUCCESS")       # what a driver lost in the middle leaves
    part = snap.versions(spark, table)[0].path.removeprefix("file:")
    os.remove(f"{part}/_SUCCESS")
    streams.change_log_writer(changes, "r")(state(spark, ("c", "counter", 2, None)), 0)
    streams.upsert_batch_writer(table, "r")(state(spark, ("c", "counter", 2, None)), 0)
    assert as_dict(streams.read_change_log(spark, changes, KEYS)) == {("c", "counter"): (2, None)}
    assert as_dict(read_state_table(spark, table)) == {("c", "counter"): (2, None)}


def test_staged_copy_keeps_null_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("event_id"))
    path = streams.staged_copy(df, "staged")
    assert spark.read.parquet(path).count() == 5000
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet")]) >= 5


class LongRun:
    """A stream that ends by itself after `needs` seconds, of which none pass here."""

    def __init__(self, needs):
        self.needs, self.isActive, self.stopped = needs, True, False

    def awaitTermination(self, timeout=None):
        self.isActive = timeout is not None and timeout < self.needs
        return not self.isActive

    def stop(self):
        self.isActive, self.stopped = False, True

    def exception(self):
        return None


def test_a_long_stream_runs_to_its_end():
    query = LongRun(needs=86_400)
    streams.run_to_end(query)
    assert not query.isActive and not query.stopped
    limited = LongRun(needs=86_400)
    with pytest.raises(TimeoutError):
        streams.run_to_end(limited, timeout_s=5)
    assert limited.stopped
