"""Streaming fan-out: a failing sink, a crash between two sinks, replays, outcomes per item."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyfold.operators.journal import write_journal
from tallyfold.plans import catalog
from tallyfold.schemas import JOURNAL_SCHEMA
from tallyfold.session import scratch_path
from tallyfold.sources.snapshot import read_journal
from tallyfold.streaming import fanout, streams

from conftest import rows

FIELDS = "request_id bigint, ts bigint, metrics array<string>, ip_address string"


def items(spark, first, n):
    return spark.createDataFrame([(i, 1000 + i, [f"m{i}", "m"], f"10.0.0.{i}") for i in range(first, first + n)], FIELDS)


def write_file(spark, path, first, n):
    items(spark, first, n).coalesce(1).write.mode("append").parquet(path)


def start(spark, path, sinks, ledger, checkpoint, write=write_journal):
    stream = streams.file_stream(spark, path, items(spark, 0, 0).schema, max_files=1)
    return fanout.stream_fan_out(stream, sinks, ledger, checkpoint, write=write)


@pytest.fixture
def folders(spark):
    return [scratch_path(spark, n) for n in ("fan-in", "fan-ledger", "ckpt", "fan-a", "fan-b")]


def lines(spark, path):
    return sorted((r.ts, *r.metrics, r.ip_address) for r in read_journal(spark, path).collect())


def want(spark, n):
    return sorted((r.ts, *r.metrics, r.ip_address) for r in items(spark, 0, n).collect())


def test_outcomes_with_a_failing_sink(spark, folders):
    src, ledger, checkpoint, a, b = folders
    for i in range(3):
        write_file(spark, src, 4 * i, 4)
    sinks = {"a": a, "down": "nosuchfs://x/y", "off": None, "b": b}
    streams.run_to_end(start(spark, src, sinks, ledger, checkpoint))
    run = streams.run_name(checkpoint)
    found = rows(fanout.outcomes(spark, ledger), "run", "batch", "sink", "ok", "rows")
    assert found == sorted((run, n, s, s in "ab", 4 if s in "ab" else 0) for n in range(3) for s in sinks)
    assert fanout.outcomes(spark, ledger).where("sink = 'down' AND error LIKE '%nosuchfs%'").count() == 3
    assert lines(spark, a) == lines(spark, b) == want(spark, 12)
    per_item = fanout.item_outcomes(spark, ledger, items(spark, 0, 0).schema)
    assert rows(per_item, "request_id", "taken", "delivered") == [(i, 2, True) for i in range(12)]


def test_crash_between_two_sinks(spark, folders):
    src, ledger, checkpoint, a, b = folders
    write_file(spark, src, 0, 3)
    write_file(spark, src, 3, 3)
    seen = []

    def crash(batch, path, delivery):
        seen.append((path, delivery))
        if path == b and delivery.endswith("-1"):
            write_journal(batch.limit(1), path, delivery)   # half of it is there
            raise RuntimeError("the driver is lost")
        return write_journal(batch, path, delivery)

    with pytest.raises(Exception):
        streams.run_to_end(start(spark, src, {"a": a, "b": b}, ledger, checkpoint, crash))
    assert len(lines(spark, a)) == 6 and len(lines(spark, b)) == 4
    assert fanout.item_outcomes(spark, ledger, items(spark, 0, 0).schema).where("taken = 1 AND delivered").count() == 3
    again = []

    def note(batch, path, delivery):
        again.append((path, delivery.rsplit("-", 1)[1]))
        return write_journal(batch, path, delivery)

    write_file(spark, src, 6, 2)
    streams.run_to_end(start(spark, src, {"a": a, "b": b}, ledger, checkpoint, note))
    assert again == [(b, "1"), (a, "2"), (b, "2")]   # the served sink is not written again
    assert lines(spark, a) == lines(spark, b) == want(spark, 8)
    assert fanout.item_outcomes(spark, ledger, items(spark, 0, 0).schema).where("taken = 2 AND delivered").count() == 8


def test_half_stored_batch_is_stored_again(spark, folders):
    import os

    _, ledger, _, a, _ = folders
    deliver = fanout.fan_out_writer({"a": a}, ledger, "r")
    items(spark, 0, 2).write.parquet(f"{ledger}/items/run=r/batch=0")
    os.remove(f"{ledger}/items/run=r/batch=0/_SUCCESS".removeprefix("file:"))
    deliver(items(spark, 0, 3), 0)
    deliver(items(spark, 5, 3), 0)     # a replay of a finished batch does nothing
    assert lines(spark, a) == want(spark, 3)


def test_no_sinks_and_empty_ledger(spark, folders):
    _, ledger, _, a, _ = folders
    schema = items(spark, 0, 0).schema
    assert fanout.outcomes(spark, ledger).count() == fanout.item_outcomes(spark, ledger, schema).count() == 0
    fanout.fan_out_writer({}, ledger, "r")(items(spark, 0, 2), 0)
    assert rows(fanout.item_outcomes(spark, ledger, schema), "request_id", "taken", "delivered") == [(0, 0, False), (1, 0, False)]
    fanout.fan_out_writer({"off": None}, ledger, "s")(items(spark, 2, 1), 0)
    assert rows(fanout.item_outcomes(spark, ledger, schema).where("run = 's'"), "request_id", "delivered") == [(2, False)]
    assert spark.createDataFrame([], JOURNAL_SCHEMA).columns == read_journal(spark, a).columns
    assert fanout.outcomes(spark, ledger).where(F.col("ok")).count() == 0


def write_events(spark, folder, n):
    """Events of three users, some of whose batches and bodies are odd by the rules of the log."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i % 3, ("view", "click")[i % 4 // 2], i / 4, f'{{"k": {i % 80}}}') for i in range(n)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string") \
        .coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_a_log_is_streamed_in_bounded_files_and_batches(spark, monkeypatch):
    folder = scratch_path(spark, "log-events")
    write_events(spark, folder, 120)
    monkeypatch.setattr(catalog, "LOG_FILE_ROWS", 60, raising=False)
    log = spark.read.parquet(catalog.request_log_path(spark, folder))
    per_file = [r["count"] for r in log.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 120 + 120 + 6 and max(per_file) <= 60 and len(per_file) >= 5
    want = rows(catalog.QUERIES["audit_journal"](spark, folder), "ts", "metrics", "ip_address")
    assert rows(catalog.QUERIES["stream_journal"](spark, folder), "ts", "metrics", "ip_address") == want
    out = catalog.QUERIES["stream_fanout"](spark, folder)
    assert rows(out.where("kind = 'item' AND taken = 2 AND delivered"), "ts", "metrics", "ip_address") == want
    for sink in ("a", "b"):
        assert rows(out.where(F.col("sink") == sink), "ts", "metrics", "ip_address") == want


def test_a_micro_batch_of_the_log_has_files_for_every_core(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(catalog.streams, "file_stream", lambda *a, max_files, **k: taken.append(max_files))
    for files in (0, 3, 16, 40, 100_000):
        monkeypatch.setattr(catalog, "request_log_path", lambda *_: "log")
        monkeypatch.setattr(catalog, "_request_log", lambda *_: SimpleNamespace(inputFiles=lambda: range(files), schema=None))
        catalog._log_stream(spark, "any")
    few, cores = catalog.FILES_PER_TRIGGER, spark.sparkContext.defaultParallelism
    assert taken == [few, few, few, max(few, min(10, few * cores)), few * cores]
