"""Restores that stop, reads as of their time, reads against a live table."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import lookup
from tallyfold.schemas import STATE_SCHEMA, UPDATE_SCHEMA
from tallyfold.session import scratch_path
from tallyfold.sources.snapshot import read_snapshot_json
from tallyfold.streaming import streams

from conftest import rows

GOOD = [{"id": f"m{i:03}", "type": "counter", "delta": i} if i % 2 else {"id": f"m{i:03}", "type": "gauge", "value": i / 2} for i in range(40)]
BAD = [{"id": "", "type": "gauge", "value": 1.0}, {"id": "x", "type": "timer"}, {"id": "x", "type": "counter"}, {"id": "x", "type": "gauge", "delta": 1}, "{not json"]


def snapshot(spark, *files, array=False):
    path = scratch_path(spark, "snapshot").removeprefix("file:")
    os.makedirs(path)
    for i, records in enumerate(files):
        text = json.dumps(records, indent=1) if array else "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records)
        with open(f"{path}/part-{i:03}.json", "w", encoding="utf-8") as f:
            f.write(text)
    return path


def restored(spark, path, **options):
    return [r.name for r in read_snapshot_json(spark, path, stop_at_invalid=True, **options).orderBy("name").collect()]


@pytest.mark.parametrize("bad", BAD)
def test_restore_stops_at_the_first_invalid_record(spark, bad):
    names = [g["id"] for g in GOOD]
    path = snapshot(spark, GOOD[:10], [*GOOD[10:15], bad, *GOOD[15:20], bad], [bad, *GOOD[20:]])
    assert restored(spark, path) == names[:15]
    assert restored(spark, snapshot(spark, [bad, *GOOD[:5]], GOOD[5:])) == []


def test_restore_of_good_snapshots(spark):
    names = [g["id"] for g in GOOD]
    assert restored(spark, snapshot(spark, GOOD[:25], GOOD[25:])) == names
    assert restored(spark, snapshot(spark, GOOD, array=True), multiline=True) == names
    assert restored(spark, snapshot(spark, [*GOOD[:7], BAD[1], *GOOD[7:]], GOOD[20:], array=True), multiline=True) == names[:7]
    assert restored(spark, "/tmp/there/is/no/such/snapshot") == []


def test_restore_order_over_splits_of_one_file(spark):
    many = [{"id": f"k{i:06}", "type": "counter", "delta": i} for i in range(20_000)]
    path = snapshot(spark, [*many[:15_000], BAD[1], *many[15_000:17_000], BAD[2], *many[17_000:]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert len(restored(spark, path)) == 15_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("chunk_rows", [1, 7, 64, 1 << 20])
def test_reads_as_of_their_seq(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    keys = [("counter", "hot"), ("gauge", "hot"), ("counter", "rare"), ("gauge", "late")]
    updates, reads, state, want = [], [], {}, []
    for seq in range(300):
        kind, name = rng.choices(keys, (6, 3, 0.2, 1 if seq > 250 else 0))[0]
        if rng.random() < 0.6:
            ok = rng.random() < 0.9
            delta, value = (seq if ok else None, None) if kind == "counter" else (None, seq / 4 if ok else None)
            updates.append((seq, 0, seq, None, name, kind, delta, value, None))
            if ok:
                state[kind, name] = state.get((kind, name), 0) + delta if kind == "counter" else value
        if rng.random() < 0.6:
            kind, name = rng.choice([*keys, ("gauge", "never")])
            reads.append((1000 + seq, seq, kind, name))
            held = state.get((kind, name))
            want.append((1000 + seq, kind, name, held if kind == "counter" else None, held if kind == "gauge" else None, 404 if held is None else 200))
    found = lookup.read_as_of(spark.createDataFrame(reads, "request_id bigint, seq bigint, type string, id string"),
                              spark.createDataFrame(updates, UPDATE_SCHEMA), chunk_rows)
    assert rows(found, "request_id", "type", "id", "delta", "value", "status") == sorted(want)


def test_reads_as_of_empty_tables(spark):
    reads = spark.createDataFrame([(1, 5, "gauge", "a")], "request_id bigint, seq bigint, type string, id string")
    none = spark.createDataFrame([], UPDATE_SCHEMA)
    assert rows(lookup.read_as_of(reads, none), "request_id", "status") == [(1, 404)]
    assert lookup.read_as_of(reads.limit(0), none).count() == 0


def test_live_reads_name_the_version_that_answers(spark):
    table, out = scratch_path(spark, "live"), scratch_path(spark, "answers")
    asked = spark.createDataFrame([(1, "counter", "c"), (2, "gauge", "c"), (3, "counter", "z")], "request_id bigint, type string, id string")
    answer = streams.live_read_writer(table, out, "r")
    fold = streams.change_log_writer(table, "f")
    answer(asked, 0)                                             # nothing committed yet
    fold(spark.createDataFrame([("c", "counter", 5, None)], STATE_SCHEMA), 0)
    answer(asked, 1)
    fold(spark.createDataFrame([("c", "counter", 9, None), ("c", "gauge", None, 0.5)], STATE_SCHEMA), 1)
    answer(asked, 2)
    fold(spark.createDataFrame([("c", "counter", 11, None)], STATE_SCHEMA), 2)
    answer(asked, 1)                                             # replays keep their answers
    answer(asked, 2)
    got = streams.read_answers(spark, out)
    by_version = {v: rows(got.where(F.col("version").eqNullSafe(F.lit(v).cast("bigint"))), "request_id", "status", "delta", "value") for v in (None, 0, 1, 2)}
    assert by_version == {None: [(1, 404, None, None), (2, 404, None, None), (3, 404, None, None)],
                          0: [(1, 200, 5, None), (2, 404, None, None), (3, 404, None, None)],
                          1: [(1, 200, 9, None), (2, 200, None, 0.5), (3, 404, None, None)], 2: []}
    assert streams.last_change(spark, table) == 2
    old = streams.read_change_log(spark, table, ["name", "type"], version=0)
    assert rows(old, "name", "delta") == [("c", 5)]
