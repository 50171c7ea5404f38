"""State fold, snapshots, upsert, restore, lookups, running state."""

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import fold, lookup
from tallyfold.schemas import STATE_SCHEMA, UPDATE_SCHEMA
from tallyfold.session import scratch_path
from tallyfold.sinks import snapshot as sink
from tallyfold.sources import snapshot as src


def _updates(spark, rows):
    data = [(None, 0, seq, None, i, t, d, v, None) for seq, (i, t, d, v) in enumerate(rows)]
    return spark.createDataFrame(data, UPDATE_SCHEMA)


def _as_dict(st):
    return {(r.name, r.type): (r.delta, r.value) for r in st.collect()}


def test_counter_and_gauge_same_name_are_independent(spark):
    u = _updates(spark, [("x", "counter", 1, None), ("x", "gauge", None, 2.5),
                         ("x", "counter", -3, 9.9), ("x", "gauge", 7, 0.0)])
    assert _as_dict(fold.fold_state(u)) == {("x", "counter"): (-2, None), ("x", "gauge"): (None, 0.0)}


def test_invalid_updates_skipped(spark):
    u = _updates(spark, [("", "counter", 1, None), ("a", "", 1, None), ("a", "counter", None, 1.0),
                         ("a", "unknown", 1, 1.0), ("a", "counter", 0, None)])
    assert _as_dict(fold.fold_state(u)) == {("a", "counter"): (0, None)}


def test_overflow_policy(spark):
    big = 9223372036854775807
    u = _updates(spark, [("a", "counter", big, None), ("a", "counter", 1, None)])
    with pytest.raises(Exception):
        fold.fold_state(u).collect()
    assert _as_dict(fold.fold_state(u, on_overflow="null")) == {("a", "counter"): (None, None)}


def test_apply_twice_doubles_counters(spark):
    snap = spark.createDataFrame([("c", "counter", 5, None), ("g", "gauge", None, 1.5)], STATE_SCHEMA)
    empty = _updates(spark, []).limit(0)
    once = fold.apply_updates(snap, empty)
    twice = fold.apply_updates(once, fold.state_as_updates(snap))
    assert _as_dict(twice) == {("c", "counter"): (10, None), ("g", "gauge"): (None, 1.5)}


def test_snapshot_roundtrip_json_and_parquet(spark):
    st = spark.createDataFrame([("c", "counter", 5, None), ("g", "gauge", None, float("nan"))], STATE_SCHEMA)
    for fmt in ("json", "parquet"):
        table = scratch_path(spark, "t-snap")
        sink.write_snapshot(st, table, fmt=fmt, version=1)
        back = src.read_state_table(spark, table, fmt)
        d = _as_dict(back)
        assert d[("c", "counter")] == (5, None)
        assert d[("g", "gauge")][1] != d[("g", "gauge")][1]  # NaN kept
        with pytest.raises(Exception):  # a replayed version never overwrites
            sink.write_snapshot(st, table, fmt=fmt, version=1)


def test_missing_snapshot_is_empty(spark):
    assert src.read_snapshot_json(spark, scratch_path(spark, "nothing")).count() == 0
    assert src.read_state_table(spark, scratch_path(spark, "nothing")).count() == 0


def test_multiline_array_snapshot(spark):
    path = scratch_path(spark, "arr")
    import os
    os.makedirs(path)
    with open(os.path.join(path, "dump.json"), "w") as f:
        f.write('[\n  {"id": "c", "type": "counter", "delta": 3},\n  {"id": "g", "type": "gauge", "value": 0.5}\n]')
    assert _as_dict(src.read_snapshot_json(spark, path, multiline=True)) == {
        ("c", "counter"): (3, None), ("g", "gauge"): (None, 0.5)}


def test_upsert_table_writes_only_touched_buckets(spark):
    first = spark.createDataFrame([(f"k{i}", "counter", i, None) for i in range(200)], STATE_SCHEMA)
    for fmt in ("parquet", "json"):
        table = scratch_path(spark, "t-upsert")
        sink.write_snapshot(first, table, fmt=fmt)
        before = sink.bucket_paths(spark, table)
        change = spark.createDataFrame([("k7", "counter", 70, None), ("new", "gauge", None, 0.5)], STATE_SCHEMA)
        sink.upsert_snapshot(change, table, fmt)
        after = sink.bucket_paths(spark, table)
        touched = {r[0] for r in change.select(sink.bucket_of(sink.BUCKETS)).collect()}
        assert {b for b in after if after[b] != before.get(b)} == touched
        want = _as_dict(first) | {("k7", "counter"): (70, None), ("new", "gauge"): (None, 0.5)}
        assert _as_dict(src.read_state_table(spark, table, fmt)) == want
        assert sink.upsert_snapshot(change.limit(0), table, fmt) is None        # an empty source is a no-op
        sink.write_snapshot(change, table, fmt=fmt)                             # a full version hides older buckets
        assert _as_dict(src.read_state_table(spark, table, fmt)) == _as_dict(change)


def test_upsert_keeps_untouched_and_empty_is_noop(spark):
    target = spark.createDataFrame([("a", "counter", 1, None), ("b", "gauge", None, 1.0)], STATE_SCHEMA)
    source = spark.createDataFrame([("a", "counter", 9, None), ("c", "gauge", None, 3.0)], STATE_SCHEMA)
    assert _as_dict(sink.upsert(target, source)) == {
        ("a", "counter"): (9, None), ("b", "gauge"): (None, 1.0), ("c", "gauge"): (None, 3.0)}
    assert _as_dict(sink.upsert(target, source.limit(0))) == _as_dict(target)


def test_db_hydrate_keeps_matching_column(spark):
    df = spark.createDataFrame([("a", "counter", 1, 2.0), ("b", "gauge", 3, 4.0)], STATE_SCHEMA)
    assert _as_dict(sink.hydrate(df)) == {("a", "counter"): (1, None), ("b", "gauge"): (None, 4.0)}


def test_lookup_found_and_missing(spark):
    st = spark.createDataFrame([("PollCount", "counter", 100, None), ("Alloc", "gauge", None, 1.234567)],
                               STATE_SCHEMA)
    keys = spark.createDataFrame([(1, "counter", "PollCount"), (2, "gauge", "Alloc"), (3, "gauge", "Frees"),
                                  (4, "counter", "Alloc")], "request_id long, type string, id string")
    found = {r.request_id: (r.delta, r.value) for r in lookup.read_found(keys, st).collect()}
    assert found == {1: (100, None), 2: (None, 1.234567)}
    assert sorted(r.request_id for r in lookup.read_missing(keys, st).collect()) == [3, 4]


def test_null_times_stay_in_the_rest(spark):
    from tallyfold.plans.catalog import _before_split
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01'), (NULL), (TIMESTAMP_NTZ '2024-02-01') AS t(ts)")
    cut = _before_split("ts")
    assert df.where(cut).count() == 1 and df.where(~cut).count() == 2


def test_running_state_chunks_equal_window(spark):
    rows = [("a", "counter", i % 7 - 3, None) for i in range(300)] + [("g", "gauge", None, 1.0 * i) for i in range(5)]
    u = _updates(spark, rows)
    small = {(r.seq): r.total for r in fold.running_state(u, chunk_rows=16).collect() if r.type == "counter"}
    big = {(r.seq): r.total for r in fold.running_state(u).collect() if r.type == "counter"}
    acc, want = 0, {}
    for seq, (_, t, d, _) in enumerate(rows):
        if t == "counter":
            acc += d
            want[seq] = acc
    assert small == want and big == want
