"""Agent readers, reports, journal, envelopes and retries."""

import json
import os

from pyspark.sql import functions as F

from tallyfold.operators import agent, envelope, journal, retry
from tallyfold.schemas import ATTEMPT_SCHEMA, JOURNAL_SCHEMA
from tallyfold.session import scratch_path
from tallyfold.sources.snapshot import read_journal


def test_runtime_reader_27_gauges(spark):
    cols = ", ".join(f"{n} double" for n in agent.RUNTIME_FIELDS)
    wide = spark.createDataFrame([tuple([1] + [float(i) for i in range(27)])], f"sample_id long, {cols}")
    long = agent.unpivot_gauges(wide, ["sample_id"], agent.runtime_extractors())
    got = long.collect()
    assert len(got) == 27 and {r.type for r in got} == {"gauge"}
    assert {r.id for r in got} == set(agent.RUNTIME_FIELDS)


def test_system_reader_cpu_names(spark):
    s = spark.createDataFrame([(1, 100, 40, [12.5, 99.0, 0.0])],
                              "sample_id long, TotalMemory long, FreeMemory long, cpu array<double>")
    got = {r.id: r.value for r in agent.system_gauges(s, ["sample_id"]).collect()}
    assert got == {"TotalMemory": 100.0, "FreeMemory": 40.0, "CPUutilization1": 12.5,
                   "CPUutilization2": 99.0, "CPUutilization3": 0.0}
    assert all(0 <= v <= 100 for k, v in got.items() if k.startswith("CPU"))


def test_self_metrics_and_union(spark):
    s = spark.createDataFrame([(1,), (2,)], "sample_id long")
    sm = agent.self_metrics(s, ["sample_id"], seed=1)
    assert sm.where("id = 'PollCount'").agg(F.sum("delta")).first()[0] == 2
    assert sm.where("id = 'RandomValue'").count() == 2


def test_agent_buffer_last_record_any_type(spark):
    s = spark.createDataFrame([(1, 1, "x", "counter", 5, None), (1, 2, "x", "gauge", None, 2.0),
                               (1, 3, "y", "gauge", None, 1.0), (1, 4, "y", "counter", 7, None)],
                              "host long, seq long, id string, type string, delta long, value double")
    got = {r.id: (r.type, r.delta, r.value) for r in agent.agent_buffer(s).collect()}
    assert got == {"x": ("gauge", None, 2.0), "y": ("counter", 7, None)}


def test_journal_line(spark):
    df = spark.createDataFrame([(1700000123, ["queue_depth", "jobs"], "10.20.30.40")], JOURNAL_SCHEMA)
    path = scratch_path(spark, "journal-line")
    journal.write_journal(df, path)
    assert spark.read.text(path).first()[0] == '{"ts":1700000123,"metrics":["queue_depth","jobs"],"ip_address":"10.20.30.40"}'


def test_journal_append_and_empty_path(spark):
    path = scratch_path(spark, "journal")
    a = spark.createDataFrame([(1, ["A"], "127.0.0.1")], JOURNAL_SCHEMA)
    b = spark.createDataFrame([(2, ["B"], "127.0.0.2")], JOURNAL_SCHEMA)
    assert journal.write_journal(a, path) and journal.write_journal(b, path)
    assert not journal.write_journal(a, "")
    got = sorted((r.ts, list(r.metrics), r.ip_address) for r in read_journal(spark, path).collect())
    assert got == [(1, ["A"], "127.0.0.1"), (2, ["B"], "127.0.0.2")]


def test_fanout_rounds_add_nothing_twice(spark):
    a, b = scratch_path(spark, "j-a"), scratch_path(spark, "j-b")
    one = spark.createDataFrame([(1, ["A"], "h")], JOURNAL_SCHEMA)
    two = spark.createDataFrame([(2, ["B"], "h")], JOURNAL_SCHEMA)
    first = journal.fan_out(one, [a, None, "nosuchfs://x/y", b], "d1")
    assert first.delivered and first.written == (True, False, False, True)
    assert first.errors[2] and [first.errors[i] for i in (0, 1, 3)] == [None] * 3
    journal.fan_out(two, [a, b], "d2")
    journal.fan_out(two, [a, b], "d2")              # delivered again after a lost answer
    journal.fan_out(one.limit(0), [a, b], "d3")     # nothing to deliver
    for sink in (a, b):
        assert sorted(r.ts for r in read_journal(spark, sink).collect()) == [1, 2]
    assert not journal.fan_out(one, [], "d4").delivered
    assert not journal.fan_out(one, ["nosuchfs://x/y"], "d5").delivered


def test_client_ip(spark):
    from tallyfold.operators.routing import client_ip
    cases = {"192.168.7.42:1234": "192.168.7.42", "[::1]:80": "::1", "nohost": "nohost", "fe80::1": "fe80::1",
             "::1:80": "::1:80", "[fe80::2%eth0]:443": "fe80::2%eth0", ":80": "", "host:": "host", "[::1]": "[::1]"}
    df = spark.createDataFrame([(c,) for c in cases], "r string")
    assert dict(df.select("r", client_ip("r")).collect()) == cases


def _keys(spark):
    import hashlib
    return spark.createDataFrame([("k0", bytearray(hashlib.sha256(b"x").digest()))],
                                 "key_id string, data_key binary")


def test_envelope_roundtrip_and_errors(spark):
    keys = _keys(spark)
    body = '{"id":"g1","type":"gauge","value":1.23}'
    df = spark.createDataFrame([(1, body)], "request_id long, body string").crossJoin(keys)
    sealed = df.select("request_id", envelope.seal("body", "data_key", "key_id").alias("body"))
    env = json.loads(sealed.first().body)
    assert env["alg"] == envelope.ALG and env["v"] == 1
    rows = [
        (1, sealed.first().body, envelope.HEADER_VALUE),
        (2, body, None),
        (3, sealed.first().body, "other;v=1"),
        (4, '{"alg":"x","k":"azA=","n":"AA==","d":"AA==","v":1}', envelope.HEADER_VALUE),
        (5, json.dumps({**env, "n": "AAAA"}), envelope.HEADER_VALUE),
        (6, json.dumps({**env, "d": "A" + env["d"][1:] if env["d"][0] != "A" else "B" + env["d"][1:]}),
         envelope.HEADER_VALUE),
        (7, "not json", envelope.HEADER_VALUE),
    ]
    reqs = spark.createDataFrame(rows, "request_id long, body string, x_encrypted string")
    got = {r.request_id: (r.decrypt_status, r.plain and bytes(r.plain).decode()) for r in envelope.open_envelopes(reqs, keys).collect()}
    assert got[1] == (None, body) and got[2] == (None, body)
    assert all(got[i][0] == 400 for i in (3, 4, 5, 6, 7))
    nokey = {r.request_id: r.decrypt_status for r in envelope.open_envelopes(reqs, None).collect()}
    assert nokey[1] == 500 and nokey[2] is None


def test_retry_plan_cases(spark):
    rows = [(1, 1, True, 0, None, None),
            (2, 1, False, 503, None, None), (2, 2, True, 0, None, None),
            (3, 1, False, 0, "connection refused", None), (3, 2, False, 0, "timeout", None),
            (3, 3, False, 0, "EOF", None),
            (4, 1, False, 400, "bad request", None), (4, 2, True, 0, None, None)]
    a = spark.createDataFrame(rows, ATTEMPT_SCHEMA)
    got = {r.delivery_id: (r.attempts, r.delivered, r.wait_s) for r in retry.retry_plan(a).collect()}
    assert got == {1: (1, True, 0), 2: (2, True, 1), 3: (3, False, 9), 4: (1, False, 0)}
    two = {r.delivery_id: r.attempts for r in retry.retry_plan(a, delays=(10, 20)).collect()}
    assert two[3] == 2


def test_db_retriable(spark):
    df = spark.createDataFrame([("40001",), ("23505",), (None,)], "sqlstate string")
    assert [r[0] for r in df.select(retry.db_retriable()).collect()] == [True, False, False]


def test_outgoing_checks_and_path_record(spark):
    from tallyfold.operators.validate import outgoing_reason
    from tallyfold.sinks.report import path_record
    df = spark.createDataFrame([("", "counter", 5, None), ("g", "gauge", None, 1.5), ("c", "counter", None, None),
                                ("x", "other", 1, None), ("h", "gauge", None, 5e-7)],
                               "id string, type string, delta long, value double")
    out = df.select("id", outgoing_reason().alias("r"), path_record().alias("p")).collect()
    got = {r.id: (r.r, r.p) for r in out}
    assert got[""] == (None, "/update/counter//5")          # the id is not checked on send
    assert got["g"] == (None, "/update/gauge/g/1.500000")
    assert got["c"][0] == "missing required field: delta"
    assert got["x"][0] == "unsupported metric type: other"
    assert got["h"][1] == "/update/gauge/h/0.000000"       # exact %f rounding


def test_reader_union(spark):
    s = spark.createDataFrame([(1, 100, 40, [1.0])], "sample_id long, TotalMemory long, FreeMemory long, cpu array<double>")
    u = agent.all_readers(agent.system_gauges(s, ["sample_id"]), agent.self_metrics(s, ["sample_id"], seed=3))
    assert sorted(r.id for r in u.collect()) == ["CPUutilization1", "FreeMemory", "PollCount", "RandomValue", "TotalMemory"]
