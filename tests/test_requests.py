"""Request decisions: routes, bodies, transport, and what reaches the state."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import jsonwire
from tallyfold.functions.hmac import hmac_sha256_hex
from tallyfold.operators import envelope, fold, journal
from tallyfold.plans import pipeline
from tallyfold.schemas import REQUEST_SCHEMA, STATE_SCHEMA
from tallyfold.sources import requests as rq

OK_BODY = '{"id":"jobs","type":"counter","delta":3}'


def _log(spark, reqs, seqs=None):
    data = [(i, (seqs or range(len(reqs)))[i], None, m, p, h or {}, None if b is None else bytearray(b if isinstance(b, bytes) else b.encode()),
             "10.9.8.7:5555") for i, (m, p, b, h) in enumerate(reqs)]
    return spark.createDataFrame(data, REQUEST_SCHEMA)


def _status(spark, reqs, cfg=None, **kw):
    d = pipeline.decide_requests(_log(spark, reqs), cfg or pipeline.EdgeConfig(), **kw)
    got = dict(d.select("request_id", "status").collect())
    return [got[i] for i in range(len(reqs))]


def _state(spark, reqs, cfg=None, seqs=None):
    d = pipeline.decide_requests(_log(spark, reqs, seqs), cfg or pipeline.EdgeConfig())
    return {(r.name, r.type): (r.delta, r.value) for r in fold.fold_state(pipeline.accepted_updates(d), validate=False).collect()}


# one case for each rule of the path routes
PATHS = [
    ("POST", "/update/counter/jobs/12", 200), ("POST", "/update/counter/jobs/-7", 200), ("POST", "/update/gauge/load-avg/0.25", 200),
    ("POST", "/update/gauge/load/-3", 200), ("POST", "/update/counter/jobs/1.5", 400), ("POST", "/update/counter/jobs/99999999999999999999", 400),
    ("POST", "/update/gauge/load/high", 400), ("POST", "/update/timer/jobs/12", 400), ("GET", "/update/counter/jobs/12", 405),
    ("PATCH", "/update/gauge/load/1", 405), ("POST", "/update/counter/", 404), ("POST", "/update/gauge", 404), ("GET", "/nowhere", 404),
    ("GET", "/value/counter/absent", 404), ("GET", "/value/timer/jobs", 400), ("GET", "/ping", 503), ("GET", "/", 200), ("POST", "/", 405),
    # inside the group no pattern takes an upper-case value: the body is read, then nothing handles the path
    ("POST", "/update/gauge/load/INF", 400),
]


def test_path_statuses(spark):
    got = _status(spark, [(m, p, None, None) for m, p, _ in PATHS], state=spark.createDataFrame([], STATE_SCHEMA))
    assert got == [s for _, _, s in PATHS]


# bodies that the pattern of plain records takes, and near ones that it must not
NEAR_PLAIN = [
    OK_BODY, '{"id":"jobs","type":"gauge","value":-0.5e-7}', '{"id":"","type":""}', '{"id":"a b/é漢","type":"gauge","value":1E+20}',
    '{"id":"j","type":"counter","delta":999999999999999999}', '{"id":"j","type":"counter","delta":9999999999999999999}', '{"id":"j","type":"counter","delta":-0}',
    '{"id":"j","type":"counter","delta":01}', '{"id":"j","type":"gauge","value":1e999}', '{"id":"j","type":"gauge","value":1.}',
    '{"id":"j","type":"gauge","value":.5}', '{"id":"a\\u0041\\n","type":"gauge","value":1}', '{"id":"a\tb","type":"gauge","value":1}',
    '{"id":"j","type":"gauge","delta":1,"value":2}', '{"type":"gauge","id":"j","value":2}', '{"id":"j","type":"gauge","value":' + "9" * 400 + "}",
    '{"id":"' + "x" * 300_000 + '","type":"gauge","value":1}', '{"id":"a"b","type":"gauge","value":1}', '{"id":"j","type":"gauge","value":1}}',
    '{"id":"j","type":"gauge","value":1}\n',
]


def test_plain_records_decode_like_any_other(spark):
    df = spark.createDataFrame([(i, b, f" {b}") for i, b in enumerate(NEAR_PLAIN)], "i int, a string, b string")
    d = jsonwire.with_single(jsonwire.with_single(df, "a", "x"), "b", "y")
    assert df.where(F.col("b").rlike(jsonwire.PLAIN_RECORD)).count() == 0 and df.where(F.col("a").rlike(jsonwire.PLAIN_RECORD)).count() >= 7
    rows = d.select("i", "x", "y").orderBy("i").collect()
    assert [r.x for r in rows] == [r.y for r in rows]


def test_repeated_names_in_a_batch(spark):
    body = '[{"id":"a","id":"jobs","type":"counter","delta":1,"delta":3},{"id":"jobs","type":"counter","delta":2,"x":{"y":1,"y":2}}]'
    assert _state(spark, [("POST", "/updates", body, None)]) == {("jobs", "counter"): (5, None)}


def test_unhandled_path_comes_before_the_method(spark):
    assert _status(spark, [(m, "/update/gauge/load/INF", OK_BODY, None) for m in ("POST", "PUT", "GET")]) == [404, 404, 404]
    assert _status(spark, [("GET", "/updates", "[]", None), ("PUT", "/update", OK_BODY, None), ("GET", "/updates", "?", None)]) == [405, 405, 400]


SINGLES = [
    ('{"id":"first","id":"jobs","type":"gauge","type":"counter","delta":1,"delta":3}', 200),
    ('{"meta":{"a":1,"a":{"b":1,"b":2}},"id":"jobs","type":"counter","delta":3}', 200), ('{"id":"jobs","type":"counter","delta":3,"delta":null}', 500),
    ('{"id":"jobs","type":"counter","delta":3,"delta":"3"}', 400),
    (OK_BODY, 200), ("  " + OK_BODY + "\n", 200), (OK_BODY + " x", 400), (OK_BODY + OK_BODY, 400), (OK_BODY + "]", 400), (OK_BODY + ', 5', 400),
    ('{"meta":{"id":5,"value":"x"},"id":"jobs","type":"counter","delta":3}', 200), ('{"ID":"jobs","TYPE":"counter","Delta":3}', 200),
    ('{"id":"load","type":"gauge","value":1e400}', 400), ('{"id":"load","type":"gauge","value":1e300}', 200),
    ('{"id":"load","type":"gauge","value":7}', 200), ('{"id":"load","type":"gauge","value":"7"}', 400), ('{"id":7,"type":"gauge","value":7}', 400),
    ('{"id":"jobs","type":"counter","delta":3.0}', 400), ('{"id":"jobs","type":"counter","delta":9223372036854775808}', 400),
    ('{"id":"jobs","type":"counter"}', 500), ('{"id":"load","type":"gauge","value":null}', 500), ('{"id":"jobs","type":"timer","delta":3}', 500),
    ("null", 500), ("{}", 500), ("[]", 400), ("3", 400), ("", 400), ("  ", 400), (None, 400), ('{"id":"jobs",}', 400), ('{"hash":5}', 400),
]


def test_single_bodies(spark):
    got = _status(spark, [("POST", "/update", b, None) for b, _ in SINGLES])
    assert got == [s for _, s in SINGLES]


BATCHES = [
    ("[]", 200), ("null", 200), (f"[{OK_BODY}]", 200), (f"[{OK_BODY}] x", 400), (f"[{OK_BODY}", 400), (OK_BODY, 400), ("7", 400), ("", 400), (None, 400),
    ("[null]", 500), ("[5]", 400), (f'[{OK_BODY},{{"id":"load","type":"gauge"}}]', 500), (f'[{OK_BODY},{{"id":"load","type":"gauge","value":-1e999}}]', 400),
    ('[{"Id":"jobs","Type":"counter","DELTA":1,"extra":[1,{"id":2}]}]', 200),
]


def test_batch_bodies(spark):
    got = _status(spark, [("POST", "/updates", b, None) for b, _ in BATCHES])
    assert got == [s for _, s in BATCHES]


def test_batches_add_up_and_bad_ones_keep_their_prefix(spark):
    one = '[{"id":"jobs","type":"counter","delta":4},{"id":"load","type":"gauge","value":0.5},{"id":"jobs","type":"counter","delta":6}]'
    two = '[{"id":"load","type":"gauge","value":2.25},{"id":"errors","type":"counter","delta":1},{"id":"x","type":"timer"},{"id":"late","type":"counter","delta":9}]'
    reqs = [("POST", "/updates", b, None) for b in (one, two)]
    assert _status(spark, reqs) == [200, 500]
    assert _state(spark, reqs) == {("jobs", "counter"): (10, None), ("load", "gauge"): (None, 2.25), ("errors", "counter"): (1, None)}


def test_order_holds_beyond_a_million_items_and_with_microsecond_seqs(spark):
    items = ",".join(['{"id":"a","type":"counter","delta":1}'] * (1 << 20)) + ',{"id":"g","type":"gauge","value":1}'
    micros = 1_700_000_000_000_000
    got = _state(spark, [("POST", "/updates", f"[{items}]", None), ("POST", "/update", '{"id":"g","type":"gauge","value":2}', None)],
                 seqs=[micros, micros + 1])
    assert got == {("a", "counter"): (1 << 20, None), ("g", "gauge"): (None, 2.0)}


def test_reads(spark):
    state = spark.createDataFrame([("load", "gauge", None, 1.5), ("jobs", "counter", 12, None)], STATE_SCHEMA)
    reqs = [("POST", "/value", '{"id":"load","type":"gauge"}', None), ("POST", "/value", '{"id":"jobs","type":"counter"}', None),
            ("POST", "/value", '{"id":"jobs","type":"gauge"}', None), ("GET", "/value/counter/jobs", None, None)]
    assert _status(spark, reqs, state=state) == [200, 200, 404, 200]
    d = pipeline.decide_requests(_log(spark, reqs), pipeline.EdgeConfig(), state=state.withColumn("text", F.lit("t")))
    assert {r.request_id: (r.found_delta, r.found_value, r.found_text) for r in d.collect()} == {
        0: (None, 1.5, "t"), 1: (12, None, "t"), 2: (None, None, None), 3: (12, None, "t")}


def test_proto_batch(spark):
    reqs = spark.createDataFrame(
        [(1, 1, [("load", 0, None, 0.75), ("jobs", 1, 8, None)]), (2, 2, [("odd", 100, None, None)])],
        "request_id long, seq long, metrics array<struct<id:string,type:int,delta:bigint,value:double>>")
    u = rq.proto_updates(reqs)
    assert {(r.name, r.type): (r.delta, r.value) for r in fold.fold_state(u).collect()} == {
        ("load", "gauge"): (None, 0.75), ("jobs", "counter"): (8, None)}
    assert u.where(F.col("request_id") == 2).first().type == "unknown"


def _sign(spark, body, key="k"):
    return spark.createDataFrame([(bytearray(body),)], "b binary").select(hmac_sha256_hex("b", key)).first()[0]


def test_subnet_and_signature(spark):
    good, empty = _sign(spark, OK_BODY.encode()), _sign(spark, b"")
    inside = {"X-Real-IP": "10.4.0.9"}
    reqs = [("POST", "/update", OK_BODY, {**inside, "HashSHA256": good}), ("POST", "/update", OK_BODY, {**inside, "HashSHA256": "00"}),
            ("POST", "/update", OK_BODY, {"X-Real-IP": "10.5.0.9"}), ("POST", "/update", OK_BODY, {}), ("POST", "/update", OK_BODY, inside),
            ("POST", "/updates", None, {**inside, "HashSHA256": empty}), ("POST", "/updates", None, {**inside, "HashSHA256": good})]
    cfg = pipeline.EdgeConfig(trusted_cidr="10.4.0.0/16", sign_key="k")
    assert _status(spark, reqs, cfg) == [200, 400, 403, 400, 200, 400, 400]


def _key_table(spark):
    return spark.createDataFrame([("k0", bytearray(hashlib.sha256(b"key").digest()))], "key_id string, data_key binary")


def _seal(spark, body):
    return spark.createDataFrame([(body,)], "b string").crossJoin(_key_table(spark)) \
        .select(envelope.seal("b", "data_key", "key_id").alias("e")).first().e


def test_gzip_and_encrypted_bodies(spark):
    packed, sealed = gzip.compress(OK_BODY.encode(), mtime=0), _seal(spark, OK_BODY)
    env = json.loads(sealed)
    bad = json.dumps({**env, "d": ("B" if env["d"][0] == "A" else "A") + env["d"][1:]})
    gz, enc = {"Content-Encoding": "gzip"}, {"X-Encrypted": envelope.HEADER_VALUE}
    signed = {**gz, "HashSHA256": _sign(spark, packed)}
    reqs = [("POST", "/update", packed, gz), ("POST", "/update", OK_BODY, gz), ("POST", "/update", packed[:-6], gz), ("POST", "/update", None, gz),
            ("POST", "/update", packed, None), ("POST", "/update", sealed, enc), ("POST", "/update", bad, enc),
            ("POST", "/update", gzip.compress(sealed.encode()), {**gz, **enc}), ("POST", "/update", OK_BODY, {"Content-Encoding": "br"}),
            ("POST", "/update", packed, signed), ("GET", "/", "?", gz), ("GET", "/value/gauge/none", "?", gz), ("POST", "/update/gauge/load/1", "?", gz)]
    cfg = pipeline.EdgeConfig(keys=_key_table(spark), sign_key="k")
    assert _status(spark, reqs, cfg) == [200, 500, 400, 500, 400, 200, 400, 200, 200, 200, 500, 500, 200]
    assert _state(spark, reqs[:8], cfg) == {("jobs", "counter"): (9, None)}
    assert _status(spark, reqs[5:7], pipeline.EdgeConfig()) == [500, 500]


def test_seal_draws_one_nonce_per_body(spark):
    keys = _key_table(spark)
    df = spark.range(300).select(F.col("id").cast("string").alias("body"), F.lit(envelope.HEADER_VALUE).alias("x_encrypted")).crossJoin(keys)
    wire = df.select("x_encrypted", F.col("body").alias("was"), envelope.seal("body", "data_key", "key_id").alias("body"))
    opened = envelope.open_envelopes(wire, keys).select("was", F.col("plain").cast("string").alias("now")).collect()
    assert len(opened) == 300 and all(r.was == r.now for r in opened)


def test_journal_of_a_record_without_id(spark):
    d = pipeline.decide_requests(_log(spark, [("POST", "/update", '{"type":"counter","delta":1}', None), ("POST", "/updates", "[]", None),
                                              ("POST", "/updates", None, None)]), pipeline.EdgeConfig())
    got = {r.request_id: r.metrics for r in journal.journal_items(d, pipeline.EARLY_CHECKS).collect()}
    assert got == {0: [""], 1: []}
