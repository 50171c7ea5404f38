"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the whole given tables. The matching DuckDB SQL sits next to each
query in `ORACLE` (omitted only where SQL cannot express the operator).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import hmac as hmac_fn
from tallyfold.functions import netaddr, render
from tallyfold.operators import (agent, envelope, fold, journal, lookup, retry, routing,
                                 security, validate)
from tallyfold.operators.barrier import late_filter
from tallyfold.plans import pipeline
from tallyfold.plans import sqlparts as S
from tallyfold.schemas import KEY_TABLE_SCHEMA, UPDATE_SCHEMA
from tallyfold.session import materialize, path_exists, scratch_path
from tallyfold.sinks import report
from tallyfold.sinks import snapshot as snapshot_sink
from tallyfold.sources import snapshot as snapshot_src
from tallyfold.streaming import fanout, streams, ticks
from tallyfold.sources import requests, tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, sf_dir, name)


# --------------------------------------------------------------------------
# Step 1-2: the state fold and its per-type forms
# --------------------------------------------------------------------------

@register("state_fold", f"""
WITH items AS ({S.event_items_sql('single')})
{S.FOLD_SELECT}
FROM items WHERE {S.VALID} GROUP BY id, type""")
def state_fold(spark, sf_dir):
    items = tables.event_items(_t(spark, sf_dir, "events"), framing="single")
    return fold.fold_state(items)


@register("counter_totals", f"""
WITH u AS ({S.LINEITEM_COUNTERS})
SELECT id, CAST(sum(delta) AS BIGINT) AS delta FROM u GROUP BY id""")
def counter_totals(spark, sf_dir):
    return fold.counter_totals(tables.lineitem_counters(_t(spark, sf_dir, "lineitem")))


@register("gauge_latest", f"""
WITH items AS ({S.event_items_sql('single')})
SELECT id, arg_max(value, seq) AS value FROM items
WHERE type = 'gauge' AND {S.VALID} GROUP BY id""")
def gauge_latest(spark, sf_dir):
    return fold.gauge_latest(tables.event_items(_t(spark, sf_dir, "events"), framing="single"))


@register("state_list", f"""
WITH items AS ({S.event_items_sql('single')}),
st AS ({S.FOLD_SELECT} FROM items WHERE {S.VALID} GROUP BY id, type)
SELECT 'gauge' AS section, name, printf('%f', value) AS value_text FROM st WHERE type = 'gauge'
UNION ALL
SELECT 'counter' AS section, name, CAST(delta AS VARCHAR) AS value_text FROM st WHERE type = 'counter'""")
def state_list(spark, sf_dir):
    return report.state_list(state_fold(spark, sf_dir))


# --------------------------------------------------------------------------
# Step 3: sources over request logs
# --------------------------------------------------------------------------

_PATH_LOG_SQL = """
    SELECT event_id AS request_id, user_id AS uid,
           CASE WHEN event_id % 31 = 0 THEN 'PUT' ELSE 'POST' END AS method,
           CASE WHEN event_id % 19 = 0 THEN 'unknown'
                WHEN event_id % 2 = 0 THEN 'counter' ELSE 'gauge' END AS seg_type,
           CASE WHEN event_id % 2 = 0 THEN event_type
                ELSE 'user_' || CAST(user_id AS VARCHAR) END AS seg_name,
           CASE WHEN event_id % 17 = 0 THEN 'none' WHEN event_id % 23 = 0 THEN 'NaN'
                WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')
                ELSE printf('%.2f', value) END AS seg_text,
           event_id % 29 = 0 AS cut
    FROM events"""

_PATH_PARSED_SQL = f"""
    SELECT request_id, uid, method, cut, seg_type AS type, seg_name AS id, seg_text,
           NOT cut AND regexp_matches(seg_text, '^-?[a-z0-9.]+$') AS is_path_route,
           CASE WHEN seg_type = 'counter' AND regexp_matches(seg_text, '^[+-]?[0-9]+$')
                THEN TRY_CAST(seg_text AS BIGINT) END AS delta,
           CASE WHEN seg_type = 'gauge'
                 AND regexp_matches(seg_text, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')
                THEN TRY_CAST(seg_text AS DOUBLE) END AS value
    FROM ({_PATH_LOG_SQL})"""


@register("path_updates", f"""
SELECT request_id, CAST(0 AS INTEGER) AS pos, id, type, delta, value,
       CASE WHEN type NOT IN ('counter', 'gauge') THEN 400
            WHEN type = 'counter' AND delta IS NULL THEN 400
            WHEN type = 'gauge' AND value IS NULL THEN 400 END AS parse_status
FROM ({_PATH_PARSED_SQL}) WHERE is_path_route""")
def path_updates(spark, sf_dir):
    reqs = requests.event_path_requests(_t(spark, sf_dir, "events"))
    return requests.path_updates(reqs).select(
        "request_id", "pos", "id", "type", "delta", "value", "parse_status")


@register("route_status", f"""
SELECT request_id,
       CASE WHEN is_path_route THEN 'path_update' ELSE 'json_update' END AS route,
       CASE WHEN NOT is_path_route
                 AND NOT regexp_matches('/update/' || type || '/' || id || '/' || seg_text,
                                        '^/update/[a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+/-?[a-zA-Z0-9.]+$')
                 THEN 404
            WHEN NOT is_path_route AND cut THEN 404
            WHEN method <> 'POST' THEN 405
            ELSE 200 END AS status
FROM ({_PATH_PARSED_SQL})""")
def route_status(spark, sf_dir):
    reqs = requests.event_path_requests(_t(spark, sf_dir, "events"))
    kind = routing.route_kind("path")
    status = F.coalesce(routing.route_check_status("path", kind),
                        routing.method_status("method", kind), F.lit(200))
    return reqs.select("request_id", kind.alias("route"), status.alias("status"))


# what an odd single (event e) or batch (request b) body is: the first rule that applies
_J_KIND = """CASE WHEN {e} % 61 = 0 THEN 'bad' WHEN {e} % 67 = 0 OR {e} % 71 = 0 THEN 'ok'
                   WHEN {e} % 73 = 0 THEN 'bad' WHEN {e} % 79 = 0 THEN 'null' WHEN {e} % 83 = 0 THEN 'none'
                   ELSE 'ok' END"""
_B_KIND = """CASE WHEN {b} % 13 = 0 THEN 'bad' WHEN {b} % 11 = 0 OR {b} % 17 = 0 THEN 'empty'
                   WHEN {b} % 19 = 0 THEN 'none' WHEN {b} % 23 = 0 THEN 'ok' WHEN {b} % 29 = 0 THEN 'bad'
                   ELSE 'ok' END"""


@register("json_updates", f"""
SELECT request_id, CASE WHEN kind = 'ok' THEN id END AS id, CASE WHEN kind = 'ok' THEN type END AS type,
       CASE WHEN kind = 'ok' THEN delta END AS delta, CASE WHEN kind = 'ok' THEN value END AS value,
       kind IN ('bad', 'none') AS bad
FROM (SELECT *, {_J_KIND.format(e='seq')} AS kind FROM ({S.event_items_sql('single')}))""")
def json_updates(spark, sf_dir):
    reqs = requests.with_odd_bodies(requests.event_json_requests(_t(spark, sf_dir, "events")))
    return requests.json_updates(reqs).select("request_id", "id", "type", "delta", "value", "bad")


@register("json_batches", f"""
WITH items AS (SELECT *, {_B_KIND.format(b='request_id')} AS kind FROM ({S.event_items_sql('batch')}))
SELECT request_id, pos, id, type, delta, value, FALSE AS bad FROM items WHERE kind = 'ok'
UNION ALL
SELECT DISTINCT request_id, CAST(NULL AS INTEGER), NULL, NULL, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE),
       kind <> 'empty'
FROM items WHERE kind <> 'ok'""")
def json_batches(spark, sf_dir):
    reqs = requests.event_batch_requests(_t(spark, sf_dir, "events"))
    return requests.json_batches(reqs).select(
        "request_id", "pos", "id", "type", "delta", "value", "bad")


@register("proto_updates", f"""
SELECT request_id, pos, id, type, COALESCE(delta, 0) AS delta, COALESCE(value, 0.0) AS value
FROM ({S.event_items_sql('batch')})""")
def proto_updates(spark, sf_dir):
    reqs = requests.event_proto_requests(_t(spark, sf_dir, "events"))
    return requests.proto_updates(reqs).select("request_id", "pos", "id", "type", "delta", "value")


# --------------------------------------------------------------------------
# Step 4: batch prefix, outcomes, running state, quarantine
# --------------------------------------------------------------------------

@register("batch_valid_prefix", f"""
WITH items AS ({S.event_items_sql('batch')}),
f AS (SELECT *, min(CASE WHEN {S.INVALID} THEN pos END) OVER (PARTITION BY request_id) AS first_bad
      FROM items)
SELECT request_id, pos, id, type, delta, value FROM f
WHERE first_bad IS NULL OR pos < first_bad""")
def batch_valid_prefix(spark, sf_dir):
    items = tables.event_items(_t(spark, sf_dir, "events"), framing="batch")
    return validate.accepted_prefix(items).select("request_id", "pos", "id", "type", "delta", "value")


@register("batch_outcomes", f"""
WITH items AS ({S.event_items_sql('batch')}),
g AS (SELECT request_id, count(pos) AS n_items,
             min(CASE WHEN {S.INVALID} THEN pos END) AS first_bad
      FROM items GROUP BY request_id)
SELECT request_id, n_items, CAST(COALESCE(first_bad, n_items) AS BIGINT) AS n_accepted,
       n_items - CAST(COALESCE(first_bad, n_items) AS BIGINT) AS n_dropped, first_bad,
       CASE WHEN first_bad IS NULL THEN 200 ELSE 500 END AS status
FROM g""")
def batch_outcomes(spark, sf_dir):
    items = tables.event_items(_t(spark, sf_dir, "events"), framing="batch")
    return validate.batch_outcomes(items)


@register("running_state", f"""
WITH items AS ({S.event_items_sql('single')}),
v AS (SELECT * FROM items WHERE {S.VALID})
SELECT seq, type, id, delta,
       CAST(sum(delta) OVER (PARTITION BY type, id ORDER BY seq
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total,
       CAST(NULL AS DOUBLE) AS value
FROM v WHERE type = 'counter'
UNION ALL
SELECT seq, type, id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), value FROM v WHERE type = 'gauge'""")
def running_state(spark, sf_dir):
    items = tables.event_items(_t(spark, sf_dir, "events"), framing="single")
    return fold.running_state(items)


@register("update_quarantine", f"""
SELECT seq, id, type, {S.REASON} AS reason
FROM ({S.event_items_sql('single')}) WHERE {S.INVALID}""")
def update_quarantine(spark, sf_dir):
    items = tables.event_items(_t(spark, sf_dir, "events"), framing="single")
    _, bad = validate.split_valid(items)
    return bad.select("seq", "id", "type", "reason")


# --------------------------------------------------------------------------
# Step 5: lookups, snapshots, upsert, restore
# --------------------------------------------------------------------------

SPLIT_TS = "2024-01-16 00:00:00"   # snapshot part: events before this time


def _before_split(ts):
    """Rows of the snapshot part; a NULL time belongs to the rest."""
    return F.coalesce(F.col(ts) < F.lit(SPLIT_TS).cast("timestamp_ntz"), F.lit(False))


def _split_items(spark, sf_dir):
    items = tables.event_items(_t(spark, sf_dir, "events"), framing="single")
    cut = _before_split("ts")
    return items.where(cut), items.where(~cut)


def _lookups(events):
    eid = F.col("event_id")
    is_counter = (eid % 2) == 0
    name = F.when(is_counter, F.col("event_type")).otherwise(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    name = F.when((eid % 7) == 0, F.concat(name, F.lit("_missing"))).otherwise(name)
    return events.select(
        eid.alias("request_id"),
        F.when(is_counter, F.lit("counter")).otherwise(F.lit("gauge")).alias("type"),
        name.alias("id"))


_LOOKUPS_SQL = """
    SELECT event_id AS request_id,
           CASE WHEN event_id % 2 = 0 THEN 'counter' ELSE 'gauge' END AS type,
           CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'user_' || CAST(user_id AS VARCHAR) END
           || CASE WHEN event_id % 7 = 0 THEN '_missing' ELSE '' END AS id
    FROM events"""

_STATE_SQL = f"""
    {S.FOLD_SELECT} FROM ({S.event_items_sql('single')}) WHERE {S.VALID} GROUP BY id, type"""


def _half_state_sql(first: bool) -> str:
    op = "<" if first else ">="
    return f"""
    {S.FOLD_SELECT} FROM ({S.event_items_sql('single')})
    WHERE {S.VALID} AND ts {op} TIMESTAMP '{SPLIT_TS}' GROUP BY id, type"""


@register("metric_lookup", f"""
WITH l AS ({_LOOKUPS_SQL}), st AS ({_STATE_SQL})
SELECT l.request_id, l.type, l.id,
       CASE WHEN l.type = 'counter' THEN st.delta END AS delta,
       CASE WHEN l.type = 'gauge' THEN st.value END AS value
FROM l JOIN st ON l.type = st.type AND l.id = st.name""")
def metric_lookup(spark, sf_dir):
    return lookup.read_found(_lookups(_t(spark, sf_dir, "events")), state_fold(spark, sf_dir))


@register("metric_not_found", f"""
WITH l AS ({_LOOKUPS_SQL}), st AS ({_STATE_SQL})
SELECT l.request_id, l.type, l.id, 404 AS status
FROM l WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.type = l.type AND st.name = l.id)""")
def metric_not_found(spark, sf_dir):
    return lookup.read_missing(_lookups(_t(spark, sf_dir, "events")), state_fold(spark, sf_dir))


@register("apply_updates", _STATE_SQL)
def apply_updates(spark, sf_dir):
    first, rest = _split_items(spark, sf_dir)
    return fold.apply_updates(fold.fold_state(first), rest.where(validate.reject_reason().isNull()))


@register("snapshot_roundtrip", _STATE_SQL)
def snapshot_roundtrip(spark, sf_dir):
    table = scratch_path(spark, "snapshot")
    path = snapshot_sink.write_snapshot(state_fold(spark, sf_dir), table, fmt="json", buckets=1)
    return snapshot_src.read_snapshot_json(spark, path)


@register("upsert_snapshot", f"""
WITH a AS ({_half_state_sql(True)}), b AS ({_half_state_sql(False)})
SELECT * FROM b
UNION ALL
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.name = a.name AND b.type = a.type)""")
def upsert_snapshot(spark, sf_dir):
    first, rest = _split_items(spark, sf_dir)
    table = scratch_path(spark, "state")
    snapshot_sink.write_snapshot(fold.fold_state(first), table)
    snapshot_sink.upsert_snapshot(fold.fold_state(rest), table)
    return snapshot_src.read_state_table(spark, table)


_BROKEN = "user_5"   # records of these names are broken in the stored snapshot


@register("restore_stops", f"""
{S.FOLD_SELECT} FROM ({S.event_items_sql('single')})
WHERE {S.VALID} AND (ts >= TIMESTAMP '{SPLIT_TS}' OR ts IS NULL OR id < '{_BROKEN}') GROUP BY id, type""")
def restore_stops(spark, sf_dir):
    """A snapshot with broken records in the middle: what comes before the
    first of them is restored, then the later updates are applied."""
    first, rest = _split_items(spark, sf_dir)
    state = fold.fold_state(first).withColumn("type", F.when(F.col("name").startswith(_BROKEN), F.lit("broken")).otherwise(F.col("type")))
    path = scratch_path(spark, "broken-snapshot")
    state.withColumnRenamed("name", "id").orderBy("id", "type").write.json(path)
    restored = snapshot_src.read_snapshot_json(spark, path, stop_at_invalid=True)
    return fold.apply_updates(restored, rest.where(validate.reject_reason().isNull()))


@register("reads_as_of", f"""
WITH l AS ({_LOOKUPS_SQL}), v AS (SELECT * FROM ({S.event_items_sql('single')}) WHERE {S.VALID}),
r AS (SELECT seq, type, id, value, CAST(sum(delta) OVER (PARTITION BY type, id ORDER BY seq
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total
      FROM v)
SELECT l.request_id, l.type, l.id, CASE WHEN l.type = 'counter' THEN r.total END AS delta,
       CASE WHEN l.type = 'gauge' THEN r.value END AS value, CASE WHEN r.seq IS NULL THEN 404 ELSE 200 END AS status
FROM l ASOF LEFT JOIN r ON l.type = r.type AND l.id = r.id AND l.request_id >= r.seq""")
def reads_as_of(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    reads = _lookups(events).withColumn("seq", F.col("request_id"))
    return lookup.read_as_of(reads, tables.event_items(events, framing="single"))


@register("restore_state", _STATE_SQL)
def restore_state(spark, sf_dir):
    first, rest = _split_items(spark, sf_dir)
    table = scratch_path(spark, "state")
    snapshot_sink.write_snapshot(fold.fold_state(first), table)
    restored = snapshot_src.read_state_table(spark, table)
    return fold.apply_updates(restored, rest.where(validate.reject_reason().isNull()))


# --------------------------------------------------------------------------
# Step 6: signatures
# --------------------------------------------------------------------------

# The demo signing key of the registered queries.
SIGN_KEY = "tallyfold-signing-key"
_IPAD, _OPAD = hmac_fn.key_pads(SIGN_KEY)


def _hmac_sql(msg_blob: str) -> str:
    return (f"sha256(unhex('{_OPAD.hex()}') || "
            f"unhex(sha256(unhex('{_IPAD.hex()}') || {msg_blob})))")


def _signed_docs(documents):
    did = F.col("doc_id")
    good = hmac_fn.hmac_sha256_hex("text", SIGN_KEY)
    wrong = hmac_fn.hmac_sha256_hex(F.concat(F.col("text"), F.lit("x")), SIGN_KEY)
    h = (F.when((did % 13) == 0, F.lit(None))
         .when((did % 10) == 0, wrong)
         .when((did % 7) == 0, F.upper(good))
         .otherwise(good))
    return documents.select("doc_id", "text", h.alias("hash"))


@register("hmac_sign", f"""
SELECT doc_id, {_hmac_sql('encode(text)')} AS hash FROM documents""")
def hmac_sign(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", hmac_fn.hmac_sha256_hex("text", SIGN_KEY).alias("hash"))


@register("signature_filter", f"""
WITH d AS (
  SELECT doc_id, {_hmac_sql('encode(text)')} AS good,
         CASE WHEN doc_id % 13 = 0 THEN NULL
              WHEN doc_id % 10 = 0 THEN {_hmac_sql("encode(text || 'x')")}
              WHEN doc_id % 7 = 0 THEN upper({_hmac_sql('encode(text)')})
              ELSE {_hmac_sql('encode(text)')} END AS hash
  FROM documents)
SELECT doc_id, CASE WHEN hash IS NULL OR hash = '' THEN 200
                    WHEN lower(hash) = good THEN 200 ELSE 400 END AS status
FROM d""")
def signature_filter(spark, sf_dir):
    docs = _signed_docs(_t(spark, sf_dir, "documents"))
    st = security.signature_status("hash", "text", SIGN_KEY)
    return docs.select("doc_id", F.coalesce(st, F.lit(200)).alias("status"))


# --------------------------------------------------------------------------
# Step 7: trusted subnet and subnet range join
# --------------------------------------------------------------------------

# Configured subnets of the registered queries.
TRUSTED_CIDR = "10.0.0.0/15"
SUBNETS = ["10.0.0.0/16", "10.1.128.0/17", "10.2.0.0/24", "10.3.7.0/24", "10.0.0.0/8", "fd00::/8", "fd00::8000/113",
           "fe80::/10"]
IPV6_EVERY = 5   # every 5th address of the range join, and every 61st client, is fd00::xxxx


def _ipv6_text(eid):
    return F.concat(F.lit("fd00::"), F.lower(F.hex((eid * 7919) % 65536)))


_V6_SQL = "'fd00::' || lower(to_hex((event_id * 7919) % 65536))"


def _client_addresses(events):
    eid = F.col("event_id")
    ip = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 4).cast("string"),
                     (eid % 256).cast("string"), (eid % 251).cast("string"))
    ip = (F.when((eid % 43) == 0, F.lit(""))
          .when((eid % 47) == 0, F.lit("not-an-ip"))
          .when((eid % 53) == 0, F.concat(F.lit("::ffff:"), ip))
          .when((eid % 59) == 0, F.concat(F.lit(" "), ip, F.lit(" ")))
          .when((eid % 61) == 0, _ipv6_text(eid))
          .otherwise(ip))
    return events.select("event_id", ip.alias("ip"))


_ADDR_SQL = """
    SELECT event_id, '10.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR)
           || '.' || CAST(event_id % 251 AS VARCHAR) AS ip
    FROM events"""


def _v4_num_sql(col: str) -> str:
    parts = [f"CAST(string_split({col}, '.')[{i}] AS BIGINT)" for i in range(1, 5)]
    return f"({parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]})"


def _cidr_values_sql(cidrs) -> str:
    rows = []
    for c in cidrs:
        fam, lo, hi, _ = netaddr.cidr_bounds(c)
        if fam == 4:
            rows.append(f"('{c}', {int(lo, 16)}, {int(hi, 16)})")
    return "VALUES " + ", ".join(rows)


_TF, _TLO, _THI, _ = netaddr.cidr_bounds(TRUSTED_CIDR)


@register("trusted_subnet", f"""
WITH a AS (
  SELECT event_id,
         CASE WHEN event_id % 43 = 0 THEN '' WHEN event_id % 47 = 0 THEN 'not-an-ip'
              WHEN event_id % 53 = 0 THEN '::ffff:' || ip
              WHEN event_id % 59 = 0 THEN ' ' || ip || ' '
              WHEN event_id % 61 = 0 THEN {_V6_SQL} ELSE ip END AS ip,
         ip AS v4, event_id % 53 <> 0 AND event_id % 59 <> 0 AND event_id % 61 = 0 AS v6
  FROM ({_ADDR_SQL}))
SELECT event_id, ip,
       CASE WHEN event_id % 43 = 0 OR event_id % 47 = 0 THEN 400
            WHEN v6 THEN 403
            WHEN {_v4_num_sql('v4')} BETWEEN {int(_TLO, 16)} AND {int(_THI, 16)} THEN 200
            ELSE 403 END AS status
FROM a""")
def trusted_subnet(spark, sf_dir):
    addrs = _client_addresses(_t(spark, sf_dir, "events"))
    checked = security.with_subnet_status(addrs, "ip", TRUSTED_CIDR, "st")
    return checked.select("event_id", "ip", F.coalesce("st", F.lit(200)).alias("status"))


@register("subnet_range_join", f"""
WITH a AS ({_ADDR_SQL}), s(cidr, lo, hi) AS ({_cidr_values_sql(SUBNETS)})
SELECT a.event_id, a.ip, s.cidr FROM a JOIN s ON {_v4_num_sql('a.ip')} BETWEEN s.lo AND s.hi
WHERE a.event_id % {IPV6_EVERY} <> 0
UNION ALL
SELECT event_id, {_V6_SQL}, 'fd00::/8' FROM events WHERE event_id % {IPV6_EVERY} = 0
UNION ALL
SELECT event_id, {_V6_SQL}, 'fd00::8000/113' FROM events
WHERE event_id % {IPV6_EVERY} = 0 AND (event_id * 7919) % 65536 >= 32768""")
def subnet_range_join(spark, sf_dir):
    addrs = tables.event_addresses(_t(spark, sf_dir, "events"))
    eid = F.col("event_id")
    addrs = addrs.withColumn("ip", F.when(eid % IPV6_EVERY == 0, _ipv6_text(eid)).otherwise(F.col("ip")))
    return security.addresses_in_subnets(addrs, SUBNETS, "ip").select("event_id", "ip", "cidr")


# --------------------------------------------------------------------------
# Step 8: encrypted and gzip round trips
# --------------------------------------------------------------------------

TAMPER_EVERY = 59   # every 59th envelope has a damaged ciphertext -> 400


def data_keys(spark):
    """Configuration: two 32-byte data keys, derived from fixed labels."""
    import hashlib
    rows = [(f"k{i}", bytearray(hashlib.sha256(f"tallyfold-data-key-{i}".encode()).digest()))
            for i in range(2)]
    return spark.createDataFrame(rows, KEY_TABLE_SCHEMA)


@register("encrypted_roundtrip", f"""
{S.FOLD_SELECT} FROM ({S.event_items_sql('single')})
WHERE {S.VALID} AND seq % {TAMPER_EVERY} <> 0 GROUP BY id, type""")
def encrypted_roundtrip(spark, sf_dir):
    keys = data_keys(spark)
    reqs = requests.event_json_requests(_t(spark, sf_dir, "events"))
    kid = F.concat(F.lit("k"), (F.col("seq") % 2).cast("string"))
    sealed = reqs.withColumn("key_id", kid).join(F.broadcast(keys), "key_id", "left") \
        .withColumn("body", envelope.seal("body", "data_key", "key_id")) \
        .withColumn("x_encrypted", F.lit(envelope.HEADER_VALUE)).drop("data_key", "key_id")
    tampered = F.when((F.col("seq") % TAMPER_EVERY) == 0, envelope.damaged("body")).otherwise(F.col("body"))
    wire = materialize(sealed.withColumn("body", tampered.cast("binary")), "wire")   # what was sent, stored once
    opened = envelope.open_envelopes(wire, keys)
    ok = late_filter(opened, F.col("decrypt_status").isNull()).withColumn("body", F.col("plain"))
    return fold.fold_state(requests.json_updates(ok).where(~F.col("bad")))


@register("gzip_roundtrip", _STATE_SQL)
def gzip_roundtrip(spark, sf_dir):
    items = tables.event_items(_t(spark, sf_dir, "events"), framing="single")
    path = scratch_path(spark, "gzip-updates")
    items.write.mode("errorifexists").option("compression", "gzip").json(path)
    back = spark.read.schema(UPDATE_SCHEMA).json(path)
    return fold.fold_state(back)


# --------------------------------------------------------------------------
# Step 9: request decisions and the ingest pipeline (L1)
# --------------------------------------------------------------------------

EDGE_CIDR = TRUSTED_CIDR
LOG_FILE_ROWS = 250_000   # of a stored request log: the share of one task when it is streamed


def _edge(spark) -> pipeline.EdgeConfig:
    return pipeline.EdgeConfig(trusted_cidr=EDGE_CIDR, sign_key=SIGN_KEY, keys=data_keys(spark))


def request_log_path(spark, sf_dir):
    """The derived request log, written once as a table in the shared
    folder: it plays the part of a stored log, and the cut keeps Catalyst
    from merging the log's own JSON/HMAC generation into every decision
    that reads it."""
    key = (spark.sparkContext.applicationId, sf_dir, "request-log")
    path = _STORED.get(key)
    if path is None or not path_exists(spark, path):
        path = scratch_path(spark, "request-log")
        requests.event_request_log(_t(spark, sf_dir, "events"), SIGN_KEY, data_keys(spark)).write \
            .option("maxRecordsPerFile", LOG_FILE_ROWS).parquet(path)
        _STORED[key] = path
    return path


def _request_log(spark, sf_dir):
    return spark.read.parquet(request_log_path(spark, sf_dir))


# Derived inputs stored once per session and input folder (like stored tables).
_STORED: dict[tuple, str] = {}


def _wire_sql(unit: str) -> str:
    """Signature and transport of a JSON body, by its unit number."""
    return f"""WHEN {unit} % 9 <> 0 AND {unit} % 10 = 0 THEN 400
              WHEN kind <> 'none' AND {unit} % 12 = 9 THEN 500
              WHEN kind <> 'none' AND {unit} % 12 = 11 THEN 400
              WHEN kind IN ('bad', 'none') THEN 400"""


_DECISIONS_SQL = f"""
WITH p AS (SELECT x.*, e.ts FROM ({_PATH_PARSED_SQL}) x JOIN events e ON e.event_id = x.request_id),
j AS (SELECT i.*, e.user_id AS uid, {_J_KIND.format(e='i.seq')} AS kind
      FROM ({S.event_items_sql('single')}) i JOIN events e ON e.event_id = i.seq),
b AS (SELECT request_id AS bid, min(seq) AS seq0, min(ts) AS ts0, {_B_KIND.format(b='request_id')} AS kind,
             min(CASE WHEN {S.INVALID} THEN pos END) AS first_bad, list(id ORDER BY pos) AS names
      FROM ({S.event_items_sql('batch')}) GROUP BY request_id),
checked AS (
  SELECT request_id * 3 AS request_id, 'p' AS source,
         CASE WHEN is_path_route THEN 'path_update' ELSE 'json_update' END AS route,
         CASE WHEN uid % 4 NOT IN (0, 1) THEN 403
              WHEN NOT is_path_route AND cut THEN 404
              WHEN NOT is_path_route THEN 400
              WHEN type NOT IN ('counter', 'gauge') OR (type = 'counter' AND delta IS NULL)
                   OR (type = 'gauge' AND value IS NULL) THEN 400
              WHEN method <> 'POST' THEN 405 END AS early,
         FALSE AS invalid, request_id AS seq, id, type, delta, value, CAST(NULL AS INTEGER) AS first_bad,
         method, CASE WHEN cut THEN '/update/' || type || '/'
                      ELSE '/update/' || type || '/' || id || '/' || seg_text END AS uri,
         ts, [id] AS names, uid AS client
  FROM p
  UNION ALL
  SELECT request_id * 3 + 1, 'j', 'json_update',
         CASE WHEN uid % 4 NOT IN (0, 1) THEN 403 {_wire_sql('request_id')} END,
         kind = 'null' OR NOT {S.VALID}, seq, id, type, delta, value, NULL, 'POST', '/update',
         ts, [CASE WHEN kind = 'null' THEN '' ELSE id END], uid
  FROM j
  UNION ALL
  SELECT bid * 3 + 2, 'b', 'json_batch',
         CASE WHEN bid % 4 NOT IN (0, 1) THEN 403 {_wire_sql('bid')} END,
         kind = 'ok' AND first_bad IS NOT NULL, seq0, NULL, NULL, NULL, NULL, first_bad, 'POST', '/updates',
         ts0, CASE WHEN kind = 'empty' THEN CAST([] AS VARCHAR[]) ELSE names END, bid
  FROM b),
dec AS (SELECT *, COALESCE(early, CASE WHEN invalid THEN 500 ELSE 200 END) AS status FROM checked)"""


@register("request_decisions", _DECISIONS_SQL + """
SELECT request_id, route, status FROM dec""")
def request_decisions(spark, sf_dir):
    d = pipeline.decide_requests(_request_log(spark, sf_dir), _edge(spark))
    return d.select("request_id", "route", "status")


@register("ingest_pipeline", _DECISIONS_SQL + f""",
acc AS (
  SELECT id, type, delta, value, CAST(seq AS HUGEINT) * 2147483648 AS k FROM dec
  WHERE source IN ('p', 'j') AND status = 200
  UNION ALL
  SELECT i.id, i.type, i.delta, i.value, CAST(d.seq AS HUGEINT) * 2147483648 + i.pos
  FROM dec d JOIN ({S.event_items_sql('batch')}) i ON i.request_id * 3 + 2 = d.request_id
  WHERE d.source = 'b' AND d.early IS NULL AND len(d.names) > 0 AND (d.first_bad IS NULL OR i.pos < d.first_bad))
SELECT id AS name, type,
       CAST(sum(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
       arg_max(CASE WHEN type = 'gauge' THEN value END, CASE WHEN type = 'gauge' THEN k END) AS value
FROM acc GROUP BY id, type""")
def ingest_pipeline(spark, sf_dir):
    return pipeline.ingest(_request_log(spark, sf_dir), _edge(spark))


# --------------------------------------------------------------------------
# Step 10: agent samples, polls, reports
# --------------------------------------------------------------------------

POLL_EVERY = "1 hour"     # events span 30 days: hourly polls, daily reports
REPORT_EVERY = "1 day"
LINEITEM_FIELDS = {"Quantity": "l_quantity", "ExtendedPrice": "l_extendedprice",
                   "Discount": "l_discount", "Tax": "l_tax"}


def _host_samples(events):
    """Host samples: host = user, gauge id = event type, seq = event id."""
    return events.select(F.col("user_id").alias("host"), "ts", F.col("event_id").alias("seq"),
                         F.col("event_type").alias("id"), "value")


@register("host_unpivot", """
UNPIVOT (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS Quantity,
                CAST(l_extendedprice AS DOUBLE) AS ExtendedPrice,
                CAST(l_discount AS DOUBLE) AS Discount, CAST(l_tax AS DOUBLE) AS Tax
         FROM lineitem)
ON Quantity, ExtendedPrice, Discount, Tax INTO NAME id VALUE value""")
def host_unpivot(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    ext = {name: F.col(col) for name, col in LINEITEM_FIELDS.items()}
    return agent.unpivot_gauges(li, ["l_orderkey", "l_linenumber"], ext).drop("type")


@register("cpu_explode", """
SELECT vec_id AS sample_id, 'TotalMemory' AS id, CAST(1024 * len(embedding) AS DOUBLE) AS value
FROM embeddings
UNION ALL
SELECT vec_id, 'FreeMemory', CAST(label AS DOUBLE) FROM embeddings
UNION ALL
SELECT sample_id, 'CPUutilization' || CAST(i AS VARCHAR), CAST(u AS DOUBLE) FROM (
  SELECT vec_id AS sample_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS u
  FROM embeddings)""")
def cpu_explode(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        (F.lit(1024) * F.size("embedding")).alias("TotalMemory"),
        F.col("label").alias("FreeMemory"), F.col("embedding").alias("cpu"))
    return agent.system_gauges(emb, ["sample_id"]).drop("type")


@register("agent_buffer", """
SELECT host, id, type, delta, value FROM (
  SELECT user_id AS host, event_type AS id,
         CASE WHEN event_id % 2 = 0 THEN 'counter' ELSE 'gauge' END AS type,
         CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS delta,
         CASE WHEN event_id % 2 = 1 THEN value END AS value,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def agent_buffer(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    even = (F.col("event_id") % 2) == 0
    s = ev.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"),
                  F.col("event_type").alias("id"),
                  F.when(even, F.lit("counter")).otherwise(F.lit("gauge")).alias("type"),
                  F.when(even, tables.props_k()).alias("delta"),
                  F.when(~even, F.col("value")).alias("value"))
    return agent.agent_buffer(s)


@register("poll_sampling", """
SELECT user_id AS host, date_trunc('hour', ts) AS window_start, event_type AS id,
       arg_max(value, event_id) AS value
FROM events GROUP BY ALL""")
def poll_sampling(spark, sf_dir):
    return agent.poll_sampling(_host_samples(_t(spark, sf_dir, "events")), POLL_EVERY)


_REPORT_SQL = """
SELECT user_id AS host, date_trunc('day', ts) AS window_start, event_type AS id, 'gauge' AS type,
       CAST(NULL AS BIGINT) AS delta, arg_max(value, event_id) AS value
FROM events GROUP BY ALL
UNION ALL
SELECT user_id, date_trunc('day', ts), 'PollCount', 'counter', count(*), CAST(NULL AS DOUBLE)
FROM events GROUP BY ALL"""


@register("report_windows", _REPORT_SQL)
def report_windows(spark, sf_dir):
    return agent.report_windows(_host_samples(_t(spark, sf_dir, "events")), REPORT_EVERY)


_CARRY_SQL = """
WITH d AS (SELECT user_id AS host, event_type AS id, date_trunc('day', ts) AS day,
                  arg_max(value, event_id) AS value FROM events GROUP BY ALL),
f AS (SELECT host, id, min(day) AS first_day FROM d GROUP BY ALL),
m AS (SELECT max(day) AS last_day FROM d),
g AS (SELECT f.host, f.id, unnest(generate_series(f.first_day, m.last_day, INTERVAL 1 DAY)) AS day
      FROM f, m)
SELECT g.host, g.id, g.day + INTERVAL 1 DAY AS tick,
       last_value(d.value IGNORE NULLS) OVER (PARTITION BY g.host, g.id ORDER BY g.day
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM g LEFT JOIN d ON d.host = g.host AND d.id = g.id AND d.day = g.day"""


@register("report_carry_forward", _CARRY_SQL)
def report_carry_forward(spark, sf_dir):
    return agent.carry_forward(_host_samples(_t(spark, sf_dir, "events")), REPORT_EVERY)


@register("report_envelopes", f"""
SELECT host, window_start, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids,
       round(sum(COALESCE(value, 0)), 4) AS total, sum(COALESCE(delta, 0)) AS polls
FROM ({_REPORT_SQL}) GROUP BY host, window_start""")
def report_envelopes(spark, sf_dir):
    rep = agent.report_windows(_host_samples(_t(spark, sf_dir, "events")), REPORT_EVERY)
    env = agent.report_envelopes(rep, ["host", "window_start"])
    parsed = F.from_json("body", "array<struct<id:string,type:string,delta:bigint,value:double>>")
    return env.select(
        "host", "window_start", "n_items",
        F.array_join(F.transform(parsed, lambda x: x["id"]), ",").alias("ids"),
        F.round(F.aggregate(parsed, F.lit(0.0), lambda a, x: a + F.coalesce(x["value"], F.lit(0.0))),
                4).alias("total"),
        F.aggregate(parsed, F.lit(0).cast("bigint"),
                    lambda a, x: a + F.coalesce(x["delta"], F.lit(0).cast("bigint"))).alias("polls"))


@register("report_single_envelopes", f"""
SELECT host, window_start, id, type, delta, value FROM ({_REPORT_SQL})""")
def report_single_envelopes(spark, sf_dir):
    rep = agent.report_windows(_host_samples(_t(spark, sf_dir, "events")), REPORT_EVERY)
    parsed = F.from_json("body", "struct<id:string,type:string,delta:bigint,value:double>")
    return agent.single_envelopes(rep).select("host", "window_start", parsed.alias("m")).select(
        "host", "window_start", "m.id", "m.type", "m.delta", "m.value")


@register("reader_union", """
SELECT vec_id AS sample_id, 'TotalMemory' AS id, 'gauge' AS type, CAST(NULL AS BIGINT) AS delta,
       CAST(1024 * len(embedding) AS DOUBLE) AS value FROM embeddings
UNION ALL
SELECT vec_id, 'FreeMemory', 'gauge', NULL, CAST(label AS DOUBLE) FROM embeddings
UNION ALL
SELECT sample_id, 'CPUutilization' || CAST(i AS VARCHAR), 'gauge', NULL, CAST(u AS DOUBLE) FROM (
  SELECT vec_id AS sample_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS u FROM embeddings)
UNION ALL
SELECT vec_id, 'PollCount', 'counter', 1, NULL FROM embeddings
UNION ALL
SELECT vec_id, 'RandomValue', 'gauge', NULL, NULL FROM embeddings""")
def reader_union(spark, sf_dir):
    emb = _t(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), (F.lit(1024) * F.size("embedding")).alias("TotalMemory"),
        F.col("label").alias("FreeMemory"), F.col("embedding").alias("cpu"))
    rows = agent.all_readers(agent.system_gauges(emb, ["sample_id"]), agent.self_metrics(emb, ["sample_id"]))
    value = F.when(F.col("id") != agent.RANDOM_VALUE, F.col("value"))   # random by definition: not compared
    return rows.select("sample_id", "id", "type", "delta", value.alias("value"))


# --------------------------------------------------------------------------
# Step 11: audit journal, fan-out, access log
# --------------------------------------------------------------------------

_JOURNAL_SQL = _DECISIONS_SQL + """
SELECT request_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, names AS metrics,
       '192.168.0.' || CAST(client % 250 AS VARCHAR) AS ip_address
FROM dec WHERE early IS NULL AND (source <> 'b' OR status = 200)"""


def _decided(spark, sf_dir):
    return pipeline.decide_requests(_request_log(spark, sf_dir), _edge(spark))


def _journal(spark, sf_dir):
    return journal.journal_items(_decided(spark, sf_dir), pipeline.EARLY_CHECKS)


@register("audit_journal", _JOURNAL_SQL)
def audit_journal(spark, sf_dir):
    return _journal(spark, sf_dir)


@register("audit_fanout", f"""
SELECT s.sink, j.ts, j.metrics, j.ip_address
FROM ({_JOURNAL_SQL}) j, (VALUES (0), (1)) s(sink)""")
def audit_fanout(spark, sf_dir):
    """Three deliveries (path updates, JSON requests, nothing) into the same
    sinks, of which one fails and one is not configured."""
    items = materialize(_journal(spark, sf_dir), "journal-items")
    sinks = [scratch_path(spark, "journal-a"), scratch_path(spark, "journal-b"), "nosuchfs://sink/journal", None]
    by_path = F.col("request_id") % 3 == 0
    for name, part in (("paths", by_path), ("json", ~by_path), ("nothing", F.lit(False))):
        out = journal.fan_out(items.where(part), sinks, name)
        if out.written != (True, True, False, False) or out.errors[2] is None:
            raise RuntimeError(f"delivery {name}: {out}")
    parts = [snapshot_src.read_journal(spark, p).withColumn("sink", F.lit(i))
             for i, p in enumerate(sinks[:2])]
    return parts[0].unionByName(parts[1]).select("sink", "ts", "metrics", "ip_address")


@register("access_log", _DECISIONS_SQL + """
SELECT request_id, method, uri, status FROM dec""")
def access_log(spark, sf_dir):
    return journal.access_log(_decided(spark, sf_dir))


# --------------------------------------------------------------------------
# Step 12: retry classification and plan
# --------------------------------------------------------------------------

_ATTEMPTS_SQL = f"""
    SELECT event_id // 4 AS delivery_id, CAST(event_id % 4 + 1 AS INTEGER) AS attempt,
           event_type = 'purchase' AS ok,
           CASE WHEN k < 20 THEN 503 WHEN k < 40 THEN 429 WHEN k < 60 THEN 400 ELSE 0 END AS code,
           CASE WHEN event_type = 'error' THEN 'connection refused' END AS message,
           ['08000', '08003', '08006', '40000', '40001', '40P01', '57P03', '23505'][k % 8 + 1] AS sqlstate
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

_RETRIABLE_SQL = """CASE WHEN ok THEN FALSE
         ELSE (COALESCE(message, '') LIKE '%connection refused%' OR COALESCE(message, '') LIKE '%no such host%'
               OR COALESCE(message, '') LIKE '%timeout%' OR COALESCE(message, '') LIKE '%connection reset%'
               OR COALESCE(message, '') LIKE '%network is unreachable%' OR COALESCE(message, '') LIKE '%EOF%'
               OR COALESCE(code BETWEEN 500 AND 599 OR code IN (408, 429), FALSE)) END"""


@register("retry_classification", f"""
SELECT delivery_id, attempt, {_RETRIABLE_SQL} AS retriable,
       COALESCE(sqlstate IN ('08000', '08003', '08006', '40000', '40001', '40P01', '57P03'), FALSE)
         AS db_retriable
FROM ({_ATTEMPTS_SQL})""")
def retry_classification(spark, sf_dir):
    a = tables.event_attempts(_t(spark, sf_dir, "events"))
    return a.select("delivery_id", "attempt", retry.sender_retriable().alias("retriable"),
                    retry.db_retriable().alias("db_retriable"))


@register("retry_plan", f"""
WITH a AS (SELECT delivery_id, attempt, ok, {_RETRIABLE_SQL} AS rt FROM ({_ATTEMPTS_SQL})),
g AS (SELECT delivery_id,
        bool_or(ok) FILTER (WHERE attempt = 1) AS ok1, bool_or(rt) FILTER (WHERE attempt = 1) AS rt1,
        bool_or(ok) FILTER (WHERE attempt = 2) AS ok2, bool_or(rt) FILTER (WHERE attempt = 2) AS rt2,
        bool_or(ok) FILTER (WHERE attempt = 3) AS ok3, bool_or(rt) FILTER (WHERE attempt = 3) AS rt3
      FROM a GROUP BY delivery_id),
m AS (SELECT *, CASE WHEN COALESCE(ok1, FALSE) OR NOT COALESCE(rt1, TRUE) THEN 1
                     WHEN COALESCE(ok2, FALSE) OR NOT COALESCE(rt2, TRUE) THEN 2 ELSE 3 END AS attempts
      FROM g)
SELECT delivery_id, CAST(attempts AS INTEGER) AS attempts,
       CASE attempts WHEN 1 THEN COALESCE(ok1, FALSE) WHEN 2 THEN COALESCE(ok2, FALSE)
                     ELSE COALESCE(ok3, FALSE) END AS delivered,
       CAST((CASE WHEN NOT COALESCE(ok1, FALSE) AND COALESCE(rt1, FALSE) THEN 1 ELSE 0 END)
          + (CASE WHEN attempts >= 2 AND NOT COALESCE(ok2, FALSE) AND COALESCE(rt2, FALSE) THEN 3 ELSE 0 END)
          + (CASE WHEN attempts >= 3 AND NOT COALESCE(ok3, FALSE) AND COALESCE(rt3, FALSE) THEN 5 ELSE 0 END)
          AS INTEGER) AS wait_s
FROM m""")
def retry_plan(spark, sf_dir):
    return retry.retry_plan(tables.event_attempts(_t(spark, sf_dir, "events")))


# --------------------------------------------------------------------------
# Step 14: rendering of reads
# --------------------------------------------------------------------------

@register("render_plain", f"""
SELECT name, type, CASE WHEN type = 'counter' THEN CAST(delta AS VARCHAR)
                        ELSE regexp_replace(CAST(value AS VARCHAR), '[.]0$', '') END AS text
FROM ({_STATE_SQL})""")
def render_plain(spark, sf_dir):
    st = state_fold(spark, sf_dir)
    return st.select("name", "type", report.plain_value().alias("text"))


@register("render_float_range", """
WITH v AS (SELECT event_id, rtrim(CAST(event_id % 9999 + 1 AS VARCHAR), '0') AS d,
                  len(CAST(event_id % 9999 + 1 AS VARCHAR)) - 1 + event_id % 31 - 12 AS x FROM events)
SELECT event_id,
       CASE WHEN x < -4 OR x >= 6
            THEN d[1] || CASE WHEN len(d) > 1 THEN '.' || d[2:] ELSE '' END
                 || CASE WHEN x < 0 THEN 'e-' ELSE 'e+' END || lpad(CAST(abs(x) AS VARCHAR), 2, '0')
            WHEN x < 0 THEN '0.' || repeat('0', -x - 1) || d
            WHEN x + 1 >= len(d) THEN d || repeat('0', x + 1 - len(d))
            ELSE d[1:x + 1] || '.' || d[x + 2:] END AS text
FROM v""")
def render_float_range(spark, sf_dir):
    """Gauge texts over 34 powers of ten: m * 10^k with m = 1..9999."""
    eid = F.col("event_id")
    number = F.concat((eid % 9999 + 1).cast("string"), F.lit("e"), (eid % 31 - 12).cast("string")).cast("double")
    return _t(spark, sf_dir, "events").select("event_id", render.float_shortest(number).alias("text"))


@register("path_records", f"""
SELECT name, type, '/update/' || type || '/' || name || '/' || CASE WHEN type = 'counter'
       THEN CAST(delta AS VARCHAR) ELSE printf('%f', value) END AS record
FROM ({_STATE_SQL})""")
def path_records(spark, sf_dir):
    st = state_fold(spark, sf_dir).withColumnRenamed("name", "id")
    return st.select(F.col("id").alias("name"), "type", report.path_record().alias("record"))


@register("outgoing_checks", f"""
SELECT seq, CASE WHEN type = 'counter' AND delta IS NULL THEN 'missing required field: delta'
                 WHEN type = 'gauge' AND value IS NULL THEN 'missing required field: value'
                 WHEN type NOT IN ('counter', 'gauge') THEN 'unsupported metric type: ' || type END AS reason
FROM ({S.event_items_sql('single')})""")
def outgoing_checks(spark, sf_dir):
    items = tables.event_items(_t(spark, sf_dir, "events"), framing="single")
    return items.select("seq", validate.outgoing_reason().alias("reason"))


_JSON_BODY_SQL = """'{"id":"' || name || '","type":"' || type || '",'
    || CASE WHEN type = 'counter' THEN '"delta":' || CAST(delta AS VARCHAR)
            ELSE '"value":' || CAST(value AS VARCHAR) END || '}'"""


@register("render_json", f"""
SELECT name, body, {_hmac_sql('encode(body)')} AS sig FROM (
  SELECT name, {_JSON_BODY_SQL} AS body FROM ({_STATE_SQL}))""")
def render_json(spark, sf_dir):
    st = state_fold(spark, sf_dir)
    body = report.json_value("name", "type", "delta", "value")
    out = st.select("name", body.alias("body"))
    return out.withColumn("sig", hmac_fn.sign_response("body", SIGN_KEY))


# --------------------------------------------------------------------------
# Step 13: streaming forms (availableNow, several micro-batches)
# --------------------------------------------------------------------------

FILES_PER_TRIGGER = 4   # of at most a million rows: a micro-batch stays bounded at any size


def _event_stream(spark, sf_dir, name, where=None):
    ev = _t(spark, sf_dir, "events")
    if where is not None:
        ev = ev.where(where)
    return streams.file_stream(spark, streams.staged_copy(ev, name), ev.schema, max_files=FILES_PER_TRIGGER)


def _log_stream(spark, sf_dir):
    """The stored request log as a stream. A micro-batch is bounded by files
    for each core, so that all cores have work, and takes at most a quarter
    of a log that has more than a few files."""
    log = _request_log(spark, sf_dir)
    per_core = FILES_PER_TRIGGER * spark.sparkContext.defaultParallelism
    files = max(FILES_PER_TRIGGER, min(per_core, len(log.inputFiles()) // 4))
    return streams.file_stream(spark, request_log_path(spark, sf_dir), log.schema, max_files=files)


@register("stream_state_fold", _STATE_SQL)
def stream_state_fold(spark, sf_dir):
    src = _event_stream(spark, sf_dir, "stream-events")
    table, ckpt = scratch_path(spark, "stream-state"), scratch_path(spark, "ckpt")
    streams.run_to_end(streams.stream_fold(tables.event_items(src, framing="single"), table, ckpt))
    return streams.read_change_log(spark, table, ["name", "type"])


@register("stream_snapshot", _STATE_SQL)
def stream_snapshot(spark, sf_dir):
    first, _ = _split_items(spark, sf_dir)
    base_dir = scratch_path(spark, "restored")
    snapshot_sink.write_snapshot(fold.fold_state(first), base_dir)
    base = snapshot_src.read_state_table(spark, base_dir)
    src = _event_stream(spark, sf_dir, "stream-rest", where=~_before_split("ts"))
    table, ckpt = scratch_path(spark, "stream-snap"), scratch_path(spark, "ckpt")
    q = streams.stream_fold(tables.event_items(src, framing="single"), table, ckpt,
                            base=base, fmt="json", snapshots=True)
    streams.run_to_end(q)
    return snapshot_src.read_state_table(spark, table, "json")


@register("stream_report_windows", _REPORT_SQL)
def stream_report_windows(spark, sf_dir):
    # the files come in no order, so a row can be as late as the table's span; nothing is dropped then
    lateness = streams.lateness_of(streams.time_span(_t(spark, sf_dir, "events"), "ts"))
    src = _event_stream(spark, sf_dir, "stream-samples")
    table, ckpt = scratch_path(spark, "stream-reports"), scratch_path(spark, "ckpt")
    with ticks.LateRows(spark) as late:
        streams.run_to_end(streams.stream_report_windows(_host_samples(src), REPORT_EVERY, lateness, table, ckpt))
    if late.rows:
        raise RuntimeError("rows were dropped as late")
    return agent.report_rows(streams.read_change_log(spark, table, ["host", "window_start", "id"]))


STREAM_SLICES = 4   # time slices that arrive one after the other; a run takes two, so the second run restarts


def _run_ticks(spark, sf_dir, start, every, name):
    """Events as time slices through `start(samples, every, lateness, out,
    checkpoint)` in two runs over one checkpoint, then a heartbeat that
    finishes the last tick; the written rows."""
    ev = _t(spark, sf_dir, "events")
    span = streams.time_span(ev, "ts")
    lateness = streams.lateness_of(span, STREAM_SLICES)
    path, out, ckpt = (scratch_path(spark, n) for n in (f"{name}-events", name, "ckpt"))
    with ticks.LateRows(spark) as late:
        for number, _ in enumerate(streams.staged_slices(ev, path, "ts", span, STREAM_SLICES), 1):
            if number == STREAM_SLICES and span:
                end = ticks.last_tick(span[1], ticks.interval_of(spark, every))
                ticks.heartbeat(spark, path, ev.schema, "ts", end + ticks.interval_of(spark, lateness))
            if number % 2 == 0:
                stream = streams.file_stream(spark, path, ev.schema, max_files=FILES_PER_TRIGGER)
                streams.run_to_end(start(_host_samples(stream), every, lateness, out, ckpt))
    if late.rows:
        raise RuntimeError("rows were dropped as late")
    return spark.read.parquet(out)


@register("stream_poll_sampling", """
SELECT user_id AS host, date_trunc('hour', ts) AS window_start, event_type AS id,
       arg_max(value, event_id) AS value
FROM events GROUP BY ALL""")
def stream_poll_sampling(spark, sf_dir):
    return _run_ticks(spark, sf_dir, ticks.stream_poll_sampling, POLL_EVERY, "stream-polls")


@register("stream_reports", f"""
WITH n AS (SELECT user_id AS host, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL),
h AS (SELECT host, min(day) AS first_day FROM n GROUP BY host),
t AS (SELECT h.host, unnest(generate_series(h.first_day, m.last_day, INTERVAL 1 DAY)) AS day
      FROM h, (SELECT max(day) AS last_day FROM n) m)
SELECT host, tick, id, 'gauge' AS type, CAST(NULL AS BIGINT) AS delta, value FROM ({_CARRY_SQL})
UNION ALL
SELECT t.host, t.day + INTERVAL 1 DAY, 'PollCount', 'counter', CAST(COALESCE(n.n, 0) AS BIGINT), CAST(NULL AS DOUBLE)
FROM t LEFT JOIN n ON n.host = t.host AND n.day = t.day""")
def stream_reports(spark, sf_dir):
    return _run_ticks(spark, sf_dir, ticks.stream_reports, REPORT_EVERY, "stream-ticks")


@register("stream_journal", f"SELECT ts, metrics, ip_address FROM ({_JOURNAL_SQL})")
def stream_journal(spark, sf_dir):
    items = journal.journal_items(pipeline.decide_requests(_log_stream(spark, sf_dir), _edge(spark)), pipeline.EARLY_CHECKS)
    out, ckpt = scratch_path(spark, "stream-journal"), scratch_path(spark, "ckpt")
    streams.run_to_end(streams.stream_journal(items, out, ckpt))
    return snapshot_src.read_journal(spark, out)


@register("stream_fanout", f"""
SELECT 'item' AS kind, request_id, CAST(NULL AS VARCHAR) AS sink, ts, metrics, ip_address, CAST(2 AS BIGINT) AS taken,
       TRUE AS delivered FROM ({_JOURNAL_SQL})
UNION ALL
SELECT 'line', CAST(NULL AS BIGINT), s.sink, j.ts, j.metrics, j.ip_address, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN)
FROM ({_JOURNAL_SQL}) j, (VALUES ('a'), ('b')) s(sink)""")
def stream_fanout(spark, sf_dir):
    """The live journal into two sinks beside one that fails and one that is
    not configured: the lines of each sink, and every item's outcome."""
    items = journal.journal_items(pipeline.decide_requests(_log_stream(spark, sf_dir), _edge(spark)), pipeline.EARLY_CHECKS)
    sinks = {"a": scratch_path(spark, "live-a"), "b": scratch_path(spark, "live-b"), "down": "nosuchfs://sink/journal", "off": None}
    ledger, ckpt = scratch_path(spark, "ledger"), scratch_path(spark, "ckpt")
    streams.run_to_end(fanout.stream_fan_out(items, sinks, ledger, ckpt))
    out = fanout.item_outcomes(spark, ledger, items.schema).drop("run", "batch").withColumn("kind", F.lit("item"))
    for name in ("a", "b"):
        lines = snapshot_src.read_journal(spark, sinks[name]).withColumns({"kind": F.lit("line"), "sink": F.lit(name)})
        out = out.unionByName(lines, allowMissingColumns=True)
    return out


# --------------------------------------------------------------------------
# L2: reads through the decision chain (JSON and path routes)
# --------------------------------------------------------------------------

def _read_requests(events):
    """One read per event: JSON `POST /value` for even ids, `GET /value/..`
    for odd ids; every 7th asks for a key that does not exist."""
    lk = _lookups(events)
    even = (F.col("request_id") % 2) == 0
    return lk.select(
        "request_id", F.col("request_id").alias("seq"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.when(even, F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        F.when(even, F.lit("/value")).otherwise(
            F.concat_ws("/", F.lit("/value"), "type", "id")).alias("path"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.when(even, F.to_json(F.struct("id", "type"))).cast("binary").alias("body"),
        F.lit("127.0.0.1:5000").alias("remote_addr"))


@register("read_requests", f"""
WITH l AS ({_LOOKUPS_SQL}), st AS ({_STATE_SQL})
SELECT l.request_id,
       CASE WHEN l.request_id % 2 = 0 THEN 'json_value' ELSE 'path_value' END AS route,
       CASE WHEN st.name IS NULL THEN 404 ELSE 200 END AS status,
       CASE WHEN st.name IS NULL THEN NULL
            WHEN l.type = 'counter' THEN CAST(st.delta AS VARCHAR)
            ELSE regexp_replace(CAST(st.value AS VARCHAR), '[.]0$', '') END AS text
FROM l LEFT JOIN st ON st.type = l.type AND st.name = l.id""")
def read_requests(spark, sf_dir):
    reads = _read_requests(_t(spark, sf_dir, "events"))
    # each key is rendered once, before the join with the reads
    state = state_fold(spark, sf_dir).withColumn("text", report.plain_value())
    d = pipeline.decide_requests(reads, pipeline.EdgeConfig(), state=state)
    return d.select("request_id", "route", "status", F.when(F.col("status") == 200, F.col("found_text")).alias("text"))


@register("stream_reads", f"""
WITH l AS ({_LOOKUPS_SQL}), a AS ({_half_state_sql(True)}), b AS ({_STATE_SQL}),
e AS (SELECT event_id, ts < TIMESTAMP '{SPLIT_TS}' AS early FROM events)
SELECT l.request_id, l.type, l.id, CASE WHEN early THEN a.delta ELSE b.delta END AS delta,
       CASE WHEN early THEN a.value ELSE b.value END AS value,
       CASE WHEN CASE WHEN early THEN a.name ELSE b.name END IS NULL THEN 404 ELSE 200 END AS status
FROM l JOIN e ON e.event_id = l.request_id
LEFT JOIN a ON a.type = l.type AND a.name = l.id LEFT JOIN b ON b.type = l.type AND b.name = l.id""")
def stream_reads(spark, sf_dir):
    """Updates and reads as two streams in turn: the first reads see what
    the first updates left, the later reads all of them."""
    ev = _t(spark, sf_dir, "events")
    updates, reads, table, out, ckpt, read_ckpt = (
        scratch_path(spark, n) for n in ("live-updates", "live-reads", "live-state", "live-answers", "ckpt", "ckpt"))
    cut = _before_split("ts")
    for part in (ev.where(cut), ev.where(~cut)):
        for path in (updates, reads):
            part.write.mode("append").option("maxRecordsPerFile", streams.MAX_FILE_ROWS).parquet(path)
        src = streams.file_stream(spark, updates, ev.schema, max_files=FILES_PER_TRIGGER)
        streams.run_to_end(streams.stream_fold(tables.event_items(src, framing="single"), table, ckpt))
        asked = _lookups(streams.file_stream(spark, reads, ev.schema, max_files=FILES_PER_TRIGGER))
        streams.run_to_end(streams.stream_reads(asked, table, out, read_ckpt))
    return streams.read_answers(spark, out).drop("version")


@register("stream_carry_forward", """
SELECT user_id AS host, event_type AS id, arg_max(value, event_id) AS value
FROM events GROUP BY ALL""")
def stream_carry_forward(spark, sf_dir):
    src = _event_stream(spark, sf_dir, "stream-buffer")
    out, ckpt = scratch_path(spark, "stream-ticks"), scratch_path(spark, "ckpt")
    streams.run_to_end(streams.stream_carry_forward(_host_samples(src), out, ckpt))
    return streams.read_tick(spark, out).select("host", "id", "value")
