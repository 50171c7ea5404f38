"""Update sources over request logs (A1-A4) and derived request logs.

A request log is a DataFrame/stream of REQUEST_SCHEMA rows. Decoding is
a projection (`from_json`, `regexp_extract`) plus `posexplode_outer` for
batches, so a log of any size is decoded in parallel with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import gzipped, jsonwire
from tallyfold.operators import envelope, routing
from tallyfold.schemas import COUNTER, GAUGE
from tallyfold.sources.tables import event_items

# Injection rules of the derived request logs.
PATH_BAD_TEXT_EVERY = 17     # value text 'none'      -> 400
PATH_BAD_TYPE_EVERY = 19     # type segment 'unknown' -> 400
PATH_NAN_EVERY = 23          # value text 'NaN'       -> /update group, empty body -> 400
PATH_CUT_EVERY = 29          # '/update/{type}/'      -> 404
PATH_PUT_EVERY = 31          # method PUT             -> 405
BATCH_GARBAGE_EVERY = 13     # body with trailing bytes -> 400
BATCH_EMPTY_EVERY = 11       # body '[]'              -> 200, no items
PROTO_BAD_TYPE = 100         # enum value that is neither GAUGE nor COUNTER
# Odd single bodies, the first rule that applies (event_id % n = 0).
ODD_TRAILING = 61            # bytes after the value   -> 400
ODD_NESTED = 67              # an ignored field that holds an `id` of another type
ODD_CASE = 71                # field names in another letter case
ODD_HUGE = 73                # a number beyond the double range -> 400
ODD_NULL = 79                # JSON null: a record without fields -> 500
ODD_MISSING = 83             # no body                 -> 400
ODD_REPEATED = 89            # repeated names, also in an ignored field: the last one counts
# Odd batch bodies, after the two above (request_id % n = 0).
BATCH_NULL_EVERY = 17        # JSON null               -> 200, no items
BATCH_MISSING_EVERY = 19     # no body                 -> 400
BATCH_CASE_EVERY = 23        # other letter case and an ignored nested field
BATCH_HUGE_EVERY = 29        # one more item, with a number beyond the range -> 400


def _headers(ip: F.Column) -> F.Column:
    return F.create_map(F.lit("X-Real-IP"), ip)


def _remote(events_user: F.Column, eid: F.Column) -> F.Column:
    return F.concat(F.lit("192.168.0."), (events_user % 250).cast("string"), F.lit(":"),
                    (F.lit(40000) + eid % 1000).cast("string"))


def _real_ip(events_user: F.Column, eid: F.Column) -> F.Column:
    return F.concat_ws(".", F.lit("10"), (events_user % 4).cast("string"),
                       (eid % 256).cast("string"), (eid % 251).cast("string"))


def event_path_requests(events: DataFrame) -> DataFrame:
    """One path-style update request per event, REQUEST_SCHEMA."""
    eid = F.col("event_id")
    is_counter = (eid % 2) == 0
    seg_type = F.when((eid % PATH_BAD_TYPE_EVERY) == 0, F.lit("unknown")).otherwise(
        F.when(is_counter, F.lit(COUNTER)).otherwise(F.lit(GAUGE)))
    name = F.when(is_counter, F.col("event_type")).otherwise(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    text = (
        F.when((eid % PATH_BAD_TEXT_EVERY) == 0, F.lit("none"))
        .when((eid % PATH_NAN_EVERY) == 0, F.lit("NaN"))
        .when(is_counter, F.get_json_object("props", "$.k"))
        .otherwise(F.format_string("%.2f", F.col("value")))
    )
    path = F.when((eid % PATH_CUT_EVERY) == 0, F.concat(F.lit("/update/"), seg_type, F.lit("/"))) \
        .otherwise(F.concat_ws("/", F.lit("/update"), seg_type, name, text))
    method = F.when((eid % PATH_PUT_EVERY) == 0, F.lit("PUT")).otherwise(F.lit("POST"))
    return events.select(
        eid.alias("request_id"), eid.alias("seq"), "ts", method.alias("method"),
        path.alias("path"), _headers(_real_ip(F.col("user_id"), eid)).alias("headers"),
        F.lit(None).cast("binary").alias("body"),
        _remote(F.col("user_id"), eid).alias("remote_addr"),
    )


def event_json_requests(events: DataFrame) -> DataFrame:
    """One JSON single-update request (`POST /update`) per event."""
    items = event_items(events, framing="single", keep=("user_id",))
    return items.select(
            F.col("seq").alias("request_id"), "seq", "ts", F.lit("POST").alias("method"),
            F.lit("/update").alias("path"),
            _headers(_real_ip(F.col("user_id"), F.col("seq"))).alias("headers"),
            jsonwire.encode_update("id", "type", "delta", "value").cast("binary").alias("body"),
            _remote(F.col("user_id"), F.col("seq")).alias("remote_addr"),
        )


def with_odd_bodies(requests: DataFrame) -> DataFrame:
    """The single bodies with the odd cases of the rules above put in."""
    e, text = F.col("seq"), F.col("body").cast("string")
    renamed = text
    for name in ("id", "type", "delta", "value"):
        renamed = F.replace(renamed, F.lit(f'"{name}":'), F.lit(f'"{name.capitalize()}":'))
    nested = F.concat(F.lit('{"meta":{"id":5,"value":"x"},'), F.substr(text, F.lit(2)))
    # the first id, and a whole nested record, are overruled by what comes after them
    repeated = F.concat(F.lit('{"id":"first","meta":{"a":1,"a":{"a":2,"a":3}},"type":"other",'), F.substr(text, F.lit(2)))
    odd = (F.when(e % ODD_TRAILING == 0, F.concat(text, F.lit(" x")))
           .when(e % ODD_NESTED == 0, nested)
           .when(e % ODD_CASE == 0, renamed)
           .when(e % ODD_HUGE == 0, F.lit('{"id":"huge","type":"gauge","value":1e400}'))
           .when(e % ODD_NULL == 0, F.lit("null"))
           .when(e % ODD_MISSING == 0, F.lit(None).cast("string"))
           .when(e % ODD_REPEATED == 0, repeated)
           .otherwise(text))
    return requests.withColumn("body", odd.cast("binary"))


def event_batch_requests(events: DataFrame) -> DataFrame:
    """One JSON batch request (`POST /updates`) per 20 consecutive events.

    Built with a grouped `collect_list` whose groups are 20 rows by
    construction. Odd bodies follow the rules above.
    """
    items = event_items(events, framing="batch")
    item_json = F.struct("pos", F.struct("id", "type", "delta", "value").alias("m"))
    grouped = items.groupBy("request_id").agg(
        F.array_sort(F.collect_list(item_json)).alias("xs"),
        F.min("seq").alias("seq"),
        F.min("ts").alias("ts"),
    )
    body = F.to_json(F.transform("xs", lambda x: x["m"]))
    rid = F.col("request_id")
    cased = F.to_json(F.transform("xs", lambda x: F.struct(
        F.struct(F.lit(5).alias("id")).alias("meta"), x["m"]["id"].alias("ID"), x["m"]["type"].alias("Type"),
        x["m"]["delta"].alias("DELTA"), x["m"]["value"].alias("vALUE"))))
    huge = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(',{"id":"huge","type":"gauge","value":-1e999}]'))
    body = (F.when((rid % BATCH_GARBAGE_EVERY) == 0, F.concat(body, F.lit(" x")))
            .when((rid % BATCH_EMPTY_EVERY) == 0, F.lit("[]"))
            .when((rid % BATCH_NULL_EVERY) == 0, F.lit("null"))
            .when((rid % BATCH_MISSING_EVERY) == 0, F.lit(None).cast("string"))
            .when((rid % BATCH_CASE_EVERY) == 0, cased)
            .when((rid % BATCH_HUGE_EVERY) == 0, huge)
            .otherwise(body))
    return grouped.select(
        rid.alias("request_id"), "seq", "ts", F.lit("POST").alias("method"),
        F.lit("/updates").alias("path"),
        _headers(_real_ip(rid, F.col("seq"))).alias("headers"),
        body.cast("binary").alias("body"), _remote(rid, F.col("seq")).alias("remote_addr"),
    )


def event_proto_requests(events: DataFrame) -> DataFrame:
    """Decoded protobuf batches: one request per 20 events, enum types
    (GAUGE=0, COUNTER=1, unknown=100), numbers without presence."""
    items = event_items(events, framing="batch")
    enum = F.when(F.col("type") == GAUGE, 0).when(F.col("type") == COUNTER, 1) \
        .otherwise(PROTO_BAD_TYPE)
    m = F.struct("pos", F.struct(F.col("id"), enum.alias("type"), F.col("delta"),
                                 F.col("value")).alias("m"))
    grouped = items.groupBy("request_id").agg(
        F.array_sort(F.collect_list(m)).alias("xs"), F.min("seq").alias("seq"))
    return grouped.select("request_id", "seq",
                          F.transform("xs", lambda x: x["m"]).alias("metrics"))


# ---------------------------------------------------------------- decoders

def path_updates(requests: DataFrame) -> DataFrame:
    """A1: path requests -> update rows with a parse status (400 or NULL)."""
    p = routing.parse_path_update("path")
    return requests.where(F.col("path").rlike(routing.PATH_UPDATE)).select(
        "request_id",
        F.lit(0).alias("pos"),
        "seq", "ts",
        p["id"].alias("id"), p["type"].alias("type"),
        p["delta"].alias("delta"), p["value"].alias("value"),
        p["status"].alias("parse_status"),
    )


def json_updates(requests: DataFrame) -> DataFrame:
    """A2: single JSON bodies -> update rows; `bad` marks a 400 body.

    The record is generator output, so that later filters on its fields
    stay above the decode (see operators/barrier.py)."""
    r = jsonwire.with_single(requests, "body", "_d")
    one = r.select("request_id", "seq", "ts", F.explode_outer(F.array("_d")).alias("u"))
    return one.select("request_id", F.lit(0).alias("pos"), "seq", "ts", "u.id", "u.type", "u.delta", "u.value", "u.bad")


def json_batches(requests: DataFrame) -> DataFrame:
    """A3: JSON array bodies -> one row per item with its position.

    `posexplode_outer` keeps requests with no items (NULL `pos`); a
    malformed body gives one row with `bad` true and no fields.
    """
    decoded = jsonwire.with_batch(requests, "body", "d").select("request_id", "seq", "ts", "d")
    items = F.when(~F.col("d.bad"), F.col("d.items"))
    out = decoded.select(
        "request_id", "seq", "ts", F.col("d.bad").alias("bad"),
        F.posexplode_outer(items).alias("pos", "item"),
    )
    return out.select(
        "request_id", F.col("pos").cast("int").alias("pos"), "seq", "ts",
        F.col("item.id").alias("id"), F.col("item.type").alias("type"),
        F.col("item.delta").alias("delta"), F.col("item.value").alias("value"), "bad",
    )


def proto_updates(proto_requests: DataFrame) -> DataFrame:
    """A4: decoded protobuf batches -> update rows.

    Missing numbers are 0 and a missing type is GAUGE (no presence in the
    wire format); an enum outside GAUGE/COUNTER gives type NULL-less
    'unknown' so validation refuses it.
    """
    x = proto_requests.select("request_id", "seq",
                              F.posexplode_outer("metrics").alias("pos", "m"))
    t = F.coalesce(F.col("m.type"), F.lit(0))
    return x.select(
        "request_id", F.col("pos").cast("int").alias("pos"), "seq",
        F.col("m.id").alias("id"),
        F.when(t == 0, F.lit(GAUGE)).when(t == 1, F.lit(COUNTER))
        .otherwise(F.lit("unknown")).alias("type"),
        F.coalesce(F.col("m.delta"), F.lit(0).cast("bigint")).alias("delta"),
        F.coalesce(F.col("m.value"), F.lit(0.0)).alias("value"),
    )


# Injection rules of the mixed log, by the unit (event or batch number).
SIG_ABSENT_EVERY = 9       # no HashSHA256 header
SIG_WRONG_EVERY = 10       # signature of a different body -> 400
WIRE_CYCLE = 12            # how a body travels, by unit % 12:
WIRE_GZIP = 3              # gzip
WIRE_SEALED = 5            # encrypted
WIRE_SEALED_GZIP = 7       # encrypted, then gzip
WIRE_NOT_GZIP = 9          # gzip header, but no gzip body -> 500
WIRE_TAMPERED = 11         # encrypted, one byte changed   -> 400


def _on_the_wire(df: DataFrame, unit: F.Column, keys: DataFrame) -> DataFrame:
    """Bodies as sent: plain, gzip, encrypted or damaged (missing ones stay)."""
    way = F.when(F.col("body").isNotNull(), unit % WIRE_CYCLE)
    d = df.withColumn("_way", way).join(
        F.broadcast(keys.select(F.col("key_id").alias("_kid"), F.col("data_key").alias("_dk"))),
        F.concat(F.lit("k"), (unit % 2).cast("string")) == F.col("_kid"), "left")
    nonce = F.substr(F.unhex(F.md5(unit.cast("string").cast("binary"))), F.lit(1), F.lit(envelope.NONCE_BYTES))
    sealed = F.when(F.col("_way").isin(WIRE_SEALED, WIRE_SEALED_GZIP, WIRE_TAMPERED),
                    envelope.seal("body", "_dk", "_kid", nonce))
    d = d.withColumn("_sealed", sealed)
    text = F.when(F.col("_way") == WIRE_TAMPERED, envelope.damaged("_sealed")).otherwise(F.col("_sealed")).cast("binary")
    d = d.withColumn("body", F.coalesce(text, F.col("body")))
    packed = gzipped.gzipped(F.when(F.col("_way").isin(WIRE_GZIP, WIRE_SEALED_GZIP), F.col("body")))
    d = d.withColumn("body", F.coalesce(packed, F.col("body")))
    extra = F.map_from_entries(F.filter(F.array(
        F.when(F.col("_way").isin(WIRE_GZIP, WIRE_SEALED_GZIP, WIRE_NOT_GZIP),
               F.struct(F.lit("Content-Encoding"), F.lit("gzip"))),
        F.when(F.col("_way").isin(WIRE_SEALED, WIRE_SEALED_GZIP, WIRE_TAMPERED),
               F.struct(F.lit("X-Encrypted"), F.lit(envelope.HEADER_VALUE)))), lambda x: x.isNotNull()))
    return d.withColumn("headers", F.map_concat("headers", extra)).drop("_way", "_kid", "_dk", "_sealed")


def _signed(df: DataFrame, key: str, unit: F.Column) -> DataFrame:
    """Adds a HashSHA256 header over the body as sent."""
    from tallyfold.functions.hmac import hmac_sha256_hex
    sent = F.coalesce(F.col("body"), F.lit(b""))
    good = hmac_sha256_hex(sent, key)
    wrong = hmac_sha256_hex(F.concat(sent, F.lit(b"x")), key)
    h = (F.when((unit % SIG_ABSENT_EVERY) == 0, F.lit(None))
         .when((unit % SIG_WRONG_EVERY) == 0, wrong).otherwise(good))
    hdrs = F.when(h.isNull(), F.col("headers")).otherwise(
        F.map_concat(F.col("headers"), F.create_map(F.lit("HashSHA256"), h)))
    return df.withColumn("headers", hdrs)


def event_request_log(events: DataFrame, sign_key: str, keys: DataFrame) -> DataFrame:
    """Mixed request log: per event one path update (id 3e) and one JSON
    update (id 3e+1), per 20 events one JSON batch (id 3b+2). JSON bodies
    hold the odd cases, travel plain, gzip or encrypted, and carry a
    HashSHA256 header, all by the injection rules above."""
    p = event_path_requests(events).withColumn("request_id", F.col("request_id") * 3)
    unit = F.col("request_id")
    j = _signed(_on_the_wire(with_odd_bodies(event_json_requests(events)), unit, keys), sign_key, unit)
    b = _signed(_on_the_wire(event_batch_requests(events), unit, keys), sign_key, unit)
    return p.unionByName(j.withColumn("request_id", unit * 3 + 1)).unionByName(b.withColumn("request_id", unit * 3 + 2))
