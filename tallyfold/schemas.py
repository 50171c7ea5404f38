"""Explicit schemas. Nothing is inferred."""

from pyspark.sql import types as T

COUNTER = "counter"
GAUGE = "gauge"

# One metric update. `seq` is the total arrival order (unique, increasing);
# within a batch the order is (request seq, pos).
UPDATE_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("delta", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("hash", T.StringType()),
    ]
)

# The folded state; same columns as the durable metrics table.
STATE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("delta", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# A raw request as logged at the edge.
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.BinaryType()),  # as sent: may be gzip or an envelope
        T.StructField("remote_addr", T.StringType()),
    ]
)

# One audit journal line.
JOURNAL_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.LongType()),
        T.StructField("metrics", T.ArrayType(T.StringType())),
        T.StructField("ip_address", T.StringType()),
    ]
)

# The wire form of one update inside a JSON body (`hash` is decoded, never used).
WIRE_ITEM_DDL = "id STRING, type STRING, delta BIGINT, value DOUBLE, hash STRING"

# Decoded protobuf batch: enum type (GAUGE=0, COUNTER=1), numbers without presence.
PROTO_METRIC_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("delta", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)
PROTO_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("metrics", T.ArrayType(PROTO_METRIC_SCHEMA)),
    ]
)

# Encrypted body envelope.
ENVELOPE_DDL = "alg STRING, k STRING, n STRING, d STRING, v INT"

# Data keys for the envelope (the RSA unwrap is replaced by a key table).
KEY_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("key_id", T.StringType(), False),
        T.StructField("data_key", T.BinaryType(), False),
    ]
)

# Delivery attempts log for the retry operators.
ATTEMPT_SCHEMA = T.StructType(
    [
        T.StructField("delivery_id", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("code", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("sqlstate", T.StringType()),
    ]
)
