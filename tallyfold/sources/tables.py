"""Metric inputs derived from the given tables (deterministic rules).

Every rule is a projection (no sampling, no caps), so the metric data
grows with the tables. `events.event_id` is unique and in time order,
so it serves as the arrival order `seq`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.schemas import COUNTER, GAUGE

# The derivation rules of the metric fixtures.
BATCH_SIZE = 20          # request_id = event_id div 20, pos = event_id % 20
BAD_DELTA_EVERY = 37     # event_id % 37 = 0 -> operand missing
BAD_TYPE_EVERY = 41      # event_id % 41 = 0 -> type 'unknown'
UNKNOWN_TYPE = "unknown"
# SQLSTATEs given to delivery attempts by props.k % 8.
SQLSTATES = ("08000", "08003", "08006", "40000", "40001", "40P01", "57P03", "23505")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; Spark's split size decides the parallelism."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def props_k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def event_items(events: DataFrame, framing: str = "batch", inject_invalid: bool = True,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One update per event, UPDATE_SCHEMA.

    Even event ids are counters (id = event_type, delta = props.k), odd
    ones gauges (id = 'user_' || user_id, value = value). With
    `inject_invalid`, every 37th event lacks its operand and every 41st
    has type 'unknown'. Framing 'batch' groups 20 consecutive events into
    one request; 'single' makes each event its own request.
    """
    eid = F.col("event_id")
    is_counter = (eid % 2) == 0
    typ = F.when(is_counter, F.lit(COUNTER)).otherwise(F.lit(GAUGE))
    has_operand = F.lit(True)
    if inject_invalid:
        typ = F.when((eid % BAD_TYPE_EVERY) == 0, F.lit(UNKNOWN_TYPE)).otherwise(typ)
        has_operand = (eid % BAD_DELTA_EVERY) != 0
    if framing == "batch":
        rid, pos = F.expr(f"event_id DIV {BATCH_SIZE}"), (eid % BATCH_SIZE).cast("int")
    elif framing == "single":
        rid, pos = eid, F.lit(0)
    else:
        raise ValueError(framing)
    return events.select(
        rid.alias("request_id"),
        pos.alias("pos"),
        eid.alias("seq"),
        F.col("ts"),
        F.when(is_counter, F.col("event_type"))
        .otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("id"),
        typ.alias("type"),
        F.when(is_counter & has_operand, props_k()).alias("delta"),
        F.when(~is_counter & has_operand, F.col("value")).alias("value"),
        F.lit(None).cast("string").alias("hash"),
        *keep,
    )


def lineitem_counters(lineitem: DataFrame) -> DataFrame:
    """Large counter feed: id = returnflag_linestatus, delta = int quantity."""
    return lineitem.select(
        F.lit(None).cast("bigint").alias("request_id"),
        F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("bigint").alias("seq"),
        F.col("l_shipdate").alias("ts"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("id"),
        F.lit(COUNTER).alias("type"),
        F.col("l_quantity").cast("bigint").alias("delta"),
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("string").alias("hash"),
    )


def event_attempts(events: DataFrame) -> DataFrame:
    """Delivery attempts: 4 consecutive events form one delivery."""
    k = props_k()
    code = F.when(k < 20, 503).when(k < 40, 429).when(k < 60, 400).otherwise(0)
    return events.select(
        F.expr("event_id DIV 4").alias("delivery_id"),
        ((F.col("event_id") % 4) + 1).cast("int").alias("attempt"),
        (F.col("event_type") == "purchase").alias("ok"),
        code.cast("int").alias("code"),
        F.when(F.col("event_type") == "error", F.lit("connection refused")).alias("message"),
        F.element_at(F.array(*[F.lit(x) for x in SQLSTATES]), (k % len(SQLSTATES) + 1).cast("int"))
        .alias("sqlstate"),
    )


def event_addresses(events: DataFrame) -> DataFrame:
    """Client addresses per event: 10.(user % 4).(event % 256).(event % 251)."""
    return events.select(
        "event_id",
        F.concat_ws(".", F.lit("10"), (F.col("user_id") % 4).cast("string"),
                    (F.col("event_id") % 256).cast("string"),
                    (F.col("event_id") % 251).cast("string")).alias("ip"),
    )
