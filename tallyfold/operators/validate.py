"""Update checks (C1, C2), valid batch prefix (C8) and batch counts.

Every check is a `when` chain in one projection (whole-stage codegen).
The batch prefix needs the first invalid position of each request: it is
a partial aggregate (map-side combine) joined back, never a window over
the request, so one huge batch is not pulled into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.schemas import COUNTER, GAUGE

# Validation messages of the update contract.
MSG_MISSING_ID_TYPE = "missing required fields: id or type"
MSG_MISSING_DELTA = "missing required field: delta"
MSG_MISSING_VALUE = "missing required field: value"
MSG_UNKNOWN_TYPE = "unknown metric type: "


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def reject_reason(id_col="id", type_col="type", delta_col="delta", value_col="value") -> Column:
    """Why an incoming update is refused (NULL = valid). 0 counts as present;
    the field of the other type is ignored."""
    i, t, d, v = (F.col(c) if isinstance(c, str) else c for c in (id_col, type_col, delta_col, value_col))
    return (
        F.when(_blank(i) | _blank(t), F.lit(MSG_MISSING_ID_TYPE))
        .when((t == COUNTER) & d.isNull(), F.lit(MSG_MISSING_DELTA))
        .when((t == GAUGE) & v.isNull(), F.lit(MSG_MISSING_VALUE))
        .when(~t.isin(COUNTER, GAUGE), F.concat(F.lit(MSG_UNKNOWN_TYPE), t))
    )


def outgoing_reason(type_col="type", delta_col="delta", value_col="value") -> Column:
    """Sender-side check: type and operand only, the id is not checked."""
    t, d, v = (F.col(c) if isinstance(c, str) else c for c in (type_col, delta_col, value_col))
    return (
        F.when((t == COUNTER) & d.isNull(), F.lit(MSG_MISSING_DELTA))
        .when((t == GAUGE) & v.isNull(), F.lit(MSG_MISSING_VALUE))
        .when(t.isNull() | ~t.isin(COUNTER, GAUGE),
              F.concat(F.lit("unsupported metric type: "), F.coalesce(t, F.lit(""))))
    )


def with_reason(updates: DataFrame) -> DataFrame:
    return updates.withColumn("reason", reject_reason())


def split_valid(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine). Both come from one projection of the input."""
    r = with_reason(updates)
    return r.where(F.col("reason").isNull()).drop("reason"), r.where(F.col("reason").isNotNull())


def first_invalid(items: DataFrame, key: str = "request_id") -> DataFrame:
    """First invalid position per request (only requests that have one).

    A partial + final hash aggregate: map-side combine keeps the shuffle
    at one row per (task, bad request) however large a batch is.
    """
    return (
        items.where(F.col("pos").isNotNull() & reject_reason().isNotNull())
        .groupBy(key)
        .agg(F.min("pos").alias("first_bad"))
    )


def valid_prefix(items: DataFrame, key: str = "request_id") -> DataFrame:
    """Items that apply: those before the first invalid item of their batch.

    The join back is planned by Spark: broadcast when the bad-request table
    is small at run time (AQE), else a shuffle join whose skewed partitions
    AQE splits. Adds `accepted` and `first_bad`; returns all items.
    """
    bad = first_invalid(items, key)
    joined = items.join(bad, key, "left")
    return joined.withColumn(
        "accepted", F.col("first_bad").isNull() | (F.col("pos") < F.col("first_bad"))
    )


def accepted_prefix(items: DataFrame, key: str = "request_id") -> DataFrame:
    return valid_prefix(items, key).where("accepted").drop("accepted", "first_bad")


def batch_outcomes(items: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request: size, accepted, dropped and status (200 / 500).

    `items` has one row per item with dense positions 0..n-1 (NULL `pos`
    for an empty batch, which is 200 with zero items). One partial
    aggregate, no join: the accepted count is the first bad position.
    """
    bad = F.col("pos").isNotNull() & reject_reason().isNotNull()
    out = items.groupBy(key).agg(
        F.count("pos").alias("n_items"),
        F.min(F.when(bad, F.col("pos"))).alias("first_bad"),
    )
    n_acc = F.coalesce(F.col("first_bad"), F.col("n_items")).cast("bigint")
    return out.select(
        key,
        "n_items",
        n_acc.alias("n_accepted"),
        (F.col("n_items") - n_acc).alias("n_dropped"),
        "first_bad",
        F.when(F.col("first_bad").isNull(), F.lit(200)).otherwise(F.lit(500)).alias("status"),
    )
