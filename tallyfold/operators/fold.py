"""The state fold: counters add up, gauges keep the last value.

All folds are one `groupBy(type, id)` with a partial (map-side) and a
final hash aggregate, so a key that holds a third of the rows costs one
row per map task in the shuffle. "Last" is decided by the BIGINT `seq`
(total arrival order) through `max_by`, which keeps the aggregate a
HashAggregate (a struct ordering key would turn it into a SortAggregate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.validate import reject_reason
from tallyfold.schemas import COUNTER, GAUGE

# Seq given to rows of an existing state/snapshot: before every update.
STATE_SEQ = -1


def _sum(c: Column, on_overflow: str) -> Column:
    if on_overflow == "error":
        return F.sum(c)  # ANSI: int64 overflow fails the job loudly
    if on_overflow == "null":
        return F.try_sum(c)
    raise ValueError(f"on_overflow must be 'error' or 'null', not {on_overflow!r}")


def fold_state(updates: DataFrame, on_overflow: str = "error", validate: bool = True) -> DataFrame:
    """Updates (id, type, delta, value, seq) -> state (name, type, delta, value).

    Invalid updates are skipped when `validate` (single-update semantics);
    pass already accepted rows with `validate=False`.
    """
    u = updates
    if validate:
        u = u.where(reject_reason().isNull())
    u = u.select(
        "id",
        "type",
        F.when(F.col("type") == COUNTER, F.col("delta")).alias("delta"),
        F.when(F.col("type") == GAUGE, F.col("value")).alias("value"),
        F.when(F.col("type") == GAUGE, F.col("seq")).alias("gseq"),
    )
    return u.groupBy("type", "id").agg(
        _sum(F.col("delta"), on_overflow).alias("delta"),
        F.max_by("value", "gseq").alias("value"),
    ).select(F.col("id").alias("name"), "type", "delta", "value")


def counter_totals(updates: DataFrame, on_overflow: str = "error") -> DataFrame:
    """Sum of deltas per counter id."""
    return (
        updates.where((F.col("type") == COUNTER) & reject_reason().isNull())
        .groupBy("id")
        .agg(_sum(F.col("delta"), on_overflow).alias("delta"))
    )


def gauge_latest(updates: DataFrame) -> DataFrame:
    """Value of the last update per gauge id."""
    return (
        updates.where((F.col("type") == GAUGE) & reject_reason().isNull())
        .groupBy("id")
        .agg(F.max_by("value", "seq").alias("value"))
    )


def state_as_updates(state: DataFrame, seq: int = STATE_SEQ) -> DataFrame:
    """State rows -> update rows, only the column that matches the type."""
    return state.select(
        F.col("name").alias("id"),
        "type",
        F.when(F.col("type") == COUNTER, F.col("delta")).alias("delta"),
        F.when(F.col("type") == GAUGE, F.col("value")).alias("value"),
        F.lit(seq).cast("bigint").alias("seq"),
    )


def apply_updates(state: DataFrame, updates: DataFrame, on_overflow: str = "error") -> DataFrame:
    """Read-modify-write in bulk. The existing state enters the same
    fold as rows ordered before every update (one shuffle, no join):
    counters add to what is there, gauges are overwritten by later values.
    Applying a snapshot twice therefore doubles its counters, as a replay does.
    """
    cols = ["id", "type", "delta", "value", "seq"]
    base = state_as_updates(state)
    return fold_state(base.unionByName(updates.select(*cols)), on_overflow=on_overflow)


def running_state(updates: DataFrame, chunk_rows: int = 1 << 20) -> DataFrame:
    """the value of each key right after each (valid) update.

    Counters: a prefix sum per key in `seq` order; gauges: the row's value.
    A hot key is cut into `seq` chunks, so no window holds more than one
    chunk of one key: (1) running sum inside (key, chunk); (2) chunk totals
    = the last running sum of each chunk, from the same shuffle; (3) offsets
    = running sum of earlier chunk totals (one row per key and chunk);
    (4) join back and add.
    """
    u = updates.where(reject_reason().isNull()).select(
        "seq", "type", "id",
        F.when(F.col("type") == COUNTER, F.col("delta")).alias("delta"),
        F.when(F.col("type") == GAUGE, F.col("value")).alias("value"),
    )
    c = u.where(F.col("type") == COUNTER).withColumn(
        "chunk", F.expr(f"seq DIV {int(chunk_rows)}"))
    w_local = Window.partitionBy("type", "id", "chunk").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = c.withColumn("local_sum", F.sum("delta").over(w_local))
    totals = local.groupBy("type", "id", "chunk").agg(F.max_by("local_sum", "seq").alias("chunk_sum"))
    w_prev = Window.partitionBy("type", "id").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("chunk_sum").over(w_prev), F.lit(0)))
    counters = local.join(offsets.select("type", "id", "chunk", "offset"),
                          ["type", "id", "chunk"], "inner").select(
        "seq", "type", "id", "delta",
        (F.col("local_sum") + F.col("offset")).alias("total"),
        F.lit(None).cast("double").alias("value"),
    )
    gauges = u.where(F.col("type") == GAUGE).select(
        "seq", "type", "id", F.lit(None).cast("bigint").alias("delta"),
        F.lit(None).cast("bigint").alias("total"), "value")
    return counters.unionByName(gauges)
