"""Bulk keyed reads of the state.

The state has one row per key, so a bulk read is an equi-join on
(type, name). No broadcast hint is given: Spark plans a broadcast only
when its size estimate, or at run time AQE's measured size, is under the
configured threshold, and a shuffle join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.fold import running_state


def read_found(lookups: DataFrame, state: DataFrame) -> DataFrame:
    """Lookups (request_id, type, id) that exist, with their values.
    Only the column of the key's type is returned."""
    s = state.select(F.col("type").alias("s_type"), F.col("name").alias("s_name"), "delta", "value")
    j = lookups.join(s, (lookups["type"] == s["s_type"]) & (lookups["id"] == s["s_name"]), "inner")
    return j.select(
        "request_id", "type", "id",
        F.when(F.col("type") == "counter", F.col("delta")).alias("delta"),
        F.when(F.col("type") == "gauge", F.col("value")).alias("value"),
    )


def read_missing(lookups: DataFrame, state: DataFrame) -> DataFrame:
    """Lookups that find nothing -> status 404."""
    s = state.select(F.col("type").alias("s_type"), F.col("name").alias("s_name"))
    j = lookups.join(s, (lookups["type"] == s["s_type"]) & (lookups["id"] == s["s_name"]),
                     "left_anti")
    return j.select("request_id", "type", "id", F.lit(404).alias("status"))


def read_as_of(reads: DataFrame, updates: DataFrame, chunk_rows: int = 1 << 20) -> DataFrame:
    """D1 + D5: each read (request_id, seq, type, id) with the value its key
    had after the last update up to its `seq`; status 404 before the first.

    Reads and updates of a key meet in chunks of `seq`, so a hot key is many
    bounded windows. A read before the first update of its chunk takes what
    the earlier chunks left, which is one row per key and chunk.
    """
    after = running_state(updates, chunk_rows)
    held = F.struct(F.col("total").alias("delta"), F.col("value").alias("value"))
    nothing = F.lit(None).cast("struct<delta:bigint,value:double>")
    chunk = F.expr(f"seq DIV {int(chunk_rows)}").alias("chunk")
    u = after.select("type", "id", chunk, "seq", F.lit(0).alias("turn"), held.alias("held"), F.lit(None).cast("bigint").alias("request_id"))
    r = reads.select("type", "id", chunk, "seq", F.lit(1).alias("turn"), nothing.alias("held"), "request_id")
    both = u.unionByName(r)   # at one seq the update comes before the read
    here = F.last("held", ignorenulls=True).over(
        Window.partitionBy("type", "id", "chunk").orderBy("seq", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = both.withColumn("held", here).where(F.col("turn") == 1)
    left = both.groupBy("type", "id", "chunk").agg(F.max_by("held", F.when(F.col("turn") == 0, F.col("seq"))).alias("left"))
    earlier = Window.partitionBy("type", "id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.withColumn("carried", F.last("left", ignorenulls=True).over(earlier)).where(F.col("carried").isNotNull())
    c = carried.select(F.col("type").alias("c_type"), F.col("id").alias("c_id"), F.col("chunk").alias("c_chunk"), "carried")
    on = (F.col("type") == F.col("c_type")) & (F.col("id") == F.col("c_id")) & (F.col("chunk") == F.col("c_chunk"))
    found = F.coalesce("held", "carried")
    return local.join(c, on, "left").select(
        "request_id", "type", "id", found["delta"].alias("delta"), found["value"].alias("value"),
        F.when(found.isNull(), F.lit(404)).otherwise(F.lit(200)).alias("status"))
