"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together. Groups,
largest first, go to the least-loaded shard, taken from a heap.

Scale: a group's size is a partial aggregate, so a group with a third of
all rows is one row per task in the shuffle. The heap sees a bounded number
of items whatever the input: a group larger than a 2^-16 part of all bytes
is an item of its own (there are fewer than 2^16 of those by arithmetic);
all smaller groups fall by their hash into 2^16 bundles, which are items.
The items are the only thing collected and broadcast. Shards then differ
by about the smallest item, some 2^-16 of the whole. In a small table
every group is an item.

Slots: the assigned rows (ids and numbers, no texts) are stored with the
input split they come from; a slot is the rows of the shard in earlier
splits plus the place in the own split, so no window spans a shard.

Defined cases: a null text counts as empty; null and repeated ids are rows
like others; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyfold.llm.common import stored, utf8

PARTS = 1 << 16


def longest_first(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """item -> shard from (item, size): sorted by size, each to the
    least-loaded shard (lowest number among equals)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[item] = shard
    return placed


def assign_shards(docs: DataFrame, shards: int = 8, text_col: str = "text", carry: dict | None = None) -> DataFrame:
    """One row per document: the `carry` columns (name -> column), size,
    shard and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce(utf8(text_col), F.lit(b""))
    rows = stored(docs.select(*(c.alias(f"c_{k}") for k, c in (carry or {}).items()),
                              (F.octet_length(text) + 1).cast("bigint").alias("size"),
                              F.unhex(F.md5(text)).alias("text_key"),
                              F.spark_partition_id().alias("split"),
                              F.monotonically_increasing_id().alias("row")), "sized")
    groups = stored(rows.groupBy("text_key").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("text_key"), F.lit(PARTS))
    alone = F.col("size") * PARTS > total
    heavy = groups.where(alone).select("text_key", "size").collect()  # fewer than PARTS rows: their sizes add up to total
    light = groups.where(~alone).groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("size")).collect()  # at most PARTS
    # bundles are items 0..PARTS-1, groups of their own follow in key order
    heavy = sorted((bytes(r.text_key), r["size"]) for r in heavy)
    placed = longest_first([(r.bundle, r["size"]) for r in light]
                           + [(PARTS + i, size) for i, (_, size) in enumerate(heavy)], shards)
    own = spark.createDataFrame([(bytearray(key), placed[PARTS + i]) for i, (key, _) in enumerate(heavy)],
                                "text_key binary, own int")
    shared = spark.createDataFrame([(b, s) for b, s in placed.items() if b < PARTS],
                                   StructType([StructField("bundle", LongType()), StructField("shared", IntegerType())]))
    # both tables are bounded by PARTS rows
    sharded = (rows.join(F.broadcast(own), "text_key", "left")
               .withColumn("bundle", bundle).join(F.broadcast(shared), "bundle", "left")
               .withColumn("shard", F.coalesce("own", "shared")).drop("own", "shared", "bundle", "text_key"))
    within = Window.partitionBy("split", "shard").orderBy("row")
    counts = sharded.groupBy("shard", "split").count()
    before = counts.select("shard", "split", (F.sum("count").over(
        Window.partitionBy("shard").orderBy("split")) - F.col("count")).alias("before"))
    placed_rows = sharded.withColumn("place", F.row_number().over(within) - 1).join(before, ["shard", "split"])
    return placed_rows.select(*(F.col(f"c_{k}").alias(k) for k in carry or {}), "size", "shard",
                              (F.col("before") + F.col("place")).cast("bigint").alias("slot"))
