"""Helpers shared by the text operators: words, Arrow batches, shared tables, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.session import scratch_path

# ASCII white space that ends a word, as a Java character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_SQL_TYPES = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string",
              pa.binary(): "binary", pa.bool_(): "boolean"}


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space; None has none."""
    return text.lower().split() if text else []


def utf8(column: str | Column) -> Column:
    """The UTF-8 bytes of a text column (null stays null)."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def sql_type(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{sql_type(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return "struct<" + ",".join(f"{f.name}:{sql_type(f.type)}" for f in kind) + ">"
    return _SQL_TYPES[kind]


def map_lists(df: DataFrame, start: Callable[[], Callable[..., dict]], schema: pa.Schema, rows: int = 2048) -> DataFrame:
    """mapInArrow over Python lists: `start()` is called once per task and
    gives a function from one batch's columns (lists of at most `rows`) to a
    dict of output columns, so a task can keep state between its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                out = step(*(c.to_pylist() for c in batch.slice(i, rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {sql_type(f.type)}" for f in schema))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back:
    the lineage ends there, so lost executors cost a re-read and nothing is
    computed twice. The scratch folder comes from `spark.checkpoint.dir`."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, rows: int, *columns: str, total: int | None = None) -> DataFrame:
    """At most `rows` rows of a uniform sample: the lowest hashes of the
    columns. Rows are first thinned by another part of the hash to about
    four times as many, so that all tasks together return a bounded number
    of candidates to the driver, however many tasks there are."""
    n = df.count() if total is None else total
    share = min(1.0, 4 * rows / max(1, n))
    key = F.xxhash64(*columns)
    thinned = df.where(F.pmod(key, F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    return thinned.orderBy(key, *columns).limit(rows)


def connected_components(edges: DataFrame, kind: str = "bigint") -> DataFrame:
    """(node, component) of an undirected edge list (a, b); component is the
    smallest node reachable. Nodes without an edge to another node do not
    appear.

    Large-star and small-star rounds: every round points neighbours at
    smaller nodes until each tree is a star, in a number of rounds that
    grows with the logarithm of the longest path. Each half round is a
    partial minimum and one join whose sides are plain shuffles, so AQE can
    split the edges of a hub; every round ends in a shared table.
    """
    pairs = edges.select(F.greatest("a", "b").cast(kind).alias("a"), F.least("a", "b").cast(kind).alias("b"))
    now = stored(pairs.where("a <> b").distinct(), "cc-edges")
    seen = None
    while True:
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = stored(sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-low")
        large = stored(sides.join(lows, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .distinct(), "cc-large")
        lows = stored(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        joined = large.join(lows, "a")
        now = stored(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .unionByName(lows.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (mark.n, mark.x) == seen:
            break
        seen = (mark.n, mark.x)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
