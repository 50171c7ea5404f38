"""Snapshot and journal scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.validate import reject_reason
from tallyfold.schemas import JOURNAL_SCHEMA, STATE_SCHEMA
from tallyfold.session import materialize, path_exists
from tallyfold.sinks.snapshot import bucket_paths, hydrate

# Snapshot file record: the wire form (id/type/delta/value).
SNAPSHOT_RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("delta", T.LongType()),
    T.StructField("value", T.DoubleType()),
])
NULLABLE_STATE = T.StructType([T.StructField(f.name, f.dataType, True) for f in STATE_SCHEMA])


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NULLABLE_STATE)


def read_snapshot_json(spark: SparkSession, path: str, multiline: bool = False, stop_at_invalid: bool = False) -> DataFrame:
    """A5: snapshot file(s) of update records -> state rows; a missing path
    is an empty state. `multiline=True` reads one JSON array per file.
    With `stop_at_invalid` (J6) only the records before the first invalid
    one are returned, as a restore applies them."""
    if not path_exists(spark, path):
        return empty_state(spark)
    df = spark.read.schema(SNAPSHOT_RECORD).option("multiLine", multiline).json(path)
    if stop_at_invalid:
        df = valid_prefix(df)
    return df.selectExpr("id AS name", "type", "delta", "value")


def valid_prefix(records: DataFrame) -> DataFrame:
    """The records of a file scan before the first one that fails validation.

    Order is that of the files by path, then of the bytes within a file: a
    split's start, then the place in the split (one task reads it in order).
    The numbered records are stored once, so both passes see the same
    numbers; the first bad place is one partial minimum."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row"))
    kept = materialize(records.select("*", place.alias("_place"), (reject_reason().isNotNull()).alias("_bad")), "restored")
    first_bad = kept.where("_bad").agg(F.min("_place").alias("p")).first().p
    if first_bad is not None:
        here = F.struct(*(F.lit(first_bad[n]).alias(n) for n in ("file", "start", "row")))
        kept = kept.where(F.col("_place") < here)
    return kept.select(*records.columns)


def read_state_files(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """State files (parquet or JSON lines) with the typed hydrate."""
    if not paths:
        return empty_state(spark)
    if fmt == "json":
        df = spark.read.schema(SNAPSHOT_RECORD).json(paths).withColumnRenamed("id", "name")
    else:
        df = spark.read.schema(NULLABLE_STATE).parquet(*paths)
    return hydrate(df)


def read_state_table(spark: SparkSession, table_dir: str, fmt: str = "parquet") -> DataFrame:
    """The current rows of a state table (empty if there is none)."""
    return read_state_files(spark, sorted(bucket_paths(spark, table_dir).values()), fmt)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines (JSON) of all deliveries, with the journal schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], JOURNAL_SCHEMA)
    return spark.read.schema(JOURNAL_SCHEMA).option("recursiveFileLookup", True).json(path)
