"""State snapshots and upserts (B1, B2) with atomic publish.

A state table is a folder of versions, each partitioned by a hash bucket of
the key. A full version (B1) holds the whole state; a part (B2) holds only
the buckets that an upsert touched. Readers take, for each bucket, the
newest committed version that has it, back to the last full one. Versions
are new folders, committed by Spark's `_SUCCESS` file and never written
again; an uncommitted folder is never read. Old versions stay until a
retention job removes them.

B2 upsert: `target LEFT ANTI source UNION ALL source` on (name, type), the
bulk form of `INSERT ... ON CONFLICT DO UPDATE`: keys absent from the source
are kept, never deleted; an empty source is a no-op.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.schemas import COUNTER, GAUGE
from tallyfold.session import materialize

BUCKETS = 16  # of a new table; a table keeps its number
COLUMNS = ["name", "type", "delta", "value"]
_VERSION = re.compile(r"version=(\d+)\.(full|part)-(\d+)(?:\.run=(\w+)\.batch=(\d+))?$")


@dataclass(frozen=True)
class Version:
    number: int
    full: bool
    buckets: int
    run: str | None
    batch: int | None
    path: str
    committed: bool


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, through Hadoop's file system (names only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [s.getPath().toString() for s in found or []]


def versions(spark: SparkSession, table_dir: str) -> list[Version]:
    """All version folders in order, the uncommitted ones too."""
    done = {p.rsplit("/", 1)[0] for p in glob_paths(spark, f"{table_dir}/version=*/_SUCCESS")}
    out = []
    for p in glob_paths(spark, f"{table_dir}/version=*"):
        m = _VERSION.search(p)
        if m:
            out.append(Version(int(m[1]), m[2] == "full", int(m[3]), m[4], int(m[5]) if m[5] else None, p, p in done))
    return sorted(out, key=lambda v: v.number)


def committed_versions(spark: SparkSession, table_dir: str) -> list[int]:
    return [v.number for v in versions(spark, table_dir) if v.committed]


def bucket_paths(spark: SparkSession, table_dir: str) -> dict[int, str]:
    """The folder that holds each bucket's current rows."""
    out: dict[int, str] = {}
    for v in reversed([v for v in versions(spark, table_dir) if v.committed]):
        for p in glob_paths(spark, f"{v.path}/bucket=*"):
            out.setdefault(int(p.rsplit("=", 1)[1]), p)
        if v.full:
            break
    return out


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("name", "type"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, fmt: str, compression: str | None) -> str:
    """Rows (with their bucket) as one folder per bucket."""
    key = "id" if fmt == "json" else "name"   # file snapshots use the wire record
    w = (rows.select(F.col("name").alias(key), "type", "delta", "value", "bucket").repartition("bucket")
         .write.mode("errorifexists").partitionBy("bucket"))
    if compression:
        w = w.option("compression", compression)
    if fmt not in ("json", "parquet"):
        raise ValueError(fmt)
    w.format(fmt).save(path)
    return path


def write_snapshot(state: DataFrame, table_dir: str, fmt: str = "parquet", version: int | None = None,
                   compression: str | None = None, buckets: int | None = None) -> str:
    """B1: write the whole state as a new full version; returns its path.

    `fmt='json'` writes JSON lines with NULL fields omitted (the file
    snapshot form); 'parquet' is the table form. An explicit `version` that
    is already there fails (`errorifexists`).
    """
    known = versions(state.sparkSession, table_dir)
    if version is None:
        version = max([int(time.time() * 1000)] + [v.number + 1 for v in known])
    n = buckets or (known[-1].buckets if known else BUCKETS)
    return _write(state.withColumn("bucket", bucket_of(n)), f"{table_dir}/version={version}.full-{n}", fmt, compression)


def upsert(target: DataFrame, source: DataFrame) -> DataFrame:
    """B2: rows of `source` replace rows of `target` with the same
    (name, type); other target rows stay. Source keys are unique (a state)."""
    kept = target.select(*COLUMNS).join(source.select("name", "type"), ["name", "type"], "left_anti")
    return kept.unionByName(source.select(*COLUMNS))


def is_committed(spark: SparkSession, table_dir: str, run: str, batch: int) -> bool:
    return any(v.committed and (v.run, v.batch) == (run, batch) for v in versions(spark, table_dir))


def upsert_snapshot(source: DataFrame, table_dir: str, fmt: str = "parquet", run: str | None = None,
                    batch: int | None = None) -> str | None:
    """B2 against a state table: the touched buckets are read, upserted and
    published as a part; the other buckets keep their files. Returns the
    part's path (None for an empty source).

    A stream names its `run` and `batch`: a batch that this run has
    committed is skipped; what a failed attempt left is never read.
    """
    from tallyfold.sources.snapshot import read_state_files  # avoid cycle

    spark = source.sparkSession
    if run is not None and is_committed(spark, table_dir, run, batch):
        return None
    known = versions(spark, table_dir)
    n = known[-1].buckets if known else BUCKETS
    rows = materialize(source.select(*COLUMNS).withColumn("bucket", bucket_of(n)), "upsert")
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most n rows
    if not touched and run is None:
        return None
    current = bucket_paths(spark, table_dir)
    old = read_state_files(spark, [current[b] for b in touched if b in current], fmt)
    merged = upsert(old, rows).withColumn("bucket", bucket_of(n))
    number = max([v.number + 1 for v in known], default=0)
    tag = f".run={run}.batch={batch}" if run is not None else ""
    return _write(merged, f"{table_dir}/version={number}.part-{n}{tag}", fmt, None)


def hydrate(df: DataFrame) -> DataFrame:
    """Keep only the column that matches the type (DB restore rule)."""
    return df.select(
        "name", "type",
        F.when(F.col("type") == COUNTER, F.col("delta")).alias("delta"),
        F.when(F.col("type") == GAUGE, F.col("value")).alias("value"),
    )
