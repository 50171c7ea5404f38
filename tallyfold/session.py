"""Session defaults and the shared folder.

Sizes that depend on the machine (master, memory, shuffle partitions, scan
split size) are the caller's: a cluster sets them at submit time, bench.py
and the tests set their own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults that hold from one machine to a large cluster: AQE re-plans
# joins and coalesces partitions from runtime sizes, and splits skewed join
# partitions. Broadcast thresholds are Spark's own size checks.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "tallyfold", extra: dict | None = None) -> SparkSession:
    """A session with the scale defaults; `extra` sets or overrides any."""
    builder = SparkSession.builder.appName(app_name)
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables, from the
    session's `spark.checkpoint.dir`.

    Where it is unset, a temporary folder is made and registered only if
    driver and executors are one process on this machine (a local master,
    as in tests); on a cluster the executors would each write to a folder
    of their own, so the call fails instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        root = tempfile.mkdtemp(prefix="tallyfold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused)."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's file system (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def materialize(df, name: str):
    """Write `df` once as a Parquet table under the shared folder and read
    it back: cuts the lineage (a lost executor recomputes from the table,
    not from the sources) and stops Catalyst from re-deriving its columns
    inside later projections. Costs one write, unlike an eager
    `checkpoint()`, which computes the plan twice when it is not cached."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
