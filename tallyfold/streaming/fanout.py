"""Fan-out of a live journal to many sinks, with a ledger.

A micro-batch is stored once under the ledger and every sink is fed from
that copy, in a folder of its own per batch, so that an attempt replaces
what an earlier one left. One outcome row per (run, batch, sink) is written
after the sink took the batch or refused it; it is the commit. A batch that
is replayed after a crash skips the sinks that have an outcome and serves
the others, so no sink gets a line twice and none is left out. A sink that
fails does not stop the others; as in the service it is not tried again.

    ledger/items/run=R/batch=B      the items of a batch
    ledger/outcomes/run=R/batch=B/sink=S    one row: ok, rows, error
    <sink>/delivery=R-B             the lines

Both tables are read as DataFrames: `outcomes` and `item_outcomes`, where an
item is delivered if any sink took it (`bool_or`), and not if there is none.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.operators.journal import write_journal
from tallyfold.sinks.snapshot import glob_paths
from tallyfold.streaming.streams import run_name

OUTCOME = "ok boolean, rows bigint, error string"
PLACE = "run string, batch bigint"


def _place(run: str, batch: int) -> str:
    return f"run={run}/batch={batch}"


def _committed(spark: SparkSession, pattern: str) -> list[str]:
    return [p.rsplit("/", 1)[0] for p in glob_paths(spark, f"{pattern}/_SUCCESS")]


def fan_out_writer(sinks: dict[str, str | None], ledger: str, run: str, write=write_journal):
    """foreachBatch function: one batch of items to every sink (name ->
    path; a sink without a path takes nothing)."""

    def deliver(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = _place(run, number)
        served = {p.rsplit("=", 1)[1] for p in _committed(spark, f"{ledger}/outcomes/{place}/sink=*")}
        copy = f"{ledger}/items/{place}"
        if not _committed(spark, copy):
            batch.write.mode("overwrite").parquet(copy)
        items = spark.read.schema(batch.schema).parquet(copy)
        rows = items.count()
        for name, path in sinks.items():
            if name in served:
                continue
            try:
                ok, error = write(items, path, f"{run}-{number}"), None
            except (PySparkException, Py4JJavaError) as e:
                cause = e.java_exception.toString() if isinstance(e, Py4JJavaError) else str(e)
                ok, error = False, (cause.splitlines() or [type(e).__name__])[0]
            outcome = spark.createDataFrame([(ok, rows if ok else 0, error)], OUTCOME)
            outcome.coalesce(1).write.mode("overwrite").json(f"{ledger}/outcomes/{place}/sink={name}")

    return deliver


def stream_fan_out(items: DataFrame, sinks: dict[str, str | None], ledger: str, checkpoint: str,
                   trigger: str | None = None, write=write_journal):
    """A stream of journal items to every sink. Returns the started
    query (`availableNow` when `trigger` is None)."""
    w = items.writeStream.outputMode("append").option("checkpointLocation", checkpoint) \
        .foreachBatch(fan_out_writer(sinks, ledger, run_name(checkpoint), write))
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()


def _table(spark: SparkSession, root: str, ddl: str, fmt: str) -> DataFrame:
    """A folder of `key=value` folders; its files and places as columns."""
    schema = T.StructType.fromDDL(ddl)
    if not _committed(spark, f"{root}/run=*/batch=*" + ("/sink=*" if "sink string" in ddl else "")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).format(fmt).load(f"{root}/run=*")


def outcomes(spark: SparkSession, ledger: str) -> DataFrame:
    """run, batch, sink, ok, rows, error: one row per batch and sink."""
    return _table(spark, f"{ledger}/outcomes", f"{OUTCOME}, {PLACE}, sink string", "json").select(
        "run", "batch", "sink", "ok", "rows", "error")


def item_outcomes(spark: SparkSession, ledger: str, schema: T.StructType) -> DataFrame:
    """The items with run, batch, `taken` (sinks that took them) and
    `delivered` (E7). Items are not multiplied: outcomes are few rows per
    batch, reduced before the join."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    items = _table(spark, f"{ledger}/items", f"{fields}, {PLACE}", "parquet")
    per_batch = outcomes(spark, ledger).groupBy("run", "batch").agg(F.bool_or("ok").alias("any"), F.count_if("ok").alias("n"))
    return items.join(per_batch, ["run", "batch"], "left").select(
        "run", "batch", *schema.fieldNames(), F.coalesce("n", F.lit(0)).alias("taken"),
        F.coalesce("any", F.lit(False)).alias("delivered"))
