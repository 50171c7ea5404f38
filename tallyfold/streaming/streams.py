"""Structured Streaming forms of the fold, reports and journal.

* J1 fold: the same `groupBy(type, id)` with `sum` / `max_by` as the batch
  fold, as a streaming aggregate in update mode; no watermark is needed
  because the state is one row per key (as the service keeps it), kept in
  the RocksDB state store.
* J1 sink: every micro-batch appends only its changed keys to a change
  log; readers take the latest row per key, so a batch costs O(changed
  keys), never a rewrite of the state.
* J4/J5 snapshots: with `snapshots=True` each trigger (a long interval)
  upserts the changed keys into a state table, of which only the touched
  buckets are written; `availableNow` is the final flush.
* J6 restore: a restored base state enters the batch function: counters
  add the stream totals to the base, gauges take the stream value.
* J3 report windows: `withWatermark` + `window`, update mode, change log
  keyed by (host, window, id); rows later than the watermark are dropped
  and counted (`ticks.LateRows`). Reports at every tick and poll ticks that
  are written once are in `ticks`.
* J7 bounded work: `maxFilesPerTrigger` on the file source.
* J8 journal: a stateless projection of the request stream, appended to
  a JSON file sink.

Both table sinks know a batch by its run (the checkpoint) and its number:
a replayed batch that its run has committed does nothing, another run's
batch of the same number is another batch, and what a failed attempt left
is never read. Checkpoints live under the shared folder
(`spark.checkpoint.dir`).
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.render import ntz_as_utc, utc_as_ntz
from tallyfold.operators import agent, fold
from tallyfold.schemas import COUNTER, GAUGE, STATE_SCHEMA
from tallyfold.session import scratch_path
from tallyfold.sinks import snapshot as snap

MAX_FILE_ROWS = 1_000_000


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """Stream the files of a folder; `max_files` bounds each micro-batch."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def _trigger(w, trigger: str | None):
    if trigger is None:
        return w.trigger(availableNow=True)
    return w.trigger(processingTime=trigger)


def run_name(checkpoint: str) -> str:
    """The name of a run: one checkpoint is one run, over any restarts."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _combine_with_base(changed: DataFrame, base: DataFrame | None) -> DataFrame:
    """Stream totals of changed keys, on top of a restored base."""
    if base is None:
        return changed
    b = base.select("name", "type", F.col("delta").alias("b_delta"))
    j = changed.join(b, ["name", "type"], "left")
    return j.select(
        "name", "type",
        F.when(F.col("type") == COUNTER, F.coalesce("b_delta", F.lit(0)) + F.col("delta"))
        .alias("delta"),
        F.when(F.col("type") == GAUGE, F.col("value")).alias("value"))


def upsert_batch_writer(table_dir: str, run: str, fmt: str = "parquet", base: DataFrame | None = None):
    """foreachBatch function: upsert the changed keys into a state table.
    A restored base is published first when the table is new."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if base is not None and not snap.committed_versions(batch.sparkSession, table_dir):
            snap.write_snapshot(base, table_dir, fmt=fmt)
        snap.upsert_snapshot(_combine_with_base(batch, base), table_dir, fmt, run, batch_id)
    return write


# A change log is a folder of appends, `n=N/run=R/batch=B`, in order of n.

def committed_changes(spark: SparkSession, table_dir: str) -> list[str]:
    done = [p.rsplit("/", 1)[0] for p in snap.glob_paths(spark, f"{table_dir}/n=*/run=*/batch=*/_SUCCESS")]
    return sorted(done, key=lambda p: int(p.rsplit("/", 3)[1][2:]))


def change_log_writer(table_dir: str, run: str, base: DataFrame | None = None):
    """foreachBatch function for update-mode aggregates: append the changed
    rows of a batch (O(changed keys) per batch, never a rewrite)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"/run={run}/batch={batch_id}"
        if any(p.endswith(own) for p in committed_changes(spark, table_dir)):
            return
        taken = [int(p.rsplit("=", 1)[1]) for p in snap.glob_paths(spark, f"{table_dir}/n=*")]
        n = max(taken, default=-1) + 1
        _combine_with_base(batch, base).write.mode("errorifexists").parquet(f"{table_dir}/n={n}{own}")
    return write


def last_change(spark: SparkSession, table_dir: str) -> int | None:
    """The number of the last committed append: the name of a version of the table."""
    paths = committed_changes(spark, table_dir)
    return int(paths[-1].rsplit("/", 3)[1][2:]) if paths else None


def read_change_log(spark: SparkSession, table_dir: str, keys: list[str],
                    base: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """The latest row of each key over the base table and the committed
    appends (up to `version`): one partial and final aggregate."""
    paths = [p for p in committed_changes(spark, table_dir) if version is None or int(p.rsplit("/", 3)[1][2:]) <= version]
    if not paths:
        raise ValueError(f"no committed changes under {table_dir}")
    rows = spark.read.option("basePath", table_dir).parquet(*paths).drop("run", "batch")
    if base is not None:
        rows = rows.unionByName(base.withColumn("n", F.lit(-1)), allowMissingColumns=True)
    cols = [c for c in rows.columns if c not in keys and c != "n"]
    last = F.max_by(F.struct(*cols), F.col("n").cast("bigint"))
    return rows.groupBy(*keys).agg(last.alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in cols])


def stream_fold(updates: DataFrame, table_dir: str, checkpoint: str, base: DataFrame | None = None,
                trigger: str | None = None, fmt: str = "parquet", snapshots: bool = False):
    """J1 (+J4/J6): fold an update stream into a state table.

    Default: a change log (`read_change_log`); with `snapshots=True` every
    trigger upserts into a state table (J4: meant for a long `trigger`
    interval such as '300 seconds'). Returns the started query
    (`availableNow` when `trigger` is None).
    """
    state = fold.fold_state(updates)
    run = run_name(checkpoint)
    writer = upsert_batch_writer(table_dir, run, fmt, base) if snapshots \
        else change_log_writer(table_dir, run, base)
    w = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .foreachBatch(writer)
    return _trigger(w, trigger).start()


def live_read_writer(table_dir: str, out_dir: str, run: str):
    """foreachBatch function: answer a batch of reads (request_id, type, id)
    from the last version of a folded table that is committed when the
    batch starts, and name that version in every answer."""
    def answer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = f"{out_dir}/run={run}/batch={batch_id}"
        if snap.glob_paths(spark, f"{out}/_SUCCESS"):
            return   # a replayed batch keeps its answers
        version = last_change(spark, table_dir)
        state = spark.createDataFrame([], STATE_SCHEMA) if version is None \
            else read_change_log(spark, table_dir, ["name", "type"], version=version)
        s = state.select(F.col("type").alias("s_type"), F.col("name").alias("s_name"), "delta", "value")
        on = (F.col("type") == F.col("s_type")) & (F.col("id") == F.col("s_name"))
        answers = batch.join(s, on, "left").select(
            "request_id", "type", "id", "delta", "value", F.when(F.col("s_name").isNull(), 404).otherwise(200).alias("status"),
            F.lit(version).cast("bigint").alias("version"))
        answers.write.mode("overwrite").parquet(out)
    return answer


def stream_reads(reads: DataFrame, table_dir: str, out_dir: str, checkpoint: str, trigger: str | None = None):
    """J1 + L2: a stream of reads against the table that `stream_fold`
    writes, as it stands at each micro-batch."""
    w = reads.writeStream.outputMode("append").option("checkpointLocation", checkpoint) \
        .foreachBatch(live_read_writer(table_dir, out_dir, run_name(checkpoint)))
    return _trigger(w, trigger).start()


def read_answers(spark: SparkSession, out_dir: str) -> DataFrame:
    """The answers of all committed batches."""
    done = [p.rsplit("/", 1)[0] for p in snap.glob_paths(spark, f"{out_dir}/run=*/batch=*/_SUCCESS")]
    if not done:
        raise ValueError(f"no answers under {out_dir}")
    return spark.read.parquet(*done)


def stream_report_windows(samples: DataFrame, every: str, lateness: str, table_dir: str,
                          checkpoint: str, trigger: str | None = None):
    """Report windows per host over a sample stream with a watermark;
    changed windows are appended to a change log keyed by
    (host, window_start, id); rows later than the watermark are dropped."""
    # watermarks need TIMESTAMP: the NTZ event time is read as UTC both ways
    s = samples.withColumn("ts", ntz_as_utc("ts")).withWatermark("ts", lateness)
    rep = agent.window_values(s, every).withColumn("window_start", utc_as_ntz("window_start"))
    w = rep.writeStream.outputMode("update").option("checkpointLocation", checkpoint) \
        .foreachBatch(change_log_writer(table_dir, run_name(checkpoint)))
    return _trigger(w, trigger).start()


def stream_carry_forward(samples: DataFrame, out_dir: str, checkpoint: str,
                         trigger: str | None = None, host: str = "host"):
    """J3/D5 in streaming: at every trigger (a report tick) every id the
    host has ever sent, with its latest value. A complete-mode aggregate
    is exactly that buffer (state = one row per host and id, never
    cleared); each tick is an append of its own."""
    buf = samples.groupBy(host, "id").agg(F.max_by("value", "seq").alias("value"))
    w = buf.writeStream.outputMode("complete").option("checkpointLocation", checkpoint) \
        .foreachBatch(change_log_writer(out_dir, run_name(checkpoint)))
    return _trigger(w, trigger).start()


def read_tick(spark: SparkSession, out_dir: str) -> DataFrame:
    """The last report tick written by `stream_carry_forward`."""
    paths = committed_changes(spark, out_dir)
    if not paths:
        raise ValueError(f"no committed ticks under {out_dir}")
    return spark.read.parquet(paths[-1])


def stream_journal(items: DataFrame, out_dir: str, checkpoint: str, trigger: str | None = None):
    """Append journal items of a request stream to a JSON file sink."""
    w = items.select("ts", "metrics", "ip_address").writeStream.format("json") \
        .outputMode("append").option("checkpointLocation", checkpoint).option("path", out_dir)
    return _trigger(w, trigger).start()


def run_to_end(query, timeout_s: int | None = None) -> None:
    """Wait for an `availableNow` query; re-raise its failure. Such a query
    ends by itself, after a time that grows with its input, so it is stopped
    as unfinished only where a caller sets a limit."""
    query.awaitTermination(timeout_s)
    if query.isActive:
        query.stop()
        raise TimeoutError("stream did not finish")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def time_span(df: DataFrame, time_col: str) -> tuple[dt.datetime, dt.datetime] | None:
    """First and last time of a table; None if it has none."""
    r = df.agg(F.min(time_col).alias("first"), F.max(time_col).alias("last")).first()
    return None if r.first is None else (r["first"], r["last"])


def lateness_of(span: tuple[dt.datetime, dt.datetime] | None, parts: int = 1) -> str:
    """How late a row can be that comes in no order within one of `parts` equal slices of the span."""
    whole = (span[1] - span[0]) / parts if span else dt.timedelta()
    return f"{int(whole.total_seconds()) + 1} seconds"


def staged_slices(df: DataFrame, path: str, time_col: str, span: tuple[dt.datetime, dt.datetime] | None,
                  slices: int = 4) -> Iterator[str]:
    """The rows of `df` as files under `path`, one slice of the time span
    after the other (rows without a time come first). Yields the path when
    a slice is there, so that a stream can run in between."""
    t = F.col(time_col)
    first, last = span or (dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 1))
    bounds = [first + (last - first) * i / slices for i in range(1, slices)]
    per_file = max(1000, min(MAX_FILE_ROWS, -(-df.count() // 12)))
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = df if high is None else df.where(t.isNull() | (t < F.lit(high)) if low is None else t < F.lit(high))
        part = part if low is None else part.where(t >= F.lit(low))
        part.write.mode("append").option("maxRecordsPerFile", per_file).parquet(path)
        yield path


def staged_copy(df: DataFrame, name: str) -> str:
    """A copy of a table under the shared folder to feed a file stream, in
    files of at most a million rows (fewer when the table is small, so that
    there are several micro-batches). Written where the rows are read, in
    no particular order."""
    path = scratch_path(df.sparkSession, name)
    per_file = max(1000, min(MAX_FILE_ROWS, -(-df.count() // 16)))
    df.write.mode("errorifexists").option("maxRecordsPerFile", per_file).parquet(path)
    return path
