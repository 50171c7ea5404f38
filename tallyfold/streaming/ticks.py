"""Report ticks and poll ticks as append streams.

* J2 `stream_poll_sampling`: the last value of each host, id and poll tick,
  written once, when the watermark has passed the tick.
* J3 `stream_reports`: at every report interval each host sends every id it
  has ever sent with its latest value, and `PollCount`, the samples since
  the tick before, which then starts again at zero. The values of an
  interval come from a windowed aggregate in append mode (native, one row
  per host, interval and id); what a host has sent so far is arbitrary
  state with event-time timers, so an interval without samples is a report
  too. The state of a host is bounded by its ids; hosts share state by
  hash buckets, so calls and timers of a batch grow with the buckets.
* `LateRows`: rows later than the watermark, added up over all batches of a
  query by a listener (`recentProgress` keeps only the last ones).

A tick goes out once the watermark has passed it; `heartbeat` moves the
watermark when no more samples come (the end of a bounded input).
"""

from __future__ import annotations

import contextlib
import datetime as dt
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from tallyfold.functions.render import ntz_as_utc, utc_as_ntz
from tallyfold.operators import agent
from tallyfold.schemas import COUNTER, GAUGE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BUFFERS = ("hosts array<struct<host:long,ids:array<string>,held:array<double>,next:long,"
           "pending:array<struct<tick:long,id:string,value:double,polls:long>>>>")
# Hosts are kept in as many buckets, so that a batch calls Python
# once for a bucket and not once for every host; fixed for a checkpoint's life.
BUCKETS = 2048
FRAME_ROWS = 20_000   # rows of one output frame


class LateRows(StreamingQueryListener):
    """Rows dropped as late by one query, over all its batches.

        with LateRows(spark) as late:
            run_to_end(start())
        late.rows
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.batches = spark, 0, 0
        self._running, self._ended = 0, threading.Condition()

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        # events arrive in order, so those of the last batch are in once every query has ended
        with self._ended:
            self._ended.wait_for(lambda: self._running == 0, timeout=60)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        with self._ended:
            self._running += 1

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._running -= 1
            self._ended.notify_all()


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which arbitrary state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def interval_of(spark: SparkSession, every: str) -> dt.timedelta:
    return spark.sql(f"SELECT CAST(INTERVAL {every} AS INTERVAL DAY TO SECOND)").first()[0]


class ReportTicks(StatefulProcessor):
    """The buffers of the hosts of one bucket. Of each host: ids with their
    latest values, the tick to come, and the finished intervals that it has
    not reported yet. The bucket has one timer, at its earliest tick."""

    def __init__(self, every_ms: int):
        self.every = every_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.buffers = handle.getValueState("buffers", BUFFERS)

    def _read(self) -> dict:
        if not self.buffers.exists():
            return {}
        return {host: (dict(zip(ids, held)), tick, [tuple(p) for p in pending])
                for host, ids, held, tick, pending in self.buffers.get()[0]}

    def _write(self, hosts: dict) -> None:
        self.buffers.update(([(host, list(now), list(now.values()), tick, pending)
                              for host, (now, tick, pending) in hosts.items()],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hosts = self._read()
        timer = min((tick for _, tick, _ in hosts.values()), default=None)
        for frame in rows:
            own = zip(frame["known"].tolist(), frame["host"].tolist(), frame["tick"].tolist(), frame["id"].tolist(),
                      frame["value"].tolist(), frame["polls"].tolist())
            for known, host, *row in own:
                now, tick, pending = hosts.setdefault(host if known else None, ({}, row[0], []))
                pending.append(tuple(row))
                if row[0] < tick and not now:  # nothing reported so far
                    hosts[host if known else None] = (now, row[0], pending)
        first = min(tick for _, tick, _ in hosts.values())
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self._write(hosts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hosts, mark, out = self._read(), timerValues.getCurrentWatermarkInMs(), []
        for host, (now, tick, pending) in hosts.items():
            if tick > mark:
                continue
            waiting: dict[int, list] = {}
            for p in pending:
                waiting.setdefault(p[0], []).append(p)
            while tick <= mark:
                polls = 0
                for _, name, value, n in waiting.pop(tick, ()):
                    now[name], polls = value, polls + n
                out += [(host, tick, name, GAUGE, None, value) for name, value in now.items()]
                out.append((host, tick, agent.POLL_COUNT, COUNTER, polls, None))
                tick += self.every
                if len(out) >= FRAME_ROWS:
                    yield _frame(out)
                    out = []
            hosts[host] = (now, tick, [p for ps in waiting.values() for p in ps])
        self._write(hosts)
        self.handle.registerTimer(min(tick for _, tick, _ in hosts.values()))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(reports: list[tuple]) -> pd.DataFrame:
    host, tick, name, kind, delta, value = zip(*reports)
    # whole numbers beside nulls stay whole numbers
    return pd.DataFrame({"host": pd.array(host, "Int64"), "tick": pd.array(tick, "int64"), "id": name, "type": kind,
                         "delta": pd.array(delta, "Int64"), "value": pd.array(value, "float64")})


def _append(rows: DataFrame, out_dir: str, checkpoint: str, trigger: str | None):
    w = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out_dir)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()


def _late(samples: DataFrame, lateness: str) -> DataFrame:
    # watermarks need TIMESTAMP: the NTZ event time is read as UTC both ways
    return samples.withColumn("ts", ntz_as_utc("ts")).withWatermark("ts", lateness)


def stream_poll_sampling(samples: DataFrame, every: str, lateness: str, out_dir: str, checkpoint: str,
                         trigger: str | None = None):
    """Host, window_start, id, value, each tick once; rows later than
    the watermark are dropped (and counted, see `LateRows`)."""
    polled = agent.poll_sampling(_late(samples, lateness), every).withColumn("window_start", utc_as_ntz("window_start"))
    return _append(polled, out_dir, checkpoint, trigger)


def stream_reports(samples: DataFrame, every: str, lateness: str, out_dir: str, checkpoint: str,
                   trigger: str | None = None, buckets: int = BUCKETS):
    """J3 + D5: host, tick, id, type, delta, value of every report. More
    hosts need more `buckets`: the buffers of a bucket are read and written
    together."""
    spark = samples.sparkSession
    w = F.window("ts", every)
    values = _late(samples, lateness).groupBy("host", w.alias("w"), "id").agg(
        F.max_by("value", "seq").alias("value"), F.count(F.lit(1)).alias("polls"))
    # the host goes through pandas as a number without nulls
    finished = values.select(
        F.pmod(F.xxhash64("host"), F.lit(buckets)).alias("bucket"), F.coalesce(F.col("host").cast("bigint"), F.lit(0)).alias("host"),
        F.col("host").isNotNull().alias("known"), F.unix_millis(F.col("w.end")).alias("tick"), "id", "value", "polls",
        F.window_time("w").alias("at"))
    with rocksdb(spark):
        reports = finished.groupBy("bucket").transformWithStateInPandas(
            ReportTicks(interval_of(spark, every) // dt.timedelta(milliseconds=1)),
            "host bigint, tick bigint, id string, type string, delta bigint, value double", "append", "EventTime")
        reports = reports.withColumn("tick", utc_as_ntz(F.timestamp_millis("tick")))
        return _append(reports, out_dir, checkpoint, trigger)


def last_tick(last: dt.datetime, every: dt.timedelta) -> dt.datetime:
    """The end of the interval that holds `last`; intervals start at the epoch, as `window` has them."""
    epoch = dt.datetime(1970, 1, 1)
    return epoch + ((last - epoch) // every + 1) * every


def heartbeat(spark: SparkSession, path: str, schema, time_col: str, at: dt.datetime) -> None:
    """One row without a key, at time `at`, into the folder of a file
    stream: it moves the watermark and belongs to no finished interval."""
    row = [at if f.name == time_col else None for f in schema]
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
