"""Agent-side operators: host samples, polls, reports (A8, K1, E4, E8,
J2, J3, D5, B5, B6, H2).

The report unit is a host: every group (poll window, report window,
report body, carry-forward range) is keyed by host, so its size is
bounded by the metrics of one host, not by the data volume. Tumbling
windows use `window()`, which works the same in batch and streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.schemas import COUNTER, GAUGE

# Runtime sample field names, in natural order.
RUNTIME_FIELDS = (
    "Alloc", "BuckHashSys", "Frees", "GCCPUFraction", "GCSys", "HeapAlloc", "HeapIdle",
    "HeapInuse", "HeapObjects", "HeapReleased", "HeapSys", "LastGC", "Lookups",
    "MCacheInuse", "MCacheSys", "MSpanInuse", "MSpanSys", "Mallocs", "NextGC",
    "NumForcedGC", "NumGC", "OtherSys", "PauseTotalNs", "StackInuse", "StackSys", "Sys",
    "TotalAlloc",
)
# System and self metric names.
TOTAL_MEMORY = "TotalMemory"
FREE_MEMORY = "FreeMemory"
CPU_PREFIX = "CPUutilization"
POLL_COUNT = "PollCount"
RANDOM_VALUE = "RandomValue"


def runtime_extractors(fields=RUNTIME_FIELDS) -> dict[str, Column]:
    """K1: metric name -> Column expression (one wide column per name)."""
    return {name: F.col(name) for name in fields}


def unpivot_gauges(wide: DataFrame, ids: list[str], extractors: dict[str, Column]) -> DataFrame:
    """Wide sample -> one gauge row per extractor, values as double.
    `unpivot` is a projection + generator: no shuffle."""
    cols = [c.cast("double").alias(n) for n, c in extractors.items()]
    w = wide.select(*ids, *cols)
    return w.unpivot(ids, list(extractors), "id", "value") \
        .withColumn("type", F.lit(GAUGE))


def system_gauges(samples: DataFrame, ids: list[str], total="TotalMemory", free="FreeMemory",
                  cpu="cpu") -> DataFrame:
    """Memory gauges plus `CPUutilization{i+1}` per array element."""
    mem = samples.select(*ids, F.col(total).cast("double").alias(TOTAL_MEMORY),
                         F.col(free).cast("double").alias(FREE_MEMORY)) \
        .unpivot(ids, [TOTAL_MEMORY, FREE_MEMORY], "id", "value")
    cpus = samples.select(*ids, F.posexplode(cpu).alias("i", "u")).select(
        *ids, F.concat(F.lit(CPU_PREFIX), (F.col("i") + 1).cast("string")).alias("id"),
        F.col("u").cast("double").alias("value"))
    return mem.unionByName(cpus).withColumn("type", F.lit(GAUGE))


def self_metrics(samples: DataFrame, ids: list[str], seed: int | None = None) -> DataFrame:
    """One `PollCount` counter increment and one `RandomValue` gauge
    per sample (random values never reach a compared column)."""
    pc = samples.select(*ids, F.lit(POLL_COUNT).alias("id"), F.lit(COUNTER).alias("type"),
                        F.lit(1).cast("bigint").alias("delta"), F.lit(None).cast("double").alias("value"))
    rv = samples.select(*ids, F.lit(RANDOM_VALUE).alias("id"), F.lit(GAUGE).alias("type"),
                        F.lit(None).cast("bigint").alias("delta"), F.rand(seed).alias("value"))
    return pc.unionByName(rv)


def all_readers(*parts: DataFrame) -> DataFrame:
    """H2: union of the sample readers (missing columns are NULL)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def agent_buffer(samples: DataFrame, host: str = "host") -> DataFrame:
    """Per host, the buffer is keyed by id only: the last record of any
    type replaces the whole record (counters are not added)."""
    last = F.max_by(F.struct("type", "delta", "value"), "seq")
    return samples.groupBy(host, "id").agg(last.alias("m")).select(
        host, "id", F.col("m.type").alias("type"), F.col("m.delta").alias("delta"),
        F.col("m.value").alias("value"))


def poll_sampling(samples: DataFrame, every: str, host: str = "host") -> DataFrame:
    """One sample per host, id and poll tick: the last value in the tick."""
    return samples.groupBy(host, F.window("ts", every).alias("w"), "id").agg(
        F.max_by("value", "seq").alias("value")).select(
        host, F.col("w.start").alias("window_start"), "id", "value")


def window_values(samples: DataFrame, every: str, host: str = "host") -> DataFrame:
    """Per host, report window and gauge id: the last value and the number
    of samples. The one aggregate over the samples; batch or streaming."""
    return samples.groupBy(host, F.window("ts", every).alias("w"), "id").agg(
        F.max_by("value", "seq").alias("value"), F.count(F.lit(1)).alias("polls")).select(
        host, F.col("w.start").alias("window_start"), "id", "value", "polls")


def report_rows(values: DataFrame, host: str = "host") -> DataFrame:
    """J3 + E8: the report of each host and window from its values: the
    gauges, and a `PollCount` counter = number of polls (samples). The
    counter goes out with the first gauge, so the values are read once; a
    window holds one host's ids."""
    report = Window.partitionBy(host, "window_start")
    v = values.withColumn("n", F.sum("polls").over(report)) \
        .withColumn("first", F.row_number().over(report.orderBy("id")) == 1)
    gauge = F.struct(F.col("id").alias("id"), F.lit(GAUGE).alias("type"), F.lit(None).cast("bigint").alias("delta"),
                     F.col("value").alias("value"))
    polls = F.struct(F.lit(POLL_COUNT).alias("id"), F.lit(COUNTER).alias("type"), F.col("n").alias("delta"),
                     F.lit(None).cast("double").alias("value"))
    rows = F.explode(F.when(F.col("first"), F.array(gauge, polls)).otherwise(F.array(gauge)))
    return v.select(host, "window_start", rows.alias("r")).select(host, "window_start", "r.id", "r.type", "r.delta", "r.value")


def report_windows(samples: DataFrame, every: str, host: str = "host") -> DataFrame:
    """J3 + E8 over a table: per host and report window, the last value of
    each gauge id and the poll count."""
    return report_rows(window_values(samples, every, host), host)


def carry_forward(samples: DataFrame, every: str, host: str = "host") -> DataFrame:
    """At every report tick, each id the host has ever sent with its
    latest value (the buffer is never cleared).

    A value holds from its own window up to the one before the id's next
    value, or to the last window of the data; those ticks are generated
    from the value's row (no join back, no cross join). A window holds one
    (host, id) series of values, never the samples.
    """
    w = F.window("ts", every)
    per = samples.groupBy(host, w.alias("w"), "id").agg(F.max_by("value", "seq").alias("value")) \
        .select(host, "id", F.col("w.start").alias("day"), "value")
    last_day = samples.select(F.max("ts").alias("ts")).select(F.window("ts", every)["start"]).scalar()
    step = F.expr(f"INTERVAL {every}")
    following = F.lead("day").over(Window.partitionBy(host, "id").orderBy("day"))
    held = per.withColumn("until", F.coalesce(following - step, last_day))
    return held.select(host, "id", F.explode(F.sequence("day", "until", step)).alias("day"), "value").select(
        host, "id", (F.col("day") + step).alias("tick"), "value")


def report_envelopes(report: DataFrame, keys: list[str]) -> DataFrame:
    """B5 batch mode: all metrics of one report in one JSON array body,
    ordered by id; a report is one host's metrics, so the list is bounded."""
    item = F.struct("id", "type", "delta", "value")
    return report.groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(item))).alias("body"),
        F.count(F.lit(1)).alias("n_items"))


def single_envelopes(report: DataFrame) -> DataFrame:
    """B5 single mode: one body per metric."""
    return report.withColumn("body", F.to_json(F.struct("id", "type", "delta", "value")))
