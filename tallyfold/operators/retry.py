"""Delivery retry analysis over an attempts log.

The service retries in process with fixed delays; in bulk the question is
what that policy does to a log of attempt outcomes: which errors are
retriable, how many attempts are made, whether the delivery succeeds and
how long it waits. The plan is one partial aggregate per delivery with
one conditional column per policy attempt (the policy is short), so a
delivery with a huge attempt history still costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Retriable message fragments and status codes of the sender.
RETRIABLE_FRAGMENTS = ("connection refused", "no such host", "timeout",
                       "connection reset", "network is unreachable", "EOF")
RETRIABLE_CODES = (408, 429)
# Retriable SQLSTATE codes of the database writer.
RETRIABLE_SQLSTATES = ("08000", "08003", "08006", "40000", "40001", "40P01", "57P03")
# Default delays (seconds) of the retry policy.
DEFAULT_DELAYS = (1, 3, 5)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sender_retriable(ok="ok", code="code", message="message") -> Column:
    """A failed delivery is retriable when its message has one of the
    fragments, or its code is 5xx, 408 or 429. A success is not an error."""
    msg = F.coalesce(_col(message), F.lit(""))
    frag = F.lit(False)
    for f in RETRIABLE_FRAGMENTS:
        frag = frag | msg.contains(f)
    c = _col(code)
    by_code = F.coalesce(c.between(500, 599) | c.isin(*RETRIABLE_CODES), F.lit(False))
    return F.when(F.coalesce(_col(ok), F.lit(False)), F.lit(False)).otherwise(frag | by_code)


def db_retriable(sqlstate="sqlstate") -> Column:
    """Connection / rollback / cannot-connect SQLSTATEs are retriable."""
    return F.coalesce(_col(sqlstate).isin(*RETRIABLE_SQLSTATES), F.lit(False))


def retry_plan(attempts: DataFrame, delays=DEFAULT_DELAYS, key: str = "delivery_id",
               retriable: Column | None = None) -> DataFrame:
    """C11: per delivery, attempts made, outcome and total wait (seconds).

    Attempt k (1-based, at most len(delays)) is made if no earlier attempt
    stopped the delivery; an attempt stops it when it succeeds or fails
    with a non-retriable error; after a retriable failure the policy waits
    delays[k] (also after the last attempt, as the sender does).
    """
    r = retriable if retriable is not None else sender_retriable()
    n = len(delays)
    aggs = []
    for k in range(1, n + 1):
        at_k = F.col("attempt") == k
        aggs.append(F.max(F.when(at_k, F.col("ok"))).alias(f"ok{k}"))
        aggs.append(F.max(F.when(at_k, r)).alias(f"rt{k}"))
        aggs.append(F.max(at_k).alias(f"has{k}"))
    g = attempts.groupBy(key).agg(*aggs)
    made = F.lit(n)
    for k in range(n, 0, -1):
        stop_k = F.coalesce(F.col(f"ok{k}"), F.lit(False)) | ~F.coalesce(F.col(f"rt{k}"), F.lit(True)) \
            | ~F.coalesce(F.col(f"has{k}"), F.lit(False))
        made = F.when(stop_k, F.lit(k)).otherwise(made)
    g = g.withColumn("attempts", made)
    delivered = F.lit(False)
    wait = F.lit(0)
    for k in range(1, n + 1):
        okk = F.coalesce(F.col(f"ok{k}"), F.lit(False))
        delivered = F.when(F.col("attempts") == k, okk).otherwise(delivered)
        failed_retriable = (~okk) & F.coalesce(F.col(f"rt{k}"), F.lit(False)) \
            & F.coalesce(F.col(f"has{k}"), F.lit(False))
        wait = wait + F.when((F.col("attempts") >= k) & failed_retriable, F.lit(delays[k - 1])) \
            .otherwise(F.lit(0))
    return g.select(key, F.col("attempts").cast("int").alias("attempts"),
                    delivered.alias("delivered"), wait.cast("int").alias("wait_s"))
