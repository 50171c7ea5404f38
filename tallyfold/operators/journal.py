"""Audit journal.

A journal item is a projection of a decided request: unix seconds of the
event time (never the wall clock), the metric names in body order with
duplicates kept, and the client address. Fan-out writes the same items
to every registered sink; an item is delivered if any sink took it.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.render import unix_seconds
from tallyfold.operators.barrier import late_filter
from tallyfold.operators.routing import R_JSON_BATCH, R_JSON_UPDATE, R_PATH_UPDATE, client_ip
from tallyfold.session import materialize


def journal_items(decided: DataFrame, early: tuple[str, ...]) -> DataFrame:
    """E5: one item per journaled request.

    A single update is journaled once it reaches the handler, even if the
    save fails (status 500); a batch only when every item applied (200). A
    record without id is journaled with an empty name. `early` names the
    status columns of the checks before the handler.
    """
    early_ok = F.coalesce(*early).isNull()
    r, st = F.col("route"), F.col("status")
    single = r.isin(R_PATH_UPDATE, R_JSON_UPDATE) & early_ok
    batch = (r == R_JSON_BATCH) & (st == 200)
    names = (F.when(single, F.array(F.coalesce("id", F.lit(""))))
             .when(batch, F.coalesce(F.transform("applied", lambda x: F.coalesce(x["id"], F.lit(""))),
                                     F.array().cast("array<string>"))))
    return late_filter(decided, single | batch).select(
        "request_id",
        unix_seconds("ts").alias("ts"),
        names.alias("metrics"),
        client_ip("remote_addr").alias("ip_address"),
    )


def write_journal(items: DataFrame, path: str | None, delivery: str | None = None) -> bool:
    """Append items as JSON lines; no path = nothing written (False).

    With a `delivery` name the items are a folder of their own under
    `path`: delivering it again replaces what a failed attempt left and
    adds nothing twice."""
    if not path:
        return False
    writer = items.select("ts", "metrics", "ip_address").write
    if delivery is None:
        writer.mode("append").json(path)
    else:
        writer.mode("overwrite").json(f"{path}/delivery={delivery}")
    return True


@dataclass(frozen=True)
class Delivery:
    """Outcome of one fan-out: per sink, written or not, and the errors."""
    written: tuple[bool, ...]
    errors: tuple[str | None, ...]

    @property
    def delivered(self) -> bool:
        """Any sink took the items."""
        return any(self.written)


def fan_out(items: DataFrame, sinks: list[str | None], delivery: str) -> Delivery:
    """B4 + E7: write the same items to every sink.

    The items are stored once in the shared folder and every sink is fed
    from that copy, so no sink sees rows of another delivery. A sink whose
    write fails does not stop the others; its error is recorded."""
    source = materialize(items.select("ts", "metrics", "ip_address"), "delivery")
    written, errors = [], []
    for sink in sinks:
        try:
            written.append(write_journal(source, sink, delivery))
            errors.append(None)
        except (PySparkException, Py4JJavaError) as e:
            written.append(False)
            errors.append(str(e).splitlines()[0] if str(e) else type(e).__name__)
    return Delivery(tuple(written), tuple(errors))


def access_log(decided: DataFrame) -> DataFrame:
    """Method, uri and the decided status of each request."""
    return decided.select("request_id", "method", F.col("path").alias("uri"), "status")
