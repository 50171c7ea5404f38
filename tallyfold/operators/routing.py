"""Routes, methods and the per-request decision.

A request's status is the first failing check, in the order the edge
applies them; it is one `coalesce` over status columns in a single
projection, so cheap checks short-circuit and the whole chain stays in
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.parse import parse_float64, parse_int64
from tallyfold.schemas import COUNTER, GAUGE

# Route patterns of the service.
PATH_UPDATE = r"^/update/([^/]+)/([a-zA-Z0-9_-]+)/(-?[a-z0-9.]+)/?$"
PATH_VALUE = r"^/value/([^/]+)/([a-zA-Z0-9_-]+)/?$"
UPDATE_ROUTE_OK = r"^/update/[a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+/(-?)[a-zA-Z0-9\\.]+$"
UPDATE_ROOTS = ("/update", "/update/", "/updates", "/updates/")
HOST_PORT = r"^(?:\[([^\[\]]*)\]|([^:\[\]]*)):([^:\[\]]*)$"

# Route kinds.
R_PATH_UPDATE = "path_update"
R_PATH_VALUE = "path_value"
R_JSON_UPDATE = "json_update"
R_JSON_BATCH = "json_batch"
R_JSON_VALUE = "json_value"
R_LIST = "list"
R_PING = "ping"
R_NONE = "none"

# Allowed method per route.
ROUTE_METHOD = {
    R_PATH_UPDATE: "POST",
    R_PATH_VALUE: "GET",
    R_JSON_UPDATE: "POST",
    R_JSON_BATCH: "POST",
    R_JSON_VALUE: "POST",
    R_LIST: "GET",
    R_PING: "GET",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def route_kind(path) -> Column:
    p = _col(path)
    return (
        F.when(p.rlike(PATH_UPDATE), F.lit(R_PATH_UPDATE))
        .when(p.rlike(PATH_VALUE), F.lit(R_PATH_VALUE))
        .when(p.isin("/update", "/update/") | p.startswith("/update/"), F.lit(R_JSON_UPDATE))
        .when(p.isin("/updates", "/updates/") | p.startswith("/updates/"), F.lit(R_JSON_BATCH))
        .when(p.isin("/value", "/value/"), F.lit(R_JSON_VALUE))
        .when(p.isin("/ping", "/ping/"), F.lit(R_PING))
        .when(p == "/", F.lit(R_LIST))
        .otherwise(F.lit(R_NONE))
    )


def route_check_status(path, kind) -> Column:
    """404 for unknown routes and for /update(s) paths the route
    check refuses; NULL when the route is fine."""
    p, k = _col(path), _col(kind)
    valid_update_group = p.rlike(UPDATE_ROUTE_OK) | p.isin(*UPDATE_ROOTS)
    return (
        F.when(k == R_NONE, F.lit(404))
        .when(k.isin(R_JSON_UPDATE, R_JSON_BATCH) & ~valid_update_group, F.lit(404))
        # inside the group, anything but the group root is not a handler
        .when(k.isin(R_JSON_UPDATE, R_JSON_BATCH) & ~p.isin(*UPDATE_ROOTS), F.lit(None))
    )


def method_status(method, kind) -> Column:
    """C4: 405 when the method is not the route's."""
    m, k = _col(method), _col(kind)
    expr = F.lit(None).cast("int")
    for route, allowed in ROUTE_METHOD.items():
        expr = F.when((k == route) & (m != allowed), F.lit(405)).otherwise(expr)
    return expr


def path_parts(path) -> Column:
    """Segments of a path that matches PATH_UPDATE: struct(type, id, text).
    No segment holds a slash, so they are cut without the pattern."""
    p = _col(path)
    segments = (F.substring_index(F.substring_index(p, "/", n), "/", -1) for n in (3, 4, 5))
    return F.struct(*(s.alias(name) for s, name in zip(segments, ("type", "id", "text"))))


def parse_path_update(path) -> Column:
    """A1: path update -> struct(id, type, delta, value, status).

    status 400 for an unknown type or a number that does not parse
    (nothing is stored then); NULL when the update is well formed.
    """
    parts = path_parts(path)
    t, text = parts["type"], parts["text"]
    delta = F.when(t == COUNTER, parse_int64(text))
    value = F.when(t == GAUGE, parse_float64(text))
    status = (
        F.when(~t.isin(COUNTER, GAUGE), F.lit(400))
        .when((t == COUNTER) & delta.isNull(), F.lit(400))
        .when((t == GAUGE) & value.isNull(), F.lit(400))
    )
    return F.struct(
        parts["id"].alias("id"), t.alias("type"), delta.alias("delta"),
        value.alias("value"), status.alias("status"))


def client_ip(remote_addr) -> Column:
    """Host part of host:port, else the whole text. A host with colons
    counts only inside brackets, so a bare IPv6 address stays whole."""
    r = _col(remote_addr)
    host = F.concat(F.regexp_extract(r, HOST_PORT, 1), F.regexp_extract(r, HOST_PORT, 2))
    return F.when(r.rlike(HOST_PORT), host).otherwise(r)
