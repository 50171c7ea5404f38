"""Composed flows: request decisions (C7) and bulk ingest (L1).

One pass over the request log computes every check as a status column;
the first failing check is the request's status (`coalesce`). A batch body
is one row, so its first invalid item is found in the row. Accepted
updates of all routes are folded in one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import gzipped, jsonwire
from tallyfold.operators import envelope, fold, routing, security, validate
from tallyfold.operators.routing import (R_JSON_BATCH, R_JSON_UPDATE, R_JSON_VALUE, R_LIST,
                                         R_PATH_UPDATE, R_PATH_VALUE, R_PING)
from tallyfold.schemas import COUNTER, GAUGE

ITEM_SLOTS = 1 << 31  # positions are INT
JSON_ROUTES = (R_JSON_UPDATE, R_JSON_BATCH, R_JSON_VALUE)
BODY_ROUTES = (R_JSON_UPDATE, R_JSON_BATCH, R_JSON_VALUE, R_PATH_VALUE)
GZIP_ROUTES = (*BODY_ROUTES, R_LIST)
# the checks before validation, in order
EARLY_CHECKS = ("s_subnet", "s_route", "s_sig", "s_gzip", "decrypt_status", "s_parse", "s_nested", "s_method", "s_ping")


@dataclass(frozen=True)
class EdgeConfig:
    """Service settings that shape the decisions (all optional)."""
    trusted_cidr: str | None = None
    sign_key: str | None = None
    keys: DataFrame | None = None      # data-key table for encrypted bodies
    has_db: bool = False


def _hdr(name: str) -> F.Column:
    return F.col("headers").getItem(name)


def decide_requests(requests: DataFrame, cfg: EdgeConfig, state: DataFrame | None = None) -> DataFrame:
    """Per request `route`, `status` and the decoded single update
    (`id`, `type`, `delta`, `value`) where the route carries one. With a
    `state`, reads also get what they found, and its rendered `text` if the
    state has that column.

    Order: subnet 400/403 -> route 404 -> signature 400 -> gunzip 500/400
    -> decrypt 400/500 -> parse 400 -> path below a group root 404 ->
    method 405 -> ping 503 -> validate 500 -> lookup 404 -> 200. Path
    updates skip signature, gunzip and decrypt. The signature is that of the
    body as sent (a missing body is empty).
    """
    kind = routing.route_kind("path")
    d = requests.withColumn("route", kind)
    d = d.withColumn("s_subnet", F.lit(None).cast("int"))
    if cfg.trusted_cidr:
        d = d.withColumn("_real_ip", _hdr("X-Real-IP"))
        d = security.with_subnet_status(d.drop("s_subnet"), "_real_ip", cfg.trusted_cidr,
                                        "s_subnet").drop("_real_ip")
    r = F.col("route")
    sent = F.coalesce(F.col("body"), F.lit(b""))
    sig = security.signature_status(_hdr("HashSHA256"), sent, cfg.sign_key)
    is_gzip = r.isin(*GZIP_ROUTES) & F.coalesce(_hdr("Content-Encoding").contains("gzip"), F.lit(False))
    # columns go in by groups: every step of its own is an analysis of the whole plan
    d = d.withColumns({
        "s_route": routing.route_check_status("path", r),
        "s_sig": F.when(r.isin(*JSON_ROUTES), sig),
        "s_method": routing.method_status("method", r),
        "s_nested": F.when(r.isin(R_JSON_UPDATE, R_JSON_BATCH) & ~F.col("path").isin(*routing.UPDATE_ROOTS), F.lit(404)),
        "s_ping": F.when((r == R_PING) & F.lit(not cfg.has_db), F.lit(503)),
        "x_encrypted": F.when(r.isin(*BODY_ROUTES), _hdr("X-Encrypted")),
        "_path": F.when(r == R_PATH_UPDATE, routing.parse_path_update("path")),
        "_gz": gzipped.gunzip(F.when(is_gzip, sent))})
    reads_body = F.col("route").isin(*JSON_ROUTES)
    d = d.withColumns({
        "s_gzip": F.when((F.col("_gz.status") == gzipped.NO_HEADER) | reads_body, F.col("_gz.status")),
        "_body": F.when(is_gzip, F.col("_gz.data")).otherwise(F.col("body"))}).drop("_gz")
    d = envelope.open_envelopes(d, cfg.keys, "_body", "x_encrypted") \
        if cfg.keys is not None else d.withColumns({
            "decrypt_status": F.when(F.col("x_encrypted").isNotNull() & (F.col("x_encrypted") != ""), F.lit(500)).cast("int"),
            "plain": F.col("_body")})
    pv = F.regexp_extract("path", routing.PATH_VALUE, 1)
    d = jsonwire.with_single(d, "plain", "_single",
                             only_when=r.isin(R_JSON_UPDATE, R_JSON_VALUE))
    d = jsonwire.with_batch(d, "plain", "_batch", only_when=r == R_JSON_BATCH)
    s_parse = (F.when(r == R_PATH_UPDATE, F.col("_path.status"))
               .when(r.isin(R_JSON_UPDATE, R_JSON_VALUE) & F.col("_single.bad"), F.lit(400))
               .when((r == R_JSON_BATCH) & F.col("_batch.bad"), F.lit(400))
               .when((r == R_PATH_VALUE) & ~pv.isin(COUNTER, GAUGE), F.lit(400)))
    d = d.withColumns({
        "s_parse": s_parse.cast("int"),
        # the single update carried by the request
        "id": F.coalesce(F.col("_path.id"), F.col("_single.id"), F.when(r == R_PATH_VALUE, F.regexp_extract("path", routing.PATH_VALUE, 2))),
        "type": F.coalesce(F.col("_path.type"), F.col("_single.type"), F.when(r == R_PATH_VALUE, pv)),
        "delta": F.coalesce(F.col("_path.delta"), F.col("_single.delta")),
        "value": F.coalesce(F.col("_path.value"), F.col("_single.value")),
        "_items": F.when((r == R_JSON_BATCH) & ~F.col("_batch.bad"), F.col("_batch.items"))})
    invalid = validate.reject_reason().isNotNull()
    # batches: the body is one row, so its first invalid item is found in
    # the row (no explode, no shuffle, no join back)
    bad_flags = F.transform("_items", lambda x: F.coalesce(
        validate.reject_reason(x["id"], x["type"], x["delta"], x["value"]).isNotNull(), F.lit(True)))
    first = F.array_position(bad_flags, True)   # 1-based, 0 = none
    d = d.withColumns({
        "_single_bad": r.isin(R_PATH_UPDATE, R_JSON_UPDATE) & invalid,
        "first_bad": F.nullif(first, F.lit(0)).cast("int") - 1})
    d = d.withColumn("s_validate", F.when(
        F.col("_single_bad") | ((r == R_JSON_BATCH) & F.col("first_bad").isNotNull()), F.lit(500))).drop("_single_bad")
    if state is not None:
        # one left join on the key, limited to read routes in the ON clause
        # (the state has one row per key: Spark broadcasts it when small)
        text = F.col("text") if "text" in state.columns else F.lit(None).cast("string")
        s = state.select(F.col("type").alias("_st"), F.col("name").alias("_sn"),
                         F.col("delta").alias("_sd"), F.col("value").alias("_sv"), text.alias("found_text"))
        # only reads have a join key: the hot keys of updates stay out of it
        is_read = r.isin(R_JSON_VALUE, R_PATH_VALUE)
        on = (F.when(is_read, F.col("type")) == F.col("_st")) & (F.when(is_read, F.col("id")) == F.col("_sn"))
        d = d.join(s, on, "left")
        d = d.withColumns({
            "s_lookup": F.when(r.isin(R_JSON_VALUE, R_PATH_VALUE) & F.col("_sn").isNull(), F.lit(404)),
            "found_delta": F.when(F.col("_st") == COUNTER, F.col("_sd")),
            "found_value": F.when(F.col("_st") == GAUGE, F.col("_sv"))}).drop("_st", "_sn", "_sd", "_sv")
    else:
        d = d.withColumn("s_lookup", F.when(r.isin(R_JSON_VALUE, R_PATH_VALUE), F.lit(404)))
    early = F.coalesce(*EARLY_CHECKS)
    status = F.coalesce(early, "s_validate", "s_lookup", F.lit(200))
    d = d.withColumn("status", status.cast("int"))
    # the updates this request applies, in order (pos)
    one = F.array(F.struct(F.lit(0).alias("pos"), F.col("id").alias("id"),
                           F.col("type").alias("type"), F.col("delta").alias("delta"),
                           F.col("value").alias("value")))
    n_acc = F.coalesce(F.col("first_bad"), F.size("_items"))
    prefix = F.transform(F.slice("_items", 1, n_acc), lambda x, i: F.struct(
        i.alias("pos"), x["id"].alias("id"), x["type"].alias("type"),
        x["delta"].alias("delta"), x["value"].alias("value")))
    applied = (F.when(r.isin(R_PATH_UPDATE, R_JSON_UPDATE) & (F.col("status") == 200), one)
               .when((r == R_JSON_BATCH) & early.isNull() & (n_acc > 0), prefix))
    return d.withColumn("applied", applied).drop("_single", "_batch", "_path", "_items", "_body")


def accepted_updates(decided: DataFrame) -> DataFrame:
    """Updates that reach the state: single updates with status 200, and
    the valid prefix of batches whose earlier checks passed (the items
    before the first bad one stay even though the request gets 500).

    Arrival order is (request seq, pos) as one DECIMAL(38,0), which holds
    every pair of a BIGINT and an INT and keeps the fold a hash aggregate.
    """
    # explode_outer + a filter on the generated column: a plain explode
    # would make Spark infer `applied IS NOT NULL` and push it below the
    # decision projections, evaluating the whole decision twice
    x = decided.select("request_id", "seq", F.explode_outer("applied").alias("u")) \
        .where(F.col("u").isNotNull())
    return x.select(
        "request_id", F.col("u.pos").alias("pos"),
        (F.col("seq").cast("decimal(20,0)") * F.lit(ITEM_SLOTS).cast("decimal(10,0)")
         + F.col("u.pos").cast("decimal(10,0)")).cast("decimal(38,0)").alias("seq"),
        F.col("u.id").alias("id"), F.col("u.type").alias("type"),
        F.col("u.delta").alias("delta"), F.col("u.value").alias("value"))


def ingest(requests: DataFrame, cfg: EdgeConfig, state: DataFrame | None = None) -> DataFrame:
    """L1: request log -> decisions -> accepted updates -> new state
    (applied onto `state` when given)."""
    acc = accepted_updates(decide_requests(requests, cfg))
    if state is None:
        return fold.fold_state(acc, validate=False)
    return fold.apply_updates(state, acc)
