"""Payload checks: HMAC signature (C6), trusted subnet (C5) and the
address-in-subnets range join (D4). All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import hmac, netaddr


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def signature_status(hash_col, body, key: str | bytes | None) -> Column:
    """NULL (pass) without a key or without/empty hash header; pass if
    the hex (any case) equals HMAC(body); else 400."""
    h = _col(hash_col)
    if not key:
        return F.lit(None).cast("int")
    return (F.when(h.isNull() | (h == ""), F.lit(None))
            .when(hmac.signature_matches(h, body, key), F.lit(None))
            .otherwise(F.lit(400))).cast("int")


def with_subnet_status(df: DataFrame, real_ip: str, cidr: str | None,
                       out: str = "subnet_status") -> DataFrame:
    """400 for a missing/blank/unparsable X-Real-IP, 403 outside the
    trusted prefix, NULL inside. No CIDR configured = check off."""
    if not cidr:
        return df.withColumn(out, F.lit(None).cast("int"))
    fam, lo, hi, _ = netaddr.cidr_bounds(cidr)  # a bad CIDR fails here, at build time
    d = netaddr.with_key(df, f"trim(`{real_ip}`)", "_sn_key")
    # keys order by family, then number; those of zoned addresses are beyond any prefix
    st = f"CASE WHEN _sn_key IS NULL THEN 400 WHEN _sn_key BETWEEN '{fam}{lo}' AND '{fam}{hi}' THEN NULL ELSE 403 END"
    return d.withColumn(out, F.expr(f"CAST({st} AS INT)")).drop("_sn_key")


def _subnet_rows(cidrs: list[str]) -> list[dict]:
    return [dict(zip(("cidr", "family", "lo", "hi", "bits"), (c, *netaddr.cidr_bounds(c)))) for c in cidrs]


def subnet_table(spark, cidrs: list[str]) -> DataFrame:
    """Configured subnets -> (cidr, family, lo, hi, bits); parsed on the driver."""
    return spark.createDataFrame(_subnet_rows(cidrs), "cidr string, family int, lo string, hi string, bits int")


def address_segments(rows) -> list[tuple[str, list[str]]]:
    """Disjoint segments of the address space, by a sweep over the bounds of
    (cidr, family, lo, hi) rows: (first key, the subnets that hold all of
    it), in order. A segment ends where the next one starts; keys are those
    of `netaddr.with_key`, whose order is that of family and number."""
    points: dict[str, tuple[list[str], list[str]]] = {"": ([], [])}
    for r in rows:
        width = len(r["lo"])
        after = int(r["hi"], 16) + 1
        # beyond the last address of a family comes the next family's mark
        end = f"{r['family']}{after:0{width}x}" if after < 16**width else str(r["family"] + 1)
        points.setdefault(f"{r['family']}{r['lo']}", ([], []))[0].append(r["cidr"])
        points.setdefault(end, ([], []))[1].append(r["cidr"])
    inside: list[str] = []
    out = []
    for key in sorted(points):
        starting, ending = points[key]
        inside = [*inside, *starting]
        for cidr in ending:
            inside.remove(cidr)
        out.append((key, list(inside)))
    return out


def _segment_of(key: str, starts: list[str], first: int, end: int) -> str:
    """SQL: the number of the segment that holds a key, by a balanced tree of comparisons."""
    if end - first == 1:
        return str(first)
    middle = (first + end) // 2
    below, above = _segment_of(key, starts, first, middle), _segment_of(key, starts, middle, end)
    return f"CASE WHEN {key} < '{starts[middle]}' THEN {below} ELSE {above} END"


def addresses_in_subnets(addresses: DataFrame, subnets: DataFrame | list[str], ip_col: str = "ip",
                         tree_subnets: int = 64) -> DataFrame:
    """Pairs of addresses and the subnets (a table, or CIDR texts) that contain them.

    Up to `tree_subnets` subnets (a checked size) are flattened into
    disjoint segments; an address is one row that finds its segment by a
    few comparisons in generated code, and the segment lists its subnets:
    no join and no shuffle. A larger table of subnets is joined: see
    `join_subnets`.
    """
    if isinstance(subnets, DataFrame):
        some = subnets.select("cidr", "family", "lo", "hi").limit(tree_subnets + 1).collect()
    else:
        some = _subnet_rows(subnets)
    if len(some) > tree_subnets:
        table = subnets if isinstance(subnets, DataFrame) else subnet_table(addresses.sparkSession, subnets)
        return join_subnets(addresses, table, ip_col)
    segments = address_segments(some)
    keyed = netaddr.with_key(addresses, f"trim(`{ip_col}`)", "_key")
    # generator output: filters inferred from the last explode stay above the parse (see barrier.py)
    keyed = keyed.select(*addresses.columns, F.explode_outer(F.array("_key")).alias("_key"))
    number = F.expr(_segment_of("_key", [k for k, _ in segments], 0, len(segments)))
    cidrs = F.array(*(F.array(*map(F.lit, c)).cast("array<string>") for _, c in segments))
    held = F.when(F.col("_key").isNotNull(), F.element_at(cidrs, number + 1))
    return keyed.select(*addresses.columns, F.explode(held).alias("cidr"))


def join_subnets(addresses: DataFrame, subnets: DataFrame, ip_col: str = "ip") -> DataFrame:
    """D4 for any number of subnets.

    An address is masked to every prefix length that the subnet table holds
    for its family (at most 33 and 129 lengths), and (family, length,
    network) meets the subnets by equality. One plan at every size: an
    address costs as many rows as there are lengths, never a test against
    each subnet, and Spark picks a broadcast or a shuffle join (whose hot
    networks AQE splits) from the sizes.
    """
    lengths = sorted((r["family"], r["bits"]) for r in subnets.select("family", "bits").distinct().collect())
    # the parsed address is generator output: the join's inferred
    # `_a IS NOT NULL` filters then stay above the parse instead of being
    # pushed into the scan with the whole parse inlined (see barrier.py)
    keyed = netaddr.with_key(addresses, f"trim(`{ip_col}`)", "_a_key")
    a = keyed.select("*", F.explode_outer(F.array(netaddr.key_struct("_a_key"))).alias("_a")).drop("_a_key")
    networks = F.filter(F.array(*(F.when(
        (F.col("_a.family") == fam) & ~F.col("_a.zoned"),
        F.struct(F.lit(fam).alias("family"), F.lit(bits).alias("bits"), netaddr.network_hex(F.col("_a.hex"), fam, bits).alias("lo")))
        for fam, bits in lengths)), lambda n: n.isNotNull())
    masked = a.select(*addresses.columns, F.explode(networks).alias("_n")).select(
        *addresses.columns, F.col("_n.family").alias("_fam"), F.col("_n.bits").alias("_bits"), F.col("_n.lo").alias("_lo"))
    s = subnets.select("cidr", F.col("family").alias("_fam"), F.col("bits").alias("_bits"), F.col("lo").alias("_lo"))
    return masked.join(s, ["_fam", "_bits", "_lo"]).drop("_fam", "_bits", "_lo")
