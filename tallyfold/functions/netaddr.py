"""IP address and CIDR handling as native expressions.

An address is carried as `struct(family INT, hex STRING, zoned BOOLEAN)`:
`hex` is the address as fixed-width lower-case hex (8 digits for IPv4,
32 for IPv6), so string order equals unsigned numeric order and range
checks are plain comparisons. IPv4-mapped IPv6 addresses are unmapped to
IPv4; the two families never match each other; an IPv6 address with a
zone parses but is never inside a prefix.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decimal octet grammar (no leading zeros) and IPv4-mapped prefix.
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_TEXT = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
MAPPED_PREFIX = "00000000000000000000ffff"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ipv4_hex(t: str) -> str:
    """SQL: dotted IPv4 -> 8 hex digits, NULL if not a valid address: one
    validating regex, then plain string splitting into one number."""
    octets = (f"try_cast(substring_index(substring_index({t}, '.', {i}), '.', -1) AS BIGINT) * {256 ** (4 - i)}" for i in (1, 2, 3, 4))
    return f"CASE WHEN {t} RLIKE r'{IPV4_TEXT}' THEN lpad(lower(hex({' + '.join(octets)})), 8, '0') END"


# groups of up to four digits between colons; one `::` at most, no single colon at an end
IPV6_SHAPE = r"^(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:$)(?:[0-9a-f]{0,4}:){2,8}[0-9a-f]{0,4}$"


def _ipv6_hex(a: str) -> str:
    """SQL: IPv6 text (lower-case, no zone, no dotted tail) -> 32 hex
    digits, NULL if invalid."""
    n = f"size(regexp_extract_all({a}, r'[0-9a-f]+', 0))"
    filled = f"trim(BOTH ':' FROM replace({a}, '::', concat(':', repeat('0:', 8 - {n}))))"
    padded = f"replace(concat(':', {filled}), ':', ':000')"
    return (f"CASE WHEN {a} RLIKE r'{IPV6_SHAPE}' AND CASE WHEN contains({a}, '::') THEN {n} <= 7 ELSE {n} = 8 END "
            f"THEN regexp_replace({padded}, r':0*([0-9a-f]{{4}})', '$1') END")


def with_key(df: DataFrame, text: str, out: str, unmap: bool = True) -> DataFrame:
    """Adds `out`: the address in a text (a column name or SQL text) as one
    key string: '4' + 8 hex digits, '6' + 32 hex digits, 'z' + 32 hex digits
    for a zoned IPv6 address; NULL if it does not parse.

    The parts are columns of their own in few steps of SQL text: each is
    computed once and only where it can apply."""
    t, tail = f"_{out}_t", f"_{out}_tail"
    df = df.withColumn(t, F.expr(text if "(" in text else f"`{text}`"))
    # an IPv6 text without its zone, and the dotted tail of one that has it as two groups
    v6 = f"CASE WHEN contains(`{t}`, ':') AND substring_index(`{t}`, '%', -1) <> '' THEN lower(substring_index(`{t}`, '%', 1)) END"
    df = df.withColumn(f"{t}6", F.expr(v6))
    dotted = f"CASE WHEN contains(`{t}6`, '.') THEN {_ipv4_hex(f"substring_index(`{t}6`, ':', -1)")} END"
    df = df.withColumn(tail, F.expr(dotted))
    head = f"substr(`{t}6`, 1, length(`{t}6`) - length(substring_index(`{t}6`, ':', -1)))"
    plain = f"CASE WHEN contains(`{t}6`, '.') THEN concat({head}, substr(`{tail}`, 1, 4), ':', substr(`{tail}`, 5, 4)) ELSE `{t}6` END"
    df = df.withColumn(f"{t}6", F.expr(plain))
    key6 = f"concat(CASE WHEN contains(`{t}`, '%') THEN 'z' ELSE '6' END, {_ipv6_hex(f'`{t}6`')})"
    key = f"CASE WHEN contains(`{t}`, ':') THEN {key6} WHEN NOT contains(`{t}`, '%') THEN concat('4', {_ipv4_hex(f'`{t}`')}) END"
    df = df.withColumn(out, F.expr(key)).drop(t, f"{t}6", tail)
    if unmap:
        mapped = f"`{out}` LIKE '6{MAPPED_PREFIX}%'"
        df = df.withColumn(out, F.expr(f"CASE WHEN {mapped} THEN concat('4', substr(`{out}`, {len(MAPPED_PREFIX) + 2})) ELSE `{out}` END"))
    return df


def key_struct(key) -> Column:
    """struct(family, hex, zoned) from a key of `with_key`."""
    k = _col(key)
    return F.when(k.isNotNull(), F.struct(
        F.when(k.startswith("4"), F.lit(4)).otherwise(F.lit(6)).alias("family"),
        F.substring(k, 2, 32).alias("hex"),
        k.startswith("z").alias("zoned")))


def with_ip(df: DataFrame, text: str, out: str, unmap: bool = True) -> DataFrame:
    """Adds `out` = struct(family, hex, zoned), NULL if the text (a column
    name or SQL text) does not parse.

    IPv4: dotted decimal, no leading zeros. IPv6: with optional zone
    (`%name`, parses but is never inside a prefix); IPv4-mapped IPv6 is
    unmapped to IPv4 when `unmap`."""
    tmp = f"_{out}_key"
    return with_key(df, text, tmp, unmap).withColumn(out, key_struct(tmp)).drop(tmp)


def parse_ip_text(x: str | None) -> tuple | None:
    """Reference parse in Python (tests): (family, hex, zoned) or None."""
    if x is None:
        return None
    try:
        a = ipaddress.ip_address(x)
    except ValueError:
        return None
    if a.version == 4:
        return (4, f"{int(a):08x}", False)
    zoned = a.scope_id is not None
    if a.ipv4_mapped is not None and not zoned:
        return (4, f"{int(a.ipv4_mapped):08x}", False)
    return (6, f"{int(a):032x}", zoned)


def _mask_hex(hexed: Column, bits: Column, width: Column, fill_ones: bool) -> Column:
    """Keep the first `bits` bits of a hex address; set (or clear) the rest."""
    full = (bits / 4).cast("int")
    rem = bits % 4
    nib = F.conv(F.substring(hexed, full + 1, 1), 16, 10).cast("int")
    # bits of the partial nibble that belong to the prefix (rem = 1, 2, 3)
    keep = F.when(rem == 1, 8).when(rem == 2, 12).when(rem == 3, 14).otherwise(15)
    if fill_ones:
        nib_out = nib.bitwiseAND(keep).bitwiseOR(F.lit(15) - keep)
        rest = "f"
    else:
        nib_out = nib.bitwiseAND(keep)
        rest = "0"
    mid = F.when(rem == 0, F.lit("")).otherwise(F.lower(F.hex(nib_out)))
    head = F.substring(hexed, 1, full)
    used = full + F.when(rem == 0, 0).otherwise(1)
    return F.concat(head, mid, F.repeat(F.lit(rest), width - used))


def network_hex(hexed: Column, family: int, bits: int) -> Column:
    """The network of an address for a prefix length known when the plan is built."""
    return _mask_hex(hexed, F.lit(bits), F.lit(8 if family == 4 else 32), False)


def with_cidr(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds `out` = struct(family, lo, hi, bits) from CIDR text; NULL if
    invalid. The address part is kept as written (no unmapping, no zone);
    host bits need not be zero, as for a Go `netip.Prefix`."""
    d = df.withColumn("_cidr_t", F.trim(F.col(text_col))) \
        .withColumn("_cidr_addr", F.substring_index(F.col("_cidr_t"), "/", 1)) \
        .withColumn("_cidr_bits_t", F.when(F.col("_cidr_t").contains("/"),
                                            F.substring_index(F.col("_cidr_t"), "/", -1)))
    d = with_ip(d, "_cidr_addr", "_cidr_a", unmap=False)
    a = F.col("_cidr_a")
    bt = F.col("_cidr_bits_t")
    bits = F.when(bt.rlike(r"^(0|[1-9][0-9]{0,2})$"), bt.cast("int"))
    width = F.when(a["family"] == 4, 8).otherwise(32)
    d = d.withColumn("_cidr_bits", bits).withColumn("_cidr_w", width)
    b, w = F.col("_cidr_bits"), F.col("_cidr_w")
    ok = a.isNotNull() & ~a["zoned"] & b.isNotNull() & (b <= w * 4)
    d = d.withColumn(out, F.when(ok, F.struct(
        a["family"].alias("family"),
        _mask_hex(a["hex"], b, w, False).alias("lo"),
        _mask_hex(a["hex"], b, w, True).alias("hi"),
        b.alias("bits"))))
    return d.drop("_cidr_t", "_cidr_addr", "_cidr_bits_t", "_cidr_a", "_cidr_bits", "_cidr_w")


def cidr_bounds(cidr: str) -> tuple[int, str, str, int]:
    """Driver-side parse of one configured CIDR (raises on a bad one)."""
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    width = 8 if net.version == 4 else 32
    lo = f"{int(net.network_address):0{width}x}"
    hi = f"{int(net.broadcast_address):0{width}x}"
    return net.version, lo, hi, net.prefixlen


def in_prefix(addr: Column, family, lo, hi) -> Column:
    """Address struct inside [lo, hi] of the same family, zone never inside."""
    return (
        (addr["family"] == family)
        & ~addr["zoned"]
        & (addr["hex"] >= lo)
        & (addr["hex"] <= hi)
    )
