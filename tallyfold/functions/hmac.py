"""HMAC-SHA256 as a native expression (RFC 2104), no UDF.

    hmac(K, m) = H((K0 ^ opad) || H((K0 ^ ipad) || m))

With one configured key the two 64-byte pads are built once on the
driver and enter the plan as binary literals, so the per-row work is
two `sha2` calls inside whole-stage codegen. A per-row key column is
also supported; its pads are built with byte expressions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
# HMAC inner and outer pad bytes.
IPAD_BYTE = 0x36
OPAD_BYTE = 0x5C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_pads(key: str | bytes) -> tuple[bytes, bytes]:
    k = key.encode("utf-8") if isinstance(key, str) else bytes(key)
    if len(k) > BLOCK:
        k = hashlib.sha256(k).digest()
    k = k.ljust(BLOCK, b"\x00")
    return bytes(b ^ IPAD_BYTE for b in k), bytes(b ^ OPAD_BYTE for b in k)


def _as_binary(msg) -> Column:
    m = _col(msg)
    return m.cast("binary")


def hmac_sha256_hex(msg, key: str | bytes) -> Column:
    """Lower-case hex HMAC-SHA256 of `msg` (string -> UTF-8 bytes, or binary)."""
    ipad, opad = key_pads(key)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), _as_binary(msg)), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)


def _xor_pad(key_block: Column, pad_byte: int) -> Column:
    """64-byte binary key block XOR a constant byte, via hex digits."""
    idx = F.sequence(F.lit(1), F.lit(BLOCK))
    hex_bytes = F.transform(
        idx,
        lambda i: F.lpad(
            F.hex(F.conv(F.hex(F.substring(key_block, i, 1)), 16, 10).cast("int")
                  .bitwiseXOR(F.lit(pad_byte))),
            2, "0"),
    )
    return F.unhex(F.array_join(hex_bytes, ""))


def hmac_sha256_hex_keycol(msg, key) -> Column:
    """HMAC-SHA256 with a per-row key column (string or binary)."""
    k = _col(key).cast("binary")
    k = F.when(F.octet_length(k) > BLOCK, F.unhex(F.sha2(k, 256))).otherwise(k)
    block = F.rpad(k, BLOCK, F.lit(b"\x00"))
    inner = F.unhex(F.sha2(F.concat(_xor_pad(block, IPAD_BYTE), _as_binary(msg)), 256))
    return F.sha2(F.concat(_xor_pad(block, OPAD_BYTE), inner), 256)


def signature_matches(hash_col, msg, key: str | bytes) -> Column:
    """True when the hex text (any case) equals the HMAC of `msg`."""
    return F.lower(_col(hash_col)) == hmac_sha256_hex(msg, key)


def sign_response(body, key: str | bytes | None) -> Column:
    """Response signature: none without a key or for an empty body."""
    b = _col(body)
    if not key:
        return F.lit(None).cast("string")
    return F.when(b.isNotNull() & (F.octet_length(b) > 0), hmac_sha256_hex(b, key))
