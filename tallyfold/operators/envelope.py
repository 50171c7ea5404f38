"""Encrypted bodies (A10, B9): AES-256-GCM with a data key per key id.

Spark's GCM layout is nonce(12) || ciphertext || tag(16); the envelope
carries the nonce in `n` and ciphertext||tag in `d` (base64), so opening
is `try_aes_decrypt(unbase64(n) || unbase64(d), key, 'GCM')`. The RSA
wrap of the data key is replaced by a key table joined by key id (`k`
holds the base64 key id). The key table is configuration, one row per data
key, so it is broadcast: most requests have no key id and the others share
a few, and a shuffle by key id would send them all to a few tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.schemas import ENVELOPE_DDL

# Envelope header value, algorithm name and version.
HEADER_VALUE = "aes256gcm+rsa-oaep;v=1"
ALG = "aes256gcm+rsa-oaep"
VERSION = 1
NONCE_BYTES = 12
_ENV_DDL = f"{ENVELOPE_DDL}, _c STRING"
_B64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def b64(x) -> Column:
    """Standard base64 on one line (Spark wraps lines at 76 characters)."""
    return F.regexp_replace(F.base64(_col(x)), r"[\r\n]", "")


def _unwrap(x: Column) -> Column:
    """Line breaks are ignored by the decoder, as Go's does."""
    return F.regexp_replace(x, r"[\r\n]", "")


def seal(body, data_key, key_id, iv=None) -> Column:
    """Body -> envelope JSON. A random nonce is drawn unless `iv`
    (12 bytes) is given."""
    b = _col(body).cast("binary")
    if iv is None:
        sealed = F.aes_encrypt(b, _col(data_key), F.lit("GCM"))
    else:
        sealed = F.aes_encrypt(b, _col(data_key), F.lit("GCM"), F.lit("DEFAULT"), _col(iv))
    # the cipher text is bound once: a second evaluation would draw another nonce
    parts = F.get(F.transform(F.array(sealed), lambda c: F.struct(
        b64(F.substring(c, 1, NONCE_BYTES)).alias("n"), b64(F.substr(c, F.lit(NONCE_BYTES + 1))).alias("d"))), 0)
    key = b64(_col(key_id).cast("binary"))
    text = F.get(F.transform(F.array(parts), lambda p: F.to_json(F.struct(
        F.lit(ALG).alias("alg"), key.alias("k"), p["n"].alias("n"), p["d"].alias("d"), F.lit(VERSION).alias("v")))), 0)
    return F.when(sealed_input(body, data_key), text)


def sealed_input(body, data_key) -> Column:
    """Both a body and a key are there (else the envelope is NULL)."""
    return _col(body).isNotNull() & _col(data_key).isNotNull()


def damaged(envelope_text) -> Column:
    """An envelope whose cipher text has another first letter (fixtures)."""
    return F.get(F.transform(F.array(F.from_json(_col(envelope_text), ENVELOPE_DDL)), lambda e: F.to_json(e.withField(
        "d", F.concat(F.when(F.substr(e["d"], F.lit(1), F.lit(1)) == "A", "B").otherwise("A"), F.substr(e["d"], F.lit(2)))))), 0)


def open_envelopes(requests: DataFrame, keys: DataFrame | None, body_col: str = "body",
                   header_col: str = "x_encrypted") -> DataFrame:
    """A10: adds `plain` (bytes of the decrypted body, or of the body itself
    when not encrypted) and `decrypt_status` (NULL ok, 400 bad envelope/auth, 500
    encrypted but no key configured)."""
    hdr = F.col(header_col)
    env = F.from_json(F.col(body_col).cast("string"), _ENV_DDL, {"columnNameOfCorruptRecord": "_c"})
    df = requests.withColumn("_env", F.when(hdr.isNotNull() & (hdr != ""), env))
    df = df.withColumn("_env", F.col("_env").withField("n", _unwrap(F.col("_env.n")))
                       .withField("d", _unwrap(F.col("_env.d")))
                       .withField("k", _unwrap(F.col("_env.k"))))
    kid = F.when(F.col("_env.k").rlike(_B64), F.unbase64(F.col("_env.k")).cast("string"))
    df = df.withColumn("_kid", kid)
    if keys is not None:
        k = keys.select(F.col("key_id").alias("_kid2"), F.col("data_key").alias("_dk"))
        df = df.join(F.broadcast(k), df["_kid"] == k["_kid2"], "left").drop("_kid2")
    else:
        df = df.withColumn("_dk", F.lit(None).cast("binary"))
    e = F.col("_env")
    b64_ok = F.col("_env.n").rlike(_B64) & F.col("_env.d").rlike(_B64) & kid.isNotNull()
    envelope_ok = (
        e.isNotNull() & e["_c"].isNull() & (e["alg"] == ALG) & (e["v"] == VERSION)
        & (F.coalesce(e["k"], F.lit("")) != "") & (F.coalesce(e["n"], F.lit("")) != "")
        & (F.coalesce(e["d"], F.lit("")) != "") & b64_ok
    )
    nonce = F.unbase64(e["n"])
    opened = F.try_aes_decrypt(F.concat(nonce, F.unbase64(e["d"])), F.col("_dk"), F.lit("GCM"))
    no_hdr = hdr.isNull() | (hdr == "")
    status = (
        F.when(no_hdr, F.lit(None))
        .when(F.lit(keys is None), F.lit(500))
        .when(hdr != HEADER_VALUE, F.lit(400))
        .when(~envelope_ok, F.lit(400))
        .when(F.octet_length(nonce) != NONCE_BYTES, F.lit(400))
        .when(F.col("_dk").isNull() | opened.isNull(), F.lit(400))
    ).cast("int")
    plain = F.when(no_hdr, F.col(body_col).cast("binary")).when(status.isNull(), opened)
    return df.withColumn("decrypt_status", status).withColumn("plain", plain) \
             .drop("_env", "_kid", "_dk")
