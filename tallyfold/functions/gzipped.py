"""Gzip bodies. The JVM functions of Spark hold no gzip codec for a column,
so these are Arrow-batched functions; callers pass NULL for the rows that
are not gzip, which cost nothing but their place in the batch."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The first bytes of a gzip member and the length of its header.
MAGIC = b"\x1f\x8b\x08"
HEADER_BYTES = 10
NO_HEADER = 500   # the body does not open as gzip
BROKEN = 400      # it opens, but reading it fails


def open_gzip(body: bytes | None) -> tuple[int | None, bytes | None]:
    """(status, data): status is NULL for a good body."""
    if body is None:
        return None, None
    if len(body) < HEADER_BYTES or not body.startswith(MAGIC):
        return NO_HEADER, None
    try:
        return None, gzip.decompress(body)
    except (OSError, EOFError, zlib.error):
        return BROKEN, None


_OPENED = T.StructType([T.StructField("status", T.IntegerType()), T.StructField("data", T.BinaryType())])


@F.pandas_udf(_OPENED)
def gunzip(bodies: pd.Series) -> pd.DataFrame:
    rows = [open_gzip(b) for b in bodies]
    return pd.DataFrame({"status": pd.array([s for s, _ in rows], dtype="Int32"), "data": [d for _, d in rows]})


@F.pandas_udf(T.BinaryType())
def gzipped(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: None if b is None else gzip.compress(b, mtime=0))
