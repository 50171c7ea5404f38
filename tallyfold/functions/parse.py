"""Strict number parsers (Column -> Column), all JVM-side.

Spark's casts are more lenient than the wire contract (they take blanks,
`1d`, `1f`, and turn `1e400` into infinity), so every cast is guarded by
the accepted grammar first. A NULL result means "does not parse".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted number grammars.
INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INF_TEXT = r"(?i)^[+-]?(inf|infinity)$"
NAN_TEXT = r"(?i)^nan$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_int64(text) -> Column:
    """Base-10 int64; NULL on anything else, including out-of-range values."""
    t = _col(text)
    return F.when(t.rlike(INT_TEXT), t.try_cast("bigint"))


def parse_float64(text) -> Column:
    """float64 text: decimal/exponent forms, inf/infinity (signed) and nan.

    A finite text whose value overflows is an error (NULL), not infinity.
    """
    t = _col(text)
    num = t.try_cast("double")
    return (
        F.when(t.rlike(FLOAT_TEXT) & ~F.isnan(num) & (F.abs(num) != F.lit(float("inf"))), num)
        .when(t.rlike(INF_TEXT) & t.startswith("-"), F.lit(float("-inf")))
        .when(t.rlike(INF_TEXT), F.lit(float("inf")))
        .when(t.rlike(NAN_TEXT), F.lit(float("nan")))
    )
