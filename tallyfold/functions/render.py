"""Number text in the wire/report formats.

`%d` is a native cast. The float forms need exact decimal conversion of
the binary value: the JVM's `Double.toString` (JDK 17) is not always the
shortest round-trip text, and `format_string('%f')` rounds half-up on
that text (5e-7 -> 0.000001 where exact rounding gives 0.000000). Both
are therefore Arrow-batched pandas UDFs over Python's correctly rounded
formatting; they only touch report rows (one per state key), never the
update stream.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _special(x: float) -> str | None:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return None


def shortest_text(x: float) -> str:
    """Shortest round-trip text; exponent form when the decimal exponent is
    below -4 or at least 6 (Go `'g'` with precision -1)."""
    s = _special(x)
    if s is not None:
        return s
    if x == 0:
        return "-0" if math.copysign(1.0, x) < 0 else "0"
    r = repr(abs(x))
    mant, _, exp_txt = r.partition("e")
    exp10 = int(exp_txt) if exp_txt else 0
    int_part, _, frac = mant.partition(".")
    digits = (int_part + frac).lstrip("0")
    lead_zeros = len(int_part + frac) - len((int_part + frac).lstrip("0"))
    dp = len(int_part) + exp10 - lead_zeros
    digits = digits.rstrip("0") or "0"
    exp = dp - 1
    sign = "-" if x < 0 else ""
    if exp < -4 or exp >= 6:
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
        return f"{sign}{body}e{'-' if exp < 0 else '+'}{abs(exp):02d}"
    if dp <= 0:
        return f"{sign}0.{'0' * (-dp)}{digits}"
    if dp >= len(digits):
        return f"{sign}{digits}{'0' * (dp - len(digits))}"
    return f"{sign}{digits[:dp]}.{digits[dp:]}"


def fixed6_text(x: float) -> str:
    """`%f`: six decimals, exact rounding of the binary value."""
    s = _special(x)
    if s is not None:
        return s
    return f"{x:.6f}"


@F.pandas_udf(T.StringType())
def _shortest_udf(v: pd.Series) -> pd.Series:
    # NULL rows arrive as NaN; the caller masks them with `when`.
    return v.astype("float64").map(shortest_text)


@F.pandas_udf(T.StringType())
def _fixed6_udf(v: pd.Series) -> pd.Series:
    return v.astype("float64").map(fixed6_text)


def float_shortest(x) -> Column:
    """Go `FormatFloat(v, 'g', -1, 64)` text."""
    c = _col(x)
    return F.when(c.isNotNull(), _shortest_udf(c))


def float_fixed6(x) -> Column:
    """Go `%f` text."""
    c = _col(x)
    return F.when(c.isNotNull(), _fixed6_udf(c))


def int_text(x) -> Column:
    """Go `%d` text."""
    return _col(x).cast("string")


def unix_seconds(ts) -> Column:
    """Unix seconds (floor) of a TIMESTAMP_NTZ event time: independent of
    the session time zone, never the wall clock."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", epoch, _col(ts).cast("timestamp_ntz"))


_EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_as_utc(ts) -> Column:
    """TIMESTAMP_NTZ wall time read as UTC -> TIMESTAMP (for watermarks),
    whatever the session time zone."""
    epoch = F.lit(_EPOCH_NTZ).cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, _col(ts)))


def utc_as_ntz(ts) -> Column:
    """Inverse of `ntz_as_utc`."""
    epoch = F.lit(_EPOCH_NTZ).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(_col(ts)), epoch)
