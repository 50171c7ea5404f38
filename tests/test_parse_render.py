import math

import pytest
from pyspark.sql import functions as F

from tallyfold.functions.parse import parse_float64, parse_int64
from tallyfold.functions.render import fixed6_text, float_fixed6, float_shortest, shortest_text

INT_CASES = [("100", 100), ("-100", -100), ("+7", 7), ("100.0", None), ("NaN", None), ("", None),
             (" 5 ", None), ("9223372036854775807", 9223372036854775807),
             ("9223372036854775808", None), ("1e3", None)]
FLOAT_CASES = [("100.01", 100.01), ("-100.01", -100.01), ("100", 100.0), (".5", 0.5), ("5.", 5.0),
               ("1e3", 1000.0), ("1E-2", 0.01), ("none", None), ("1d", None), ("1f", None),
               ("1e400", None), ("", None), ("inf", math.inf), ("-Infinity", -math.inf),
               ("+inf", math.inf), ("nan", "nan"), ("NaN", "nan"), ("-nan", None), (" 1", None)]


def test_int_parse(spark):
    df = spark.createDataFrame([(t,) for t, _ in INT_CASES], "t string")
    got = dict(df.select("t", parse_int64("t").alias("v")).collect())
    for t, want in INT_CASES:
        assert got[t] == want, t


def test_float_parse(spark):
    df = spark.createDataFrame([(t,) for t, _ in FLOAT_CASES], "t string")
    got = dict(df.select("t", parse_float64("t").alias("v")).collect())
    for t, want in FLOAT_CASES:
        if want == "nan":
            assert math.isnan(got[t]), t
        else:
            assert got[t] == want, t


@pytest.mark.parametrize("x,text", [
    (100.0, "100"), (1e6, "1e+06"), (1234567.0, "1.234567e+06"), (123456.0, "123456"),
    (0.0001, "0.0001"), (0.00001, "1e-05"), (42.123, "42.123"), (100.5, "100.5"),
    (1e-9, "1e-09"), (-0.0, "-0"), (0.0, "0"), (math.nan, "NaN"), (math.inf, "+Inf"),
    (-math.inf, "-Inf"), (1e21, "1e+21"), (5e-324, "5e-324")])
def test_shortest_text(x, text):
    assert shortest_text(x) == text


@pytest.mark.parametrize("x,text", [
    (5e-7, "0.000000"), (1.5, "1.500000"), (1.234567, "1.234567"), (-2.0, "-2.000000"),
    (math.inf, "+Inf"), (math.nan, "NaN")])
def test_fixed6_text(x, text):
    assert fixed6_text(x) == text


def test_render_columns(spark):
    df = spark.createDataFrame([(1.0e6,), (None,), (0.1,)], "v double")
    got = df.select(float_shortest("v").alias("g"), float_fixed6("v").alias("f")).collect()
    assert [(r.g, r.f) for r in got] == [("1e+06", "1000000.000000"), (None, None),
                                         ("0.1", "0.100000")]
