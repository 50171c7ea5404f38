"""Spark-vs-DuckDB comparison in the driver's manner: row count, column
names and an order-insensitive hash of the values (columns sorted by name)."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return round(v, digits) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits) + 0.0
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True), digits)
    return v


def value_hash(names, rows, digits: int = 6) -> str:
    order = sorted(range(len(names)), key=lambda i: names[i])
    normed = sorted(repr(tuple(_norm(r[i], digits) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(normed).encode()).hexdigest()


def compare(spark_df, sql: str, con) -> dict:
    s_names = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_names = rel.columns
    d_rows = rel.fetchall()
    res = {
        "rows_spark": len(s_rows),
        "rows_oracle": len(d_rows),
        "schema_match": sorted(s_names) == sorted(d_names),
        "names": (sorted(s_names), sorted(d_names)),
    }
    res["rows_match"] = res["rows_spark"] == res["rows_oracle"]
    res["hash_match"] = res["schema_match"] and value_hash(s_names, s_rows) == value_hash(d_names, d_rows)
    if not res["hash_match"] and res["schema_match"]:
        order_s = sorted(range(len(s_names)), key=lambda i: s_names[i])
        order_d = sorted(range(len(d_names)), key=lambda i: d_names[i])
        ss = sorted(repr(tuple(_norm(r[i], 6) for i in order_s)) for r in s_rows)
        dd = sorted(repr(tuple(_norm(r[i], 6) for i in order_d)) for r in d_rows)
        res["only_spark"] = sorted(set(ss) - set(dd))[:3]
        res["only_oracle"] = sorted(set(dd) - set(ss))[:3]
    return res
