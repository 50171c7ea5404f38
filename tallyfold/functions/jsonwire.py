"""JSON wire decoding and encoding of update records.

Decoding keeps three outcomes apart, as the wire contract needs:
  * malformed or wrongly typed JSON, more than one value, or a missing
    body -> `bad` is true (status 400);
  * a well-formed record with missing fields -> fields NULL, `bad` false
    (validation decides, status 500); JSON `null` is an empty record;
  * JSON `null` or an empty array as a batch -> no items (status 200).

Every body is parsed once. A single record written the plain way (the known
fields in wire order, no escapes, numbers that surely fit) is told by one
pattern and decoded by `from_json`; any other body, and every batch, is
parsed to a variant. Only the four known top-level fields and `hash` are
looked at: their names match in any letter case (the exact name wins), the
last of repeated names counts, their JSON types must be those of the wire,
numbers must be finite, and whatever else a record holds is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wire fields and the JSON types they accept besides null.
FIELD_TYPES = {"id": "^STRING$", "type": "^STRING$", "delta": "^BIGINT$",
               "value": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$", "hash": "^STRING$"}
SQL_TYPES = {"id": "string", "type": "string", "delta": "bigint", "value": "double", "hash": "string"}

# A record as the agent's encoder writes it; no group repeats, so the length of a text does not matter.
PLAIN_RECORD = (r'^\{"id":"[^"\\\x00-\x1f]*+","type":"[^"\\\x00-\x1f]*+"(?:,"delta":-?(?:0|[1-9][0-9]{0,17}))?'
                r'(?:,"value":-?(?:0|[1-9][0-9]{0,99})(?:\.[0-9]{1,99})?(?:[eE][+-]?[0-9]{1,2})?)?\}$')
# Repeated names: the last one counts. Read when a plan is optimized, so it stays set in the session.
ALLOW_REPEATED = "spark.sql.variant.allowDuplicateKeys"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_update(id_col, type_col, delta_col, value_col) -> Column:
    """Wire JSON of one update; NULL fields are omitted."""
    return F.to_json(
        F.struct(
            _col(id_col).alias("id"),
            _col(type_col).alias("type"),
            _col(delta_col).alias("delta"),
            _col(value_col).alias("value"),
        )
    )


def _field(entries: Column, name: str) -> Column:
    """A top-level field of an object: the exact name, else any letter case."""
    other = F.map_values(F.map_filter(entries, lambda k, _: F.lower(k) == name))
    return F.coalesce(F.try_element_at(entries, F.lit(name)), F.get(other, 0))


def _entries(record: Column) -> Column:
    return F.struct(
        F.try_variant_get(record, "$", "map<string,variant>").alias("m"),
        F.is_variant_null(record).alias("empty"))


def _picked(e: Column) -> Column:
    """Variants of the known fields; `other` marks a value that is no object."""
    return F.struct(*(_field(e["m"], n).alias(n) for n in FIELD_TYPES),
                    (e["m"].isNull() & ~e["empty"]).alias("other"))


def _typed(f: Column) -> Column:
    return F.struct(*(F.struct(f[n].alias("v"), F.schema_of_variant(f[n]).alias("t")).alias(n) for n in FIELD_TYPES),
                    f["other"].alias("other"))


def _record(f: Column) -> Column:
    """struct(id, type, delta, value, hash, wrong)."""
    wrong, fields = f["other"], []
    for name, accepted in FIELD_TYPES.items():
        kind = f[name]["t"]
        fits = F.coalesce(kind.rlike(accepted), F.lit(False))
        wrong = wrong | ~(fits | F.coalesce(kind == "VOID", F.lit(True)))
        fields.append(F.when(fits, F.try_variant_get(f[name]["v"], "$", SQL_TYPES[name])).alias(name))
    return F.struct(*fields, wrong.alias("wrong"))


def _finite(r: Column) -> Column:
    """`wrong` also for a number beyond the double range."""
    value = r["value"]
    return r.withField("wrong", r["wrong"] | F.coalesce(F.abs(value) == F.lit(float("inf")), F.lit(False)))


def _with_value(df: DataFrame, body_col: str, value: str, cond: Column) -> DataFrame:
    """Adds `value`: the variant of the body, NULL unless the body's whole
    text is one JSON value. The body is parsed as the first element of an
    array whose second is a digest of the body, which no body can hold, so
    bytes after the value are noticed."""
    df.sparkSession.conf.set(ALLOW_REPEATED, "true")
    body = F.col(body_col).cast("string")
    digest = F.md5(F.col(body_col).cast("binary"))
    parsed = F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), digest, F.lit('"]')))
    d = df.withColumn(f"{value}_p", F.when(cond, parsed))
    whole = F.try_variant_get(f"{value}_p", "$[1]", "string") == digest
    return d.withColumn(value, F.when(F.col(f"{value}_p").isNotNull() & whole, F.try_variant_get(f"{value}_p", "$[0]", "variant"))).drop(f"{value}_p")


def _decoded(items: Column) -> Column:
    for stage in (_entries, _picked, _typed, _record, _finite):
        items = F.transform(items, stage)
    return items


def with_single(df: DataFrame, body_col: str, out: str, only_when: Column | None = None) -> DataFrame:
    """Adds `out` = struct(id, type, delta, value, hash, bad) for one JSON
    object per body; NULL where `only_when` is false. Fields are NULL when
    the body is bad."""
    cond = only_when if only_when is not None else F.lit(True)
    v, r, plain, simple = (f"_{out}_{x}" for x in "vrps")
    text = F.col(body_col).cast("string")
    d = df.withColumn(plain, F.coalesce(cond & text.rlike(PLAIN_RECORD), F.lit(False)))
    d = _with_value(d, body_col, v, cond & ~F.col(plain))
    d = d.withColumn(r, F.get(_decoded(F.when(F.col(v).isNotNull(), F.array(F.col(v)))), 0))
    bad = F.col(v).isNull() | F.coalesce(F.col(r)["wrong"], F.lit(True))
    fields = [F.when(~bad, F.col(r)[n]).alias(n) for n in FIELD_TYPES]
    d = d.withColumn(simple, F.from_json(F.when(F.col(plain), text), ", ".join(f"{n} {t}" for n, t in SQL_TYPES.items())))
    decoded = F.struct(*(F.col(simple)[n].alias(n) for n in FIELD_TYPES), F.lit(False).alias("bad"))
    other = F.when(cond, F.struct(*fields, bad.alias("bad")))
    return d.withColumn(out, F.when(F.col(plain), decoded).otherwise(other)).drop(v, r, plain, simple)


def with_batch(df: DataFrame, body_col: str, out: str, only_when: Column | None = None) -> DataFrame:
    """Adds `out` = struct(items, bad) for a JSON array per body; NULL where
    `only_when` is false. JSON `null` has no items; a missing body, any
    other value, or an item of a wrong type is bad."""
    cond = only_when if only_when is not None else F.lit(True)
    v, r = f"_{out}_v", f"_{out}_r"
    d = _with_value(df, body_col, v, cond)
    items = F.when(F.is_variant_null(v), F.array().cast("array<variant>")).otherwise(
        F.try_variant_get(v, "$", "array<variant>"))
    d = d.withColumn(r, _decoded(items))
    bad = F.col(r).isNull() | F.exists(r, lambda x: x["wrong"])
    kept = F.transform(r, lambda x: x.dropFields("wrong"))
    return d.withColumn(out, F.when(cond, F.struct(F.when(~bad, kept).alias("items"), bad.alias("bad")))).drop(v, r)
