"""Report renderings of the state.

All of them are projections of the state (one row per key), so they
scale with the number of keys, not with the update volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.render import float_fixed6, float_shortest, int_text
from tallyfold.schemas import COUNTER, GAUGE


def state_list(state: DataFrame) -> DataFrame:
    """One (section, name, value_text) row per key, in one pass over
    the state. Gauges print with `%f`, counters with `%d`."""
    t = F.col("type")
    text = F.when(t == GAUGE, float_fixed6(F.when(t == GAUGE, F.col("value")))).when(t == COUNTER, int_text("delta"))
    return state.select(t.alias("section"), "name", text.alias("value_text"))


def plain_value(type_col="type", delta_col="delta", value_col="value") -> Column:
    """B10 plain text: `%d` for counters, shortest `'g'` text for gauges."""
    t = F.col(type_col)
    return (F.when(t == COUNTER, int_text(delta_col))
            .when(t == GAUGE, float_shortest(value_col)))


def json_value(id_col="id", type_col="type", delta_col="delta", value_col="value") -> Column:
    """B10 JSON object with NULL fields omitted."""
    return F.to_json(F.struct(
        F.col(id_col).alias("id"), F.col(type_col).alias("type"),
        F.col(delta_col).alias("delta"), F.col(value_col).alias("value")))


def path_record(type_col="type", id_col="id", delta_col="delta", value_col="value") -> Column:
    """Outgoing `/update/{type}/{name}/{value}` with `%d` / `%f`."""
    t = F.col(type_col)
    text = F.when(t == COUNTER, int_text(delta_col)).when(t == GAUGE, float_fixed6(value_col))
    return F.concat_ws("/", F.lit("/update"), t, F.col(id_col), text)
