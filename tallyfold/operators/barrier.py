"""Filtering on a costly derived column.

`df.where(cond)` on a column computed by earlier projections is pushed
down by Catalyst: the column's definition is substituted into the filter,
so the expensive expression (JSON decoding, HMAC, ...) is evaluated twice
and the inlined tree can outgrow code generation. A predicate over a
generator's output is never pushed below the generator, so `late_filter`
routes the condition through `explode_outer` of a one-element array:
the row count is unchanged and the decision is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def late_filter(df: DataFrame, cond: Column) -> DataFrame:
    keep = F.explode_outer(F.when(cond, F.array(F.lit(True))))
    return df.select("*", keep.alias("_keep")).where(F.col("_keep")).drop("_keep")
