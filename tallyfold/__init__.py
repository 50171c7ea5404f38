"""tallyfold — bulk metric ingestion, folding and reporting on Spark.

Counters add up, gauges keep their last value; every check, fold, lookup
and report is a DataFrame operator planned by Catalyst.
"""

from tallyfold.schemas import (  # noqa: F401
    JOURNAL_SCHEMA,
    REQUEST_SCHEMA,
    STATE_SCHEMA,
    UPDATE_SCHEMA,
)

__all__ = ["UPDATE_SCHEMA", "STATE_SCHEMA", "REQUEST_SCHEMA", "JOURNAL_SCHEMA"]
