"""DuckDB SQL fragments that restate the fixture derivations of
`tallyfold.sources.tables` for the oracle queries."""

from __future__ import annotations


def event_items_sql(framing: str = "batch", inject_invalid: bool = True) -> str:
    if framing == "batch":
        rid, pos = "CAST(event_id // 20 AS BIGINT)", "CAST(event_id % 20 AS INTEGER)"
    else:
        rid, pos = "event_id", "CAST(0 AS INTEGER)"
    if inject_invalid:
        typ = ("CASE WHEN event_id % 41 = 0 THEN 'unknown' "
               "WHEN event_id % 2 = 0 THEN 'counter' ELSE 'gauge' END")
        has = "event_id % 37 <> 0"
    else:
        typ = "CASE WHEN event_id % 2 = 0 THEN 'counter' ELSE 'gauge' END"
        has = "TRUE"
    return f"""
    SELECT {rid} AS request_id, {pos} AS pos, event_id AS seq, ts,
           CASE WHEN event_id % 2 = 0 THEN event_type
                ELSE 'user_' || CAST(user_id AS VARCHAR) END AS id,
           {typ} AS type,
           CASE WHEN event_id % 2 = 0 AND {has}
                THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS delta,
           CASE WHEN event_id % 2 = 1 AND {has} THEN value END AS value
    FROM events"""


VALID = """(id IS NOT NULL AND id <> '' AND type IS NOT NULL AND type <> ''
            AND ((type = 'counter' AND delta IS NOT NULL)
                 OR (type = 'gauge' AND value IS NOT NULL)))"""

INVALID = f"(NOT {VALID})"

REASON = """CASE WHEN id IS NULL OR id = '' OR type IS NULL OR type = ''
                  THEN 'missing required fields: id or type'
             WHEN type = 'counter' AND delta IS NULL THEN 'missing required field: delta'
             WHEN type = 'gauge' AND value IS NULL THEN 'missing required field: value'
             WHEN type NOT IN ('counter', 'gauge') THEN 'unknown metric type: ' || type
        END"""

FOLD_SELECT = """SELECT id AS name, type,
           CAST(sum(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
           arg_max(CASE WHEN type = 'gauge' THEN value END,
                   CASE WHEN type = 'gauge' THEN seq END) AS value"""

LINEITEM_COUNTERS = """
    SELECT l_returnflag || '_' || l_linestatus AS id, 'counter' AS type,
           CAST(l_quantity AS BIGINT) AS delta, CAST(NULL AS DOUBLE) AS value,
           CAST(NULL AS BIGINT) AS seq
    FROM lineitem"""
