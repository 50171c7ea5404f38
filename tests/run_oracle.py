"""Run registered queries against their DuckDB oracle (CLI helper).

    python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck_connection  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tallyfold.session import build_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session(extra={"spark.master": "local[8]", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": "1m"})
    con = duck_connection(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                res = compare(df, sqls[name], con)
            else:
                res = {"rows_spark": df.count(), "oracle": None}
        except Exception as e:  # report and go on
            res = {"error": f"{type(e).__name__}: {str(e)[:600]}"}
        res["sec"] = round(time.time() - t0, 2)
        ok = res.get("hash_match") or (res.get("oracle", 1) is None and "error" not in res)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + name, json.dumps(res, default=str)[:900], flush=True)
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
