"""Runs registered queries against their DuckDB twins: `python -m tests.try_checks FOLDER [NAME...]`."""

from __future__ import annotations

import os
import sys
import time

import __spark_entry__ as driver
from docsluice.session import local_session
from tests.compare import connect, differences


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("TRY_ZONE", "UTC"))
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, oracles = driver.queries(), driver.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and not any(name == part or (part.endswith('.') and query.__module__.endswith(part[:-1])) for part in wanted):
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            if name in oracles:
                found = differences(frame, connection, oracles[name])
            else:
                found = [] if frame.count() > 0 else ["no rows"]
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        mark = "FAIL" if found else ("ok  " if name in oracles else "rows")
        print(f"\n{mark} {name} {time.time() - start:.1f}s", *[f"\n     {line[:700]}" for line in found[:2]], flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
