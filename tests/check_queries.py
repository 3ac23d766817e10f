"""Run registered queries against DuckDB: ``python tests/check_queries.py [sf_dir] [name prefix ...]``.

With ``SHUFFLE_JOINS=1`` no join is broadcast unless it is hinted, as on tables too large for it.
"""

import os
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from fathomline.session import local_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402

path = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
prefixes = tuple(sys.argv[2:])
spark = local_session("8")
if os.environ.get("SHUFFLE_JOINS"):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
con = connect(path)
oracle = oracle_sql()
bad = 0
for name, run in queries().items():
    if prefixes and not name.startswith(prefixes):
        continue
    start = time.time()
    try:
        df = run(spark, path)
        found = difference(df, con, oracle[name]) if name in oracle else f"{df.count()} rows, no oracle"
        rows = df.count() if found is None else ""
    except Exception as error:  # report and go on with the next query
        found, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        if "-v" in prefixes:
            traceback.print_exc()
    bad += found is not None and not found.endswith("no oracle")
    print(f"{time.time() - start:6.2f}s {name}: {'ok ' + str(rows) if found is None else found}", flush=True)
print("failing:", bad)
