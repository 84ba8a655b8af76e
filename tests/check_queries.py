"""Command line: compare registered queries with their SQL. Usage: check_queries.py [sf dir] [name prefix ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, duck  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from corpusflow.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1]
    prefixes = tuple(sys.argv[2:])
    spark, con = local_session("8"), duck(sf)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf, fn, sqls[name])
            else:
                n = len(fn(spark, sf).collect())
                problem = None if n else "no rows"
        except Exception as err:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(err))[:1500]
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:16s} {time.time() - t:6.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("failed:", bad)
