"""Compare all (or the named) registered queries with DuckDB: check_queries.py [sf] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from conftest import make_session  # noqa: E402

from tillroll.plans import registry  # noqa: E402

if __name__ == "__main__":
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:]
    spark = make_session()
    con = oracle.connect(sf_dir)
    sqls = registry.oracle_sql()
    bad = []
    for name, run in registry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = oracle.compare(run(spark, sf_dir), con, sqls[name])
            else:
                n = len(run(spark, sf_dir).collect())
                diff = None if n else "no rows"
        except Exception as error:
            if names:
                traceback.print_exc()
            diff = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql " if name in sqls else "rows"
        print(f"{'ok ' if diff is None else 'BAD'} {kind} {time.time() - start:6.2f}s {name}", flush=True)
        if diff:
            bad.append(name)
            print("        " + diff, flush=True)
    print("bad:", bad)
