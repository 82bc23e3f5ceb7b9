"""Compare registered queries with their SQL: python tests/run_checks.py SF_DIR [prefix ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from depsignal.session import local_session  # noqa: E402


def main():
    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                found = difference(spark, con, query, oracles[name], sf)
            else:
                found = f"no sql, {query(spark, sf).count()} rows"
        except Exception as e:
            found = "ERROR " + "".join(traceback.format_exception_only(e))[:900]
        bad += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {time.time() - start:5.1f}s {name} {found or ''}", flush=True)
    print("differences:", bad)


main()
