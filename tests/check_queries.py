"""Run registered queries against their DuckDB SQL: python tests/check_queries.py SF [name ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import connect, differences  # noqa: E402
from conftest import make_spark  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> None:
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    unknown = set(oracles) - set(queries)
    if unknown:
        print("oracle without query:", sorted(unknown))
    spark, con = make_spark(), connect(sf_dir)
    failed = 0
    for name, query in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                diff = differences(query(spark, sf_dir), con, oracles[name])
            else:
                rows = query(spark, sf_dir).toArrow()
                diff = [] if rows.num_rows else ["no rows"]
                if names:
                    print(rows.slice(0, 12).to_pandas().to_string()[:3000])
        except Exception as error:
            diff = ["raised " + "".join(traceback.format_exception(error))[-1500:] if names else str(error)[:300]]
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {'o' if name in oracles else 'r'} {time.time() - start:6.1f}s {name}", flush=True)
        for line in diff:
            print("     ", line)
    print("failed:", failed)


main()
