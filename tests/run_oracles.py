"""Run every proof query against its DuckDB oracle (like the driver does).

usage: python tests/run_oracles.py [sf_dir] [name-substring ...]
"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import compare, duck_connect  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from labelforge.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("local[8]", 8)
    con = duck_connect(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            if name in os_:
                problems, ns, nd = compare(spark, con, fn, os_[name], sf_dir)
            else:
                ns = fn(spark, sf_dir).count(); nd = None; problems = []
        except Exception as e:  # noqa: BLE001
            problems, ns, nd = [f"error: {type(e).__name__}: {str(e)[:800]}"], None, None
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        kind = "O" if name in os_ else "rows"
        print(f"{status} {name:28s} {kind:4s} spark={ns} duck={nd} {time.time()-t:.1f}s", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print(f"done: {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
