"""Run registered queries against their oracles: python tests/check.py [prefix ...] [--sf 0.01]."""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from millrace.session import local_session  # noqa: E402
from tests import oracle  # noqa: E402


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("prefix", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--tz", default="UTC")
    parser.add_argument("--oracle-only", action="store_true")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session(8, **{"spark.sql.session.timeZone": args.tz})
    con = oracle.connect(folder)
    sqls = contract.oracle_sql()
    bad = 0
    for name, fn in contract.queries().items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        if args.oracle_only and name not in sqls:
            continue
        start = time.perf_counter()
        try:
            df = fn(spark, folder)
            mine = oracle.spark_table(df)
            took = time.perf_counter() - start
            if name in sqls:
                note = oracle.difference(mine, oracle.duck_table(con, sqls[name]))
                types = dict(df.dtypes)
            else:
                note, types = None, {}
            state = "ok " if note is None else "BAD"
            tag = "" if name in sqls else "(rows only)"
            print(f"{state} {name} {took:.2f}s rows={len(mine[1])} {tag} {note or ''}", flush=True)
            if any("decimal" in v for v in types.values()):
                print("    decimal column:", types)
            bad += note is not None
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERR {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
