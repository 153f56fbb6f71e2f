"""Command line: list, run or explain the named queries.

    python -m kipmart list
    python -m kipmart run KEY [KEY ...] --data DIR --out DIR [--format parquet|json|csv]
    python -m kipmart explain KEY --data DIR

``--data`` is a folder of the generated tables (the fixture adapter derives
the shop tables from them). Outputs are written by Spark, one folder per key.
"""

from __future__ import annotations

import argparse
import sys

from kipmart import registry
from kipmart.session import build_session


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="kipmart")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("keys", nargs="+")
    r.add_argument("--data", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    r.add_argument("--master", default=None)
    r.add_argument("--profile", default="local", choices=["local", "cluster"])
    e = sub.add_parser("explain")
    e.add_argument("key")
    e.add_argument("--data", required=True)
    e.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    qs = registry.queries()
    if a.cmd == "list":
        for k in sorted(qs):
            print(k)
        return 0
    spark = build_session(a.master, profile=getattr(a, "profile", "local"))
    if a.cmd == "explain":
        qs[a.key](spark, a.data).explain("formatted")
        return 0
    for k in a.keys:
        df = qs[k](spark, a.data)
        w = df.write.mode("overwrite")
        if a.format == "csv":
            w = w.option("header", True)
        getattr(w, a.format)(f"{a.out.rstrip('/')}/{k}")
        print(f"{k}: written to {a.out.rstrip('/')}/{k}")
    from kipmart.plans.materialize import drop_temp_tables
    drop_temp_tables(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
