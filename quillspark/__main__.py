"""Command line: list the registered queries or run one over a data folder.

    python -m quillspark list
    python -m quillspark run <query> <data_dir> [--out <path>] [--show N] [--sql]

``--out`` writes the result as parquet (to a shared path on a cluster);
``--sql`` prints the query's DuckDB oracle instead of running it.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quillspark")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("data_dir")
    run.add_argument("--out")
    run.add_argument("--show", type=int, default=20)
    run.add_argument("--sql", action="store_true")
    args = ap.parse_args(argv)

    from quillspark import registry
    qs, oracles = registry.queries(), registry.oracles()
    if args.cmd == "list":
        for name in sorted(qs):
            print(f"{name}{'' if name in oracles else '  (rows-only)'}")
        return 0
    if args.query not in qs:
        print(f"unknown query {args.query!r}; see 'python -m quillspark list'", file=sys.stderr)
        return 2
    if args.sql:
        print(oracles.get(args.query, "-- no SQL oracle for this query"))
        return 0
    from quillspark.session import build_session
    spark = build_session()
    df = qs[args.query](spark, args.data_dir)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
        print(f"wrote {args.out}")
    else:
        df.show(args.show, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
