"""Run registered queries in Spark and their SQL oracles in DuckDB and compare.

Mirrors the driver's gate: row count, column names (sorted) and an
order-insensitive multiset of normalised row values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        if isinstance(v, dt.datetime) and v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return v.isoformat()
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, dict):
        return tuple(sorted((norm(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


# Spark simpleString -> DuckDB type name, for the schema comparison.
TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
            "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
            "date": "DATE", "array<string>": "VARCHAR[]", "binary": "BLOB"}


def type_mismatches(spark_schema, duck_cols, duck_types):
    d = dict(zip(duck_cols, [str(t) for t in duck_types]))
    out = []
    for f in spark_schema.fields:
        st = f.dataType.simpleString()
        if TYPE_MAP.get(st, st) != d.get(f.name):
            out.append((f.name, st, d.get(f.name)))
    return out


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, sf_dir, names=None, verbose=True):
    from quillspark import registry
    qs, sqls = registry.queries(), registry.oracles()
    con = duck(sf_dir)
    report = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_schema = df.schema
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            report[name] = ("SPARK-ERROR", str(e)[:800])
            if verbose:
                print(f"{name:34s} SPARK-ERROR {str(e)[:800]}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            report[name] = ("rows-only", len(s_rows))
            if verbose:
                print(f"{name:34s} rows-only   rows={len(s_rows)} spark={ts:.1f}s")
            continue
        try:
            rel = con.sql(sqls[name])
            d_cols, d_types = rel.columns, rel.types
            d_rows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            report[name] = ("DUCK-ERROR", repr(e)[:800])
            if verbose:
                print(f"{name:34s} DUCK-ERROR {repr(e)[:800]}")
            continue
        sc, sm = canon(s_cols, s_rows)
        dc, dm = canon(d_cols, d_rows)
        types = type_mismatches(s_schema, d_cols, d_types)
        ok = sc == dc and sm == dm
        status = ("MATCH" if not types else "TYPES") if ok else "MISMATCH"
        if types and verbose:
            print("   type mismatches:", types)
        report[name] = (status, len(s_rows), len(d_rows))
        if verbose:
            print(f"{name:34s} {status:8s} rows={len(s_rows)}/{len(d_rows)} spark={ts:.1f}s")
            if not ok:
                if sc != dc:
                    print("   cols spark:", sc, "\n   cols duck: ", dc)
                else:
                    a, b = sm - dm, dm - sm
                    for x in list(a)[:3]:
                        print("   spark-only:", x[:600])
                    for x in list(b)[:3]:
                        print("   duck-only: ", x[:600])
    return report


if __name__ == "__main__":
    from quillspark.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session()
    rep = check(spark, sf, names)
    bad = [k for k, v in rep.items() if v[0] not in ("MATCH", "rows-only")]
    print(f"\n{len(rep)} checked, {sum(v[0] == 'MATCH' for v in rep.values())} match, "
          f"{sum(v[0] == 'rows-only' for v in rep.values())} rows-only, bad: {bad}")
