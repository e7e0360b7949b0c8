"""Compare registered queries with their SQL oracles on DuckDB.

    python check.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from queries.inputs import TABLES


def canonical(value, digits: int = 6):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        rounded = round(value, digits)
        return 0.0 if rounded == 0 else rounded
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v, digits) for v in value)
    if hasattr(value, "asDict"):
        return tuple(canonical(v, digits) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(canonical(v, digits) for v in value.values())
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


SAME_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def same_type(spark_type: str, duck_type: str) -> bool:
    return SAME_TYPES.get(spark_type) == duck_type


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, name, query):
    """Returns (ok, message)."""
    start = time.time()
    df = query.run(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if query.sql is None:
        return True, f"rows-only rows={len(rows)} {took:.1f}s"
    start = time.time()
    result = con.execute(query.sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    duck_took = time.time() - start
    kinds = {d[0]: str(d[1]) for d in result.description}
    odd = {c: (t, kinds.get(c)) for c, t in df.dtypes if not same_type(t, kinds.get(c, ""))}
    if odd:
        print(f"     types of {name}: {odd}", flush=True)
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = bag(df.columns, rows), bag(columns, expected)
    if a == b:
        return True, f"rows={len(rows)} spark {took:.1f}s duck {duck_took:.1f}s"
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return False, f"rows {len(a)} vs {len(b)}\n  cols {sorted(columns)}\n  spark {only_a}\n  duck  {only_b}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from queries import registry
    from tablemend.session import build_session

    spark = build_session(8)
    con = duck_connection(args.sf)
    bad = 0
    for name, query in registry().items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            ok, message = compare(spark, con, args.sf, name, query)
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, message, flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
