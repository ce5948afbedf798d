"""Run registered queries in Spark and their check SQL in DuckDB, and compare.

    python tests/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in at]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else what differs."""
    names, got = ordered(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    want_names, want = ordered([d[0] for d in result.description], result.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
            return f"{sum(x != y for x, y in zip(got, want))} rows differ, first: {cells[:4]} in {a[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from cartloom.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in args or list(queries):
        began = time.time()
        try:
            df = queries[key](spark, sf)
            if key in checks:
                problem = difference(df, con, checks[key])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {key} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad of {len(args or queries)}; {len(checks)} checked by SQL")
