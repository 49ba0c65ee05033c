"""Run registered queries next to their reference SQL: ``python tests/compare.py [sf] [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


TIMES = []


def compare(df, sql, con):
    spark_columns, spark_rows = rows_of(df.columns, df.collect())
    TIMES.append(time.time())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    sql_columns, sql_rows = rows_of(names, cur.fetchall())
    if spark_columns != sql_columns:
        return len(spark_rows), f"columns {spark_columns} vs {sql_columns}"
    if spark_rows != sql_rows:
        a, b = set(spark_rows), set(sql_rows)
        return len(spark_rows), f"{len(spark_rows)} vs {len(sql_rows)} rows; spark only {sorted(a - b)[:3]} sql only {sorted(b - a)[:3]}"
    return len(spark_rows), None


def main():
    import __spark_entry__ as entry
    from boxloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    keys = [k for k in queries if not wanted or any(k == w or (w.endswith("*") and k.startswith(w[:-1])) for w in wanted)]
    bad = []
    for key in keys:
        start = time.time()
        try:
            df = queries[key](spark, folder)
            if key in sql:
                n, problem = compare(df, sql[key], con)
            else:
                n, problem = len(df.collect()), None
        except Exception as e:
            n, problem = -1, f"{type(e).__name__}: {str(e)[:700]}"
        took = (TIMES[-1] if TIMES and TIMES[-1] > start else time.time()) - start
        rest = time.time() - start - took
        kind = "sql" if key in sql else "rows"
        print(f"{key:14s} {kind:5s} {n:8d} {took:6.2f}s sql {rest:6.2f}s {'ok' if problem is None else 'FAIL ' + problem}", flush=True)
        if problem or n == 0:
            bad.append(key)
    print(f"{len(keys)} queries, not ok or empty: {bad}")


if __name__ == "__main__":
    main()
