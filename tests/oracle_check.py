"""Run registered queries against DuckDB on the same tables: python tests/oracle_check.py [sf] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 9) + 0.0
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, query, sql):
    """None if equal, else a description of the difference."""
    df = query(spark, folder)
    got_cols, got = table(df.columns, df.collect())
    rel = con.execute(sql)
    want_cols, want = table([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; spark {got[:2]} oracle {want[:2]}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return (f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else None), len(got)


def main(argv):
    import __spark_entry__ as entry
    from casewright.session import build_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g",
        spark__log__level="ERROR",
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem, n = compare(spark, con, folder, queries[name], oracles[name])
            else:
                n = len(queries[name](spark, folder).collect())
                problem = None
            state = "ok  " if not problem else "FAIL"
            state = state if name in oracles else "rows"
        except Exception as e:
            problem, n, state = f"{type(e).__name__}: {str(e)[:600]}", -1, "ERR "
        if problem:
            failed.append(name)
        print(f"{state} {name} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
