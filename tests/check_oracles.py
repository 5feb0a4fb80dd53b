"""Compare registered queries with their SQL on one data folder.

python tests/check_oracles.py [folder] [name part …]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}" if v != 0 else "0.000000"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, folder):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(cols)}"
    want = rows_of(cols, cur.fetchall())
    if got == want:
        return len(got), ""
    only_a = [r for r in got if r not in set(want)][:2]
    only_b = [r for r in want if r not in set(got)][:2]
    return len(got), f"{len(got)} vs {len(want)} rows\n   spark {only_a}\n   sql   {only_b}"


if __name__ == "__main__":
    from colloquy.session import local_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con, bad = local_session(8), connect(folder), []
    for name in entry.queries():
        if parts and not any(p == name or (p.endswith("*") and p[:-1] in name) for p in parts):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            n, err = -1, f"{type(e).__name__}: {str(e)[:600]}"
        state = "rows only" if err is None else "ok" if err == "" else "FAIL"
        if err or n == 0:
            bad.append(name)
        print(f"{state:9} {name:36} {n:7} rows {time.time() - t:6.2f}s {err or ''}", flush=True)
    print("bad or empty:", bad)
