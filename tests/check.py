"""Runs queries and their SQL on the same tables and compares the rows.

python tests/check.py [table folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(made, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    left = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    types = {type(x) for r in left for x in r} ^ {type(x) for r in right for x in r}
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}; only left {list(set(left) - set(right))[:2]}; only right {list(set(right) - set(left))[:2]}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {str(bad[0])[:900]}"
    return f"types {types}" if types else ""


if __name__ == "__main__":
    from tests.session import make_session
    from scriptweave.plans.catalog import QUERIES
    from scriptweave.plans.oracle import ORACLE

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = make_session(), connect(sf_dir)
    failed = []
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = compare(df, con, ORACLE[name]) if name in ORACLE else "no SQL"
            n = df.count()
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        if problem:
            failed.append(name)
        print(f"{'ok  ' if not problem else 'FAIL'} {name} rows={n} {time.time() - t:.1f}s {problem}", flush=True)
    print("failed:", failed)
