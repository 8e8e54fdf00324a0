"""Run registered queries beside their SQL and compare every value.

``python tests/side_by_side.py [sf] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def open_tables(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"i{v}"
    return str(v)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, root):
    """None when equal, else what differs."""
    df = fn(spark, root)
    mine = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows", len(mine)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = sorted_rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(mine)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} against {len(theirs)}", len(mine)
    for a, b in zip(mine, theirs):
        if a != b:
            bad = sum(x != y for x, y in zip(mine, theirs))
            return f"{bad} rows differ, {sorted(names)}: {a} against {b}", len(mine)
    return None, len(mine)


if __name__ == "__main__":
    from tallyrank.registry import ORACLES, QUERIES
    from tallyrank.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    root = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session("side-by-side", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="16g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(root)
    failed = []
    for name in wanted:
        t = time.time()
        try:
            diff, rows = compare(spark, con, name, QUERIES[name], ORACLES.get(name), root)
        except Exception as e:  # report and go on with the next query
            diff, rows = f"{type(e).__name__}: {str(e)[:700]}", -1
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'ok ' if diff is None else 'BAD'} {name:28s} {kind:4s} {rows:8d} {time.time()-t:6.2f}s"
              + (f"  {diff}" if diff else ""), flush=True)
        if diff:
            failed.append(name)
    print("failed:", failed)
