"""Run registered queries next to their SQL twins and compare rows.

    python tests/compare.py [sf] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        if v != v:
            return "\0"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_cell(v[k])}" for k in sorted(v)) + "}"
    return str(v)


def normalise(columns, rows) -> pd.Series:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\1".join(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else a short description of the first difference."""
    df = fn(spark, sf_dir)
    rows = [tuple(r.asDict(recursive=True)[c] for c in df.columns) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = normalise(df.columns, rows), normalise(names, expected)
    if got == want:
        return None if got else "EMPTY (both sides)"
    in_want, in_got = set(want), set(got)
    a = [x for x in got if x not in in_want][:2]
    b = [x for x in want if x not in in_got][:2]
    return f"rows {len(got)} vs {len(want)}\n   spark {a}\n   sql   {b}".replace("\1", " | ")


def main() -> int:
    import __spark_entry__ as entry

    from tickloom.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    prefixes = tuple(args[1:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = difference(spark, con, name, fn, oracles[name], sf_dir)
            else:
                diff = None if fn(spark, sf_dir).count() else "EMPTY"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {kind:4} {time.time() - t:6.1f}s {name}" + (f"\n   {diff}" if diff else ""), flush=True)
        bad += diff is not None
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
