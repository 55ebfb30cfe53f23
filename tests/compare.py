"""Run the registered queries against their SQL and report differences.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, dt.datetime) and v.time() == dt.time(0):
        return v.date().isoformat()
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, Decimal)):
        return "float"
    return type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [names[i] for i in order]


def kinds_of(names, rows):
    out = {}
    for i, n in enumerate(names):
        out[n] = next((kind(r[i]) for r in rows if r[i] is not None), None)
    return out


def compare(df, con, sql):
    """None when equal, else a short description of the first difference."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    a, cols = rows_of(df.columns, got)
    b, _ = rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    ka, kb = kinds_of(df.columns, got), kinds_of(names, want)
    bad = {c: (ka[c], kb[c]) for c in ka if ka[c] and kb[c] and ka[c] != kb[c]}
    if bad:
        return f"types {bad}"
    if a != b:
        sa, sb = set(a), set(b)
        return f"values ({len(sa - sb)} differ) {cols} {sorted(sa - sb)[:2]} {sorted(sb - sa)[:2]}"
    return None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from coloom.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf)
    todo = argv[1:] or list(queries())
    for name in todo:
        t = time.time()
        try:
            df = queries()[name](spark, sf)
            sql = oracle_sql().get(name)
            if sql is None:
                n = len(df.collect())
                print(f"{name:28s} rows {n:7d} {time.time() - t:6.1f}s", flush=True)
                continue
            n, bad = None, compare(df, con, sql)
            print(f"{name:28s} {'ok' if bad is None else 'BAD ' + bad} {time.time() - t:6.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} ERROR {type(e).__name__} {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
