"""Runs a query and its SQL side by side; ``python tests/parity.py SF NAME...`` prints differences."""

from __future__ import annotations

import glob
import math
import sys
import time
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        q = f"{p}/*.parquet" if Path(p).is_dir() else p
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{q}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, fn, sql: str, sf_dir: str) -> str:
    """Empty if equal."""
    df = fn(spark, sf_dir)
    names, want = sql_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    cols = sorted(names)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in want), key=repr)
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} / {len(want)} rows; only here {list(a - b)[:3]}; only in SQL {list(b - a)[:3]}"
    types = [f"{type(x).__name__}/{type(y).__name__}" for x, y in zip(got[0], want[0]) if type(x) is not type(y)] if got else []
    return f"types {types}" if types else ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e

    from minespark.session import get_spark

    spark = get_spark()
    names = sys.argv[2:] or sorted(e.queries())
    for name in names:
        t = time.time()
        try:
            fn, sql = e.queries()[name], e.oracle_sql().get(name)
            said = compare(spark, fn, sql, f"{DATA}/{sys.argv[1]}") if sql else f"no SQL, {fn(spark, f'{DATA}/{sys.argv[1]}').count()} rows"
        except Exception as x:
            said = f"ERROR {str(x)[:600]}"
        print(f"{name:32s} {time.time() - t:6.1f}s {said or 'equal'}", flush=True)
