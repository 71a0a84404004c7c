"""Compare registered queries with their SQL in DuckDB (used by the tests and by hand)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, job, sql):
    """None when equal, else a short description of the difference."""
    t0 = time.time()
    df = job(spark, sf)
    got = df.collect()
    t1 = time.time()
    info = f"{t1 - t0:.2f}s {len(got)} rows"
    if sql is None:
        return None, info
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", info
    a = rows_of(df.columns, [tuple(x) for x in got])
    b = rows_of(cols, want)
    types = {c: (type(x).__name__) for c, x in zip(df.columns, got[0])} if got else {}
    wtypes = {c: (type(x).__name__) for c, x in zip(cols, want[0])} if want else {}
    bad = {c: (types[c], wtypes[c]) for c in types if c in wtypes and types[c] != wtypes[c] and "NoneType" not in (types[c], wtypes[c])}
    if bad:
        return f"types {bad}", info
    if a == b:
        return None, info + f" duck {time.time() - t1:.2f}s"
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    n_diff = len(set(a) ^ set(b))
    return f"{len(a)} vs {len(b)} rows, {n_diff} differ\n   spark {only_a}\n   sql   {only_b}", info


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from bookheat.plans.catalog import CHECKS, JOBS
    from bookheat.session import get_session

    sf = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.01")
    pick = sys.argv[2:]
    spark = get_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, job in JOBS.items():
        if pick and not any(p in name for p in pick):
            continue
        try:
            diff, info = compare(spark, con, sf, name, job, CHECKS.get(name))
        except Exception as e:  # noqa: BLE001
            diff, info = f"ERROR {type(e).__name__}: {str(e)[:1200]}", ""
        bad += diff is not None
        print(("ok   " if diff is None else "FAIL ") + name, info, "" if name in CHECKS else "(rows only)", diff or "", flush=True)
    print("failures:", bad)
