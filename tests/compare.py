"""Run registered queries beside their SQL and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """A value in a form that compares equal between engines."""
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def check(spark, con, name, fn, sql, sf_dir):
    """(ok, message)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time() - t0
    if sql is None:
        return len(got) > 0, f"{len(got)} rows {t1:.1f}s (no SQL)"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    t2 = time.time() - t0 - t1
    c1, r1 = rows_of(df.columns, got)
    c2, r2 = rows_of(names, want)
    if c1 != c2:
        return False, f"columns {c1} <> {c2}"
    if len(r1) != len(r2):
        return False, f"row counts {len(r1)} <> {len(r2)}\n   spark {r1[:1]}\n   sql   {r2[:1]}"
    for a, b in zip(r1, r2):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(c1, a, b) if x != y]
            return False, f"values {str(bad)[:900]}\n  row {str(a)[:300]}"
    return len(r1) > 0, f"{len(r1)} rows {t1:.1f}s sql {t2:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from millrace.session import local_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = local_session(8), duck(sf)
    for setting in filter(None, os.environ.get("COMPARE_CONF", "").split(",")):  # e.g. spark.sql.shuffle.partitions=3
        spark.conf.set(*setting.split("=", 1))
    sqls, failed = oracle_sql(), []
    for name, fn in queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, msg = check(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if ok else "FAIL", name, msg, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
