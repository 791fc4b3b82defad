"""Run queries and their oracle SQL side by side and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (decimal.Decimal, float)):
        return f"{float(v):.6g}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def number(v):
    """Integers and whole floats compare equal, as they do in a value hash on doubles."""
    if isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.6g}" if abs(float(v)) < 1e6 else str(v)
    return cell(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(number(r[i]) for i in order) for r in rows)


def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def check(spark, con, folder, name, fn, sql):
    """(problem or None, rows, spark seconds, duck seconds)"""
    t0 = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return (None if rows else "no rows"), len(rows), t1 - t0, 0.0
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    bad = None
    if sorted(df.columns) != sorted(want_cols):
        bad = f"columns {sorted(df.columns)} vs {sorted(want_cols)}"
    elif not rows:
        bad = "no rows"
    else:
        a, b = canon(df.columns, rows), canon(want_cols, want)
        if a != b:
            sa, sb = set(a), set(b)
            bad = (f"rows {len(a)} vs {len(b)}; columns {sorted(df.columns)}\n"
                   f"   only spark {sorted(sa - sb)[:3]}\n   only oracle {sorted(sb - sa)[:3]}")
    return bad, len(rows), t1 - t0, t2 - t1


if __name__ == "__main__":
    import __spark_entry__ as entry
    from strandline.session import get_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    wanted = sys.argv[1:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                             "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed, total = duck(folder), [], 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        total += 1
        try:
            bad, n, s, d = check(spark, con, folder, name, fn, oracles.get(name))
        except Exception as e:  # report and go on
            bad, n, s, d = f"{type(e).__name__}: {str(e)[:700]}", 0, 0, 0
        mark = "ok  " if bad is None else "FAIL"
        if bad or s > 3 or d > 3 or wanted:
            print(f"{mark} {name} rows={n} spark={s:.2f}s duck={d:.2f}s{'' if name in oracles else ' (no oracle)'}"
                  + (f"\n   {bad}" if bad else ""), flush=True)
        if bad:
            failed.append(name)
    print(f"{total - len(failed)}/{total} ok; failed: {failed}")
