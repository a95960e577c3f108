"""Runs registered queries against their SQL: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if x is None:
        return ("null",)
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, float):
        return ("nan",) if math.isnan(x) else ("n", x)
    if isinstance(x, int):
        return ("n", float(x)) if abs(x) < 2**53 else ("i", x)
    return (type(x).__name__, x)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)}", t1 - t0, 0.0
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    t2 = time.time()
    if sorted(got_cols) != sorted(want_cols):
        return f"COLUMNS {sorted(got_cols)} != {sorted(want_cols)}", t1 - t0, t2 - t1
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a != b:
        left = [x for x in a if x not in set(b)][:3]
        right = [x for x in b if x not in set(a)][:3]
        return f"DIFF {len(a)} vs {len(b)}\n   cols {sorted(got_cols)}\n   spark {left}\n   sql   {right}"[:1800], t1 - t0, t2 - t1
    return f"ok {len(a)}", t1 - t0, t2 - t1


def open_duckdb(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    import __spark_entry__ as e
    from opslens.session import build_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = open_duckdb(sf_dir), e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        try:
            msg, a, b = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as ex:  # noqa: BLE001
            msg, a, b = f"ERROR {type(ex).__name__}: {str(ex)[:1500]}", 0, 0
        bad += not msg.startswith(("ok", "rows-only"))
        print(f"{name:32s} {a:6.1f}s {b:5.1f}s  {msg}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
