"""Compare each registered query with its DuckDB oracle SQL.

Usage: ``python tests/oracle_compare.py [sf_dir] [name ...]``.  Prints one
line per query: rows on both sides, column names, value match.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    """Exact comparison key: same type and value (NaN equal to NaN)."""
    if v is None:
        return ("0null",)
    if isinstance(v, float) and math.isnan(v):
        return ("nan",)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return ("ts", v.isoformat())
    return (type(v).__name__, repr(v))


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, names=None, con=None):
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    con = con or duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # report and go on with the next query
            results[name] = dict(error=str(e)[:300])
            continue
        t1 = time.time()
        if name not in sql:
            results[name] = dict(rows=len(s_rows), oracle=None)
            continue
        try:
            cur = con.execute(sql[name])
        except Exception as e:
            results[name] = dict(rows=len(s_rows), sql_error=str(e)[:300])
            continue
        d_cols = [c[0] for c in cur.description]
        d_rows = cur.fetchall()
        ok_cols = sorted(s_cols) == sorted(d_cols)
        ok_vals = ok_cols and canon(s_cols, s_rows) == canon(d_cols, d_rows)
        results[name] = dict(rows=len(s_rows), oracle_rows=len(d_rows), cols=ok_cols,
                             values=ok_vals, sec=round(t1 - t0, 2), s_cols=s_cols, d_cols=d_cols)
        if not ok_vals and ok_cols:
            a, b = canon(s_cols, s_rows), canon(d_cols, d_rows)
            results[name]["first_diff"] = [x for x in a if x not in b][:3], [x for x in b if x not in a][:3]
    return results


if __name__ == "__main__":
    from shoreline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = 0
    for k, v in res.items():
        good = ("error" not in v and "sql_error" not in v and v.get("values") is not False
                and v.get("rows") == v.get("oracle_rows", v.get("rows")))
        bad += not good
        print(("OK  " if good else "BAD ") + k, {x: v[x] for x in v if x not in ("s_cols", "d_cols") or not v.get("cols")})
    print(f"{len(res) - bad}/{len(res)} match")
