"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, rows (spark/duckdb), match flag.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm_value(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm_value(v.asDict())
    return v


def norm_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm_value(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duck_conn(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from promospark.session import get_spark
    spark = get_spark("local[8]")
    qs, sql = E.queries(), E.oracle_sql()
    con = duck_conn(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"{name:32s} spark={len(srows)} (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(sql[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCK-ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        a, b = norm_rows(scols, srows), norm_rows(dcols, drows)
        ok = ok_cols and a == b
        bad += not ok
        print(f"{name:32s} spark={len(srows)} duck={len(drows)} cols={'ok' if ok_cols else 'DIFF'} "
              f"{'MATCH' if ok else 'MISMATCH'} {t1 - t0:.1f}s")
        if not ok:
            if not ok_cols:
                print("   spark cols", sorted(scols), "\n   duck  cols", sorted(dcols))
            else:
                sa, sb = set(a), set(b)
                for r in list(sa - sb)[:3]:
                    print("   only spark:", r)
                for r in list(sb - sa)[:3]:
                    print("   only duck :", r)
    print("failures:", bad)


if __name__ == "__main__":
    main()
