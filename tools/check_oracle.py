"""Run registered queries next to their SQL twins and compare the results.

usage: python tools/check_oracle.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from kinweave.queries import QUERIES, SQL
from kinweave.session import spark_session
from kinweave.sources.views import TABLES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = spark_session("check", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    names = [n for n in QUERIES if not args.names or any(n == a or n.startswith(a) for a in args.names)]
    bad = []
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            got = df.collect()
        except Exception as e:
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time()
        if name not in SQL:
            print(f"rows {name}: {len(got)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = db.execute(SQL[name])
            cols = [d[0] for d in cur.description]
            types = dict(zip(cols, [str(d[1]) for d in cur.description]))
            want = cur.fetchall()
        except Exception as e:
            print(f"SQLFAIL {name}: {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        t2 = time.time()
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        ok = sorted(df.columns) == sorted(cols) and a == b
        kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}
        odd = [f"{c}:{t}/{types.get(c)}" for c, t in df.dtypes if kinds.get(t) != types.get(c)]
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(a)}/{len(b)} rows {t1 - t0:.1f}s sql {t2 - t1:.1f}s {odd or ''}", flush=True)
        if not ok:
            bad.append(name)
            print("   spark", sorted(df.columns), "sql", sorted(cols))
            from collections import Counter
            x, y = Counter(map(repr, a)), Counter(map(repr, b))
            for r in list((x - y))[:4]:
                print("   spark only", r[:400])
            for r in list((y - x))[:4]:
                print("   sql only  ", r[:400])
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
