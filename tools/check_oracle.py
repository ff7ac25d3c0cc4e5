"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Compare rule: same row count, same column names, same multiset of rows
(columns sorted by name, doubles rounded to 6 digits).
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.plans.registry import load_all  # noqa: E402
from tessera.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "__int__") and type(v).__name__ in ("Decimal", "int64", "int32"):
        return int(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    reg = load_all()
    spark = local_session()
    # extra session settings to check under, e.g. SPARK_CONF="spark.sql.ansi.enabled=false"
    for kv in filter(None, os.environ.get("SPARK_CONF", "").split(",")):
        k, v = kv.split("=", 1)
        spark.conf.set(k, v)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    report = {}
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = q.run(spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "spark_error", "error": str(e)[:400]}
            print(name, "SPARK ERROR", str(e)[:400])
            continue
        ts = time.time() - t0
        if not q.sql:
            report[name] = {"status": "rows_only", "rows": len(s_rows), "sec": round(ts, 2)}
            print(f"{name}: rows-only {len(s_rows)} rows {ts:.1f}s")
            continue
        try:
            rel = con.sql(q.sql)
            d_cols = list(rel.columns)
            d_rows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "oracle_error", "error": str(e)[:400]}
            print(name, "ORACLE ERROR", str(e)[:400])
            continue
        ok_cols = sorted(s_cols) == sorted(d_cols)
        ok_n = len(s_rows) == len(d_rows)
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        ok_v = ok_cols and a == b
        report[name] = {"status": "match" if ok_v and ok_n else "mismatch",
                        "rows": len(s_rows), "oracle_rows": len(d_rows),
                        "cols": ok_cols, "sec": round(ts, 2)}
        print(f"{name}: {'MATCH' if ok_v and ok_n else 'MISMATCH'} rows={len(s_rows)}/{len(d_rows)} cols={ok_cols} {ts:.1f}s")
        if not (ok_v and ok_n):
            if not ok_cols:
                print("  spark cols", s_cols, "\n  duck cols", d_cols)
            else:
                sa, sb = set(a), set(b)
                for r in list(sa - sb)[:2]:
                    print("  spark-only", repr(r)[:600])
                for r in list(sb - sa)[:2]:
                    print("  duck-only ", repr(r)[:600])
    print(json.dumps({k: v["status"] for k, v in report.items()}))


if __name__ == "__main__":
    main()
