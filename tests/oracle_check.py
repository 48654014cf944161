"""Run registered queries and compare them with their SQL: ``python tests/oracle_check.py [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(canon(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (int, str, bytes, bytearray)):
        return v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, query, sql):
    df = query(spark, sf)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return "rows-only", len(mine), None
    got = con.sql(sql)
    theirs = rows_of(got.columns, got.fetchall())
    if sorted(df.columns) != sorted(got.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(got.columns)}", len(mine), None
    if mine == theirs:
        return "match", len(mine), None
    theirs_set, mine_set = set(theirs), set(mine)
    diff = ([m for m in mine if m not in theirs_set][:3], [t for t in theirs if t not in mine_set][:3])
    return f"MISMATCH {len(mine)} vs {len(theirs)}", len(mine), diff


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from folioscope.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, all_q, all_s = connect(sf), queries(), oracle_sql()
    names = sys.argv[1:] or list(all_q)
    names = [n for n in all_q if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)]
    bad = 0
    for name in names:
        t0 = time.perf_counter()
        try:
            verdict, n, diff = compare(spark, con, sf, all_q[name], all_s.get(name))
        except Exception as e:  # report and go on with the rest
            verdict, n, diff = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0, None
        ok = verdict in ("match", "rows-only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {n:7d} rows {time.perf_counter() - t0:6.2f}s  {verdict}", flush=True)
        if diff:
            print("    spark:", *diff[0], sep="\n      ")
            print("    sql:  ", *diff[1], sep="\n      ")
    print(f"{len(names) - bad}/{len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
