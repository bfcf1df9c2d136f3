"""Run registered queries beside their DuckDB SQL and report differences.

    python -m tests.compare --sf 0.01 [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, tuple) else (True, "t", str(x)) for x in r))
    return [columns[i] for i in order], out


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return a == b
    return a == b


def compare(spark, sf_dir, name, query, sql, con):
    df = query(spark, sf_dir)
    got_cols, got = canonical(df.columns, df.collect())
    if sql is None:
        return f"rows-only {len(got)}", len(got) > 0
    cur = con.execute(sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}", False
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; got {got[:3]} want {want[:3]}", False
    bad = [(g, w) for g, w in zip(got, want) if any(not same(x, y) for x, y in zip(g, w))]
    if bad:
        return f"{len(bad)} rows differ; columns {got_cols}\n   got  {bad[0][0]}\n   want {bad[0][1]}", False
    return f"match {len(got)}", True


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    import __spark_entry__ as e
    from tabscout.session import local_session

    spark = local_session("compare", cores="8")
    sf_dir = f"/root/testdata/sf{a.sf}"
    con = duck(sf_dir)
    queries, sqls = e.queries(), e.oracle_sql()
    names = [n for n in queries if not a.names or any(n.startswith(x) for x in a.names)]
    failed = []
    for n in names:
        start = time.time()
        try:
            text, ok = compare(spark, sf_dir, n, queries[n], sqls.get(n), con)
        except Exception as err:
            text, ok = f"{type(err).__name__}: {str(err)[:600]}", False
            if a.names:
                traceback.print_exc()
        print(f"{'ok  ' if ok else 'FAIL'} {n:34s} {time.time() - start:6.2f}s {text}", flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
