"""Run registered queries next to their SQL on one data folder and compare whole results.

``python tests/compare.py [folder] [names...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from planlines.plans.fixtures import BASE_TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message) for one query."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL, {t1 - t0:.1f}s"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    t2 = time.time()
    c1, r1 = rows_of(got, df.columns)
    c2, r2 = rows_of(want, cols)
    stat = f"{len(got)} vs {len(want)} rows, {t1 - t0:.1f}s spark, {t2 - t1:.1f}s duck"
    if c1 != c2:
        return False, f"columns {c1} vs {c2}; {stat}"
    if r1 != r2:
        only1, only2 = sorted(set(r1) - set(r2), key=repr)[:2], sorted(set(r2) - set(r1), key=repr)[:2]
        return False, f"values differ; {stat}; {c1} spark {only1} sql {only2}"
    kinds = {d[0]: str(d[1]) for d in res.description}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS.get(t) != kinds[c]}
    return True, f"{stat}; types {odd}" if odd else stat


def main():
    import __spark_entry__ as entry
    from planlines.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con = build_session(cpus=8), connect(sf_dir)
    fns, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args[1:] or fns:
        try:
            ok, msg = compare(spark, con, name, fns[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
