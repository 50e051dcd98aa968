"""Run registered queries next to their oracle SQL and compare rows.

    python tools/check.py [-s SF] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from furlong.session import local_session  # noqa: E402
from furlong.verify.registry import ORACLE, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        return "nan" if v != v else f"f:{v!r}"
    return f"{type(v).__name__}:{v}"


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, sf):
    start = time.time()
    df = QUERIES[name](spark, sf)
    got = [tuple(x) for x in df.collect()]
    took = time.time() - start
    if name not in ORACLE:
        return f"rows {len(got)}", bool(got), took
    con.execute(ORACLE[name])
    want_cols = [d[0] for d in con.description]
    want = con.fetchall()
    gc, gr = normal(df.columns, got)
    wc, wr = normal(want_cols, want)
    if gc != wc:
        return f"columns {gc} != {wc}", False, took
    if gr != wr:
        only_g = sorted(set(gr) - set(wr))[:3]
        only_w = sorted(set(wr) - set(gr))[:3]
        diff = len(set(gr) ^ set(wr))
        return f"rows {len(gr)}/{len(wr)} differ {diff}\n   {gc}\n   spark {only_g}\n   sql   {only_w}", False, took
    return f"match {len(gr)}", len(gr) > 0, took


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", "--sf", default="/root/testdata/sf0.01")
    ap.add_argument("-m", "--module", default="")
    ap.add_argument("-a", "--after", default="")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session("check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    names = args.names or [
        n for n in QUERIES if QUERIES[n].__module__.endswith(args.module)
    ]
    if args.after:
        names = names[names.index(args.after) + 1 :]
    bad = []
    for n in names:
        try:
            text, ok, took = compare(spark, con, n, args.sf)
        except Exception as e:  # noqa: BLE001
            text, ok, took = "ERROR " + str(e).split("JVM stacktrace")[0][:700], False, 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok  ' if ok else 'BAD '} {n:24s} {took:6.2f}s {text}", flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")


main()
