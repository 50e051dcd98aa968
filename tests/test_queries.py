"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SLICE = [
    "json_blob_scan", "payout_fanout", "class_grade", "course_lookup", "top_pairs", "gate_bias", "group_missingness",
    "expanding_rate", "rolling_rate_30", "past5_weight_trend", "psi_drift", "refresh_plan", "label_encode", "bet_list",
    "stream_dedupe",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 164


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SLICE)
def test_query_matches_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in sorted(os.listdir(small)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    df = entry.queries()[name](spark, small)
    con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in con.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(repr([r[cols.index(c)] for c in order]) for r in con.fetchall())
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert got == want


def test_no_rdd_or_python_udf_in_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "furlong")
    banned = ("localCheckpoint", ".rdd", "F.udf(", "pandas_udf(", "crossJoin(")
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert not [b for b in banned if b in text], f
