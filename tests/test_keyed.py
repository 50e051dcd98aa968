"""Bucketed tables: touched files only, compaction, lost writers; snapshots that follow their inputs."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.sources.keyed import KeyedTable, replace_children_in, upsert_into
from furlong.sources.sinks import feature_cache

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("c", T.LongType()), T.StructField("v", T.LongType()), T.StructField("t", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    found = {}
    for folder, _, names in os.walk(f"{path}/parts"):
        found |= {f"{folder}/{n}": os.stat(f"{folder}/{n}").st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], 16)
    old = [(k, 0, 1, f"old{k}") for k in range(200)] + [(None, 0, 1, "nobody")]
    assert len(upsert_into(table, frame(spark, old), ["v"])) == 16
    before = files(tmp_path)
    touched = upsert_into(table, frame(spark, [(7, 0, 2, "new"), (7, 0, 1, "late"), (8, 0, 0, "older"), (900, 0, 1, "first")]), ["v"])
    assert 1 <= len(touched) <= 3
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items())  # nothing is rewritten in place
    manifest = table.manifest()
    runs = {b: r for b, r in manifest["runs"].items()}
    assert manifest["version"] == 2 and len({r[0] for b, r in runs.items() if b not in touched}) == 1
    want = [r for r in old if r[0] != 7] + [(7, 0, 2, "new"), (900, 0, 1, "first")]
    assert rows_of(table.rows()) == sorted(want, key=str) == rows_of(KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], 99).rows())
    assert table.vacuum(versions=1) >= 0 and rows_of(table.rows()) == sorted(want, key=str)


def test_children_of_arriving_parents_are_replaced(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k", "c"], 8, bucket_by=["k"])
    replace_children_in(table, frame(spark, [(k, c, 1, "a") for k in range(30) for c in range(3)]))
    touched = replace_children_in(table, frame(spark, [(4, 0, 2, "b"), (99, 1, 2, "b")]))
    assert 1 <= len(touched) <= 2
    got = rows_of(table.rows())
    assert [r for r in got if r[0] == 4] == [(4, 0, 2, "b")] and len(got) == 29 * 3 + 2
    assert replace_children_in(table, frame(spark, [])) == []


def test_batches_are_compacted_and_counted_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], 4, max_runs=3)
    for number in range(12):
        batch = frame(spark, [(k, 0, number, f"{number}") for k in range(number, number + 5)])
        assert table.append(batch, number, ["v"])
        assert not table.append(batch, number, ["v"])  # the same batch again
        assert max(len(r) for r in table.manifest()["runs"].values()) <= 3
    want = {k: max(n for n in range(12) if n <= k < n + 5) for k in range(16)}
    assert {r.k: r.v for r in table.current(["v"]).collect()} == want
    table.compact(["v"])
    assert {r.k: r.v for r in table.rows().collect()} == want
    left = table.vacuum(1)
    assert left > 0 and {r.k: r.v for r in table.rows().collect()} == want
    # late versions do not win; expired keys go with the merge
    table.append(frame(spark, [(15, 0, 0, "late")]), 99, ["v"])
    assert {r.k: r.v for r in table.current(["v"]).collect()} == want
    table.compact(["v"], 0, lambda rows: rows.filter("v >= 8"))
    assert {r.k: r.v for r in table.rows().collect()} == {k: v for k, v in want.items() if v >= 8}


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], 4, max_runs=1)
    table.append(frame(spark, [(k, 0, 1, "a") for k in range(20)]), 0, ["v"])
    before = rows_of(table.current(["v"]))

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", die)
        with pytest.raises(OSError, match="lost"):
            table.append(frame(spark, [(1, 0, 2, "b")]), 1, ["v"])
    assert rows_of(table.current(["v"])) == before
    with monkeypatch.context() as m:  # dies between the batch and the merge that follows it
        m.setattr(KeyedTable, "compact", die)
        with pytest.raises(OSError, match="lost"):
            table.append(frame(spark, [(1, 0, 2, "b")]), 1, ["v"])
    assert not table.append(frame(spark, [(1, 0, 2, "b")]), 1, ["v"])
    assert [r.t for r in table.current(["v"]).filter("k = 1").collect()] == ["b"]
    other = KeyedTable(spark, str(tmp_path), SCHEMA, ["k"])
    stale = other.manifest()
    table.compact(["v"])
    with pytest.raises(RuntimeError, match="someone else"):
        other._commit(stale, {}, None)


def test_a_snapshot_follows_its_input(spark, tmp_path):
    source, cache = f"{tmp_path}/source", f"{tmp_path}/cache"
    spark.range(5).write.parquet(source)
    built = []

    def build():
        return spark.read.parquet(source).withColumn("x", F.col("id") * 2)

    def snapshot(**kw):
        out = feature_cache(spark, cache, build, **kw)
        built.append(len(os.listdir(cache)))
        return sorted(r.x for r in out.collect())

    assert snapshot() == snapshot() == [0, 2, 4, 6, 8] and built == [1, 1]
    spark.range(5, 6).write.mode("append").parquet(source)
    assert snapshot() == [0, 2, 4, 6, 8, 10] and built[-1] == 2
    assert snapshot(stages=["another"]) == [0, 2, 4, 6, 8, 10] and built[-1] == 3
    os.remove(f"{cache}/{sorted(os.listdir(cache))[0]}/_SUCCESS")
    os.remove(f"{cache}/{sorted(os.listdir(cache))[1]}/_SUCCESS")
    assert snapshot() == [0, 2, 4, 6, 8, 10]
