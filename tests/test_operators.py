"""Joins, quality, plans, bets, sinks and streams on small fixtures."""

from collections import Counter

import itertools
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.operators import betting as B
from furlong.operators import joins as J
from furlong.operators import lookup as L
from furlong.operators import model as M
from furlong.operators import prep as P
from furlong.operators import quality as Q
from furlong.operators import repair as R
from furlong.session import shared_dir
from furlong.sources import documents as D
from furlong.sources import sinks as K
from furlong.streaming import streams as S


def test_null_keys_join_back(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, None)], "race_id int, j int")
    feats = df.withColumn("v", F.col("race_id") * 10)
    got = sorted(J.join_back(df, feats, ["race_id", "j"], ["v"]).select("race_id", "v").collect())
    assert [tuple(r) for r in got] == [(1, 10), (1, 10), (2, 20)]


def test_course_lookup_order(spark):
    runners = spark.createDataFrame([("a", "t", 1200), ("a", "t", 1500), ("b", "t", 900), ("c", "t", 900)], "venue string, surface string, distance int")
    course = spark.createDataFrame([("a", "t", 1200, 1.0), ("a", "t", 1600, 2.0), ("b", "t", None, 3.0), ("b", "t", 1000, 4.0)], "venue string, surface string, distance int, straight double")
    out = J.course_lookup(runners, course, ["venue", "surface"], "distance", {"straight": 300.0}).collect()
    assert {(r["venue"], r["distance"]): r["straight"] for r in out} == {("a", 1200): 1.0, ("a", 1500): 2.0, ("b", 900): 3.0, ("c", 900): 300.0}


def test_bets_against_itertools(spark):
    runners = [(1, n, 0.5 + n * 0.37, 0.1 + n * 0.013) for n in range(1, 8)]
    df = spark.createDataFrame(runners, "race_id int, no int, ev double, p double")
    got = {}
    for r in B.bet_candidates(df, "race_id", "no", "ev", "p", ["no"]).collect():
        got.setdefault(r["bet_type"], {})[r["combination"]] = (r["expected_value"], r["probability"])
    top = sorted(runners, key=lambda x: -x[2])[:5]
    for kind, rule in B.BET_TYPES.items():
        combos = itertools.permutations(top, rule["size"]) if rule["ordered"] else itertools.combinations(top, rule["size"])
        want = []
        for c in combos:
            mark = "→" if rule["ordered"] else "-"
            want.append((mark.join(str(x[1]) for x in c), sum(x[2] for x in c) / len(c), math.prod(x[3] for x in c) * rule["factor"]))
        assert len(got[kind]) == min(len(want), rule["keep"] or 10**6)
        for name, ev, p in want:
            if name in got[kind]:
                assert got[kind][name] == pytest.approx((ev, p))


def test_kelly_and_levels(spark):
    df = spark.createDataFrame([(0.5, 3.0), (0.1, 2.0), (0.0, 5.0), (0.9, 1.0), (0.35, 3.0)], "p double, o double")
    got = [r[0] for r in df.select(B.kelly(F.col("p"), F.col("o"), 10000.0)).collect()]
    assert got == [500, 0, 0, 0, 62]


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 2, "c")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 3, "n"), (3, 1, "m")], "k int, v int, x string")
    got = sorted(tuple(r) for r in K.upsert_latest(old, new, ["k"], ["v"]).collect())
    assert got == [(1, 1, "a"), (2, 3, "n"), (3, 1, "m")]
    assert sorted(tuple(r) for r in K.replace_children(old, new, ["k"]).collect()) == [(1, 1, "a"), (2, 3, "n"), (3, 1, "m")]


def test_corrupt_documents_are_set_aside(spark):
    schema = T.StructType([T.StructField("a", T.LongType())])
    docs = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), (None,)], "data string")
    assert [tuple(r) for r in D.corrupt_count(docs, schema).collect()] == [(3, 2)]


def test_bundle_has_one_grain(spark):
    races = spark.createDataFrame([(1,), (2,), (3,)], "race_id int")
    kids = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 7)], "race_id int, no int")
    for parts in (1, 4):
        out = L.race_bundle(races, {"kids": (kids, ["no"])}, "race_id", parts=parts).collect()
        by_race = {k: sorted(x["no"] for r in out if r["race_id"] == k for x in r["kids"]) for k in (1, 2, 3)}
        assert by_race == {1: list(range(200)), 2: [7], 3: []}
        assert sorted((r["race_id"], r["part"]) for r in out) == [(k, p) for k in (1, 2, 3) for p in range(parts)]


def test_missing_scores_are_last_and_count_nowhere(spark):
    df = spark.createDataFrame([(1, 0.6, 1), (1, 0.3, 0), (1, None, 0), (2, None, 0)], "race_id int, p double, y int")
    got = {(r["race_id"], r["p"]): (r["p_norm"], r["predicted_rank"]) for r in M.score_races(df, "race_id", "p", "win").collect()}
    assert got[1, None] == (None, 3) and got[1, 0.6][1] == 1 and abs(got[1, 0.6][0] - 2 / 3) < 1e-9
    assert {r["race_id"]: r["difficulty"] for r in B.difficulty(df, "race_id", "p").collect()}[2] == 0.0
    assert M.eval_metrics(df, "p", "y").first()["n"] == 2


def test_gate_flags(spark):
    df = spark.createDataFrame(
        [(1, 0, 2.0, 1, "x", "h"), (1, 0, None, 1, "x", " "), (2, 1200, None, 1, "x", "h"), (2, 1400, None, None, "y", "h")],
        "race_id int, distance int, odds double, popularity int, venue string, horse_name string",
    )
    got = sorted((r["race_id"], r["issue_code"], r["field"], r["severity"]) for r in Q.race_gate(df).collect())
    assert got == [
        (1, "Q1", "distance", "ERROR"), (1, "Q2", "odds", "WARNING"), (1, "Q4", "horse_name", "WARNING"),
        (2, "Q2", "odds", "ERROR"), (2, "Q3", "distance", "ERROR"), (2, "Q3", "venue", "ERROR"),
    ]


def test_drift_of_the_same_data_is_zero(spark):
    df = spark.createDataFrame([(float(i % 40),) for i in range(400)], "x double")
    same = Q.psi_drift(df, df, ["x"]).first()
    assert same["psi"] == 0.0 and same["drift_flag"] == 0
    moved = Q.psi_drift(df, df.withColumn("x", F.col("x") / 4), ["x"]).first()
    assert moved["drift_flag"] == 1


def test_leak_guard_and_alignment(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "t")], "race_id int, finish int, odds double, venue string")
    assert P.leak_guard(df).columns == ["odds"]
    assert P.align_features(df, ["odds", "x"], max_missing=0.5).columns == ["odds", "x"]
    with pytest.raises(ValueError):
        P.align_features(df, ["odds", "x", "y"], max_missing=0.5)


def test_split_method_does_not_depend_on_size(spark):
    df = spark.createDataFrame([(i, f"2024-01-{1 + i % 28:02d}") for i in range(100)], "race_id int, d string").withColumn("race_date", F.col("d").cast("date"))
    one = P.time_split(df, "race_date", ["race_id"], method="hash")
    two = P.time_split(df.repartition(7), "race_date", ["race_id"], method="hash")
    pick = lambda x: sorted(r["race_id"] for r in x.filter("split = 'test'").collect())
    assert 5 < len(pick(one)) < 40 and pick(one) == pick(two)
    days = P.time_split(df, "race_date", ["race_id"]).groupBy("split").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    ends = {r["split"]: (r["a"], r["b"]) for r in days.collect()}
    assert ends["train"][1] < ends["test"][0]
    assert tuple(P.side_sizes(one).first()) == (100 - len(pick(one)), len(pick(one)))


def test_labels_of_many_categories(spark):
    df = spark.createDataFrame([(f"H{i:07d}",) for i in range(500)] + [(None,)], "h string")
    codes = {r["h"]: r["code"] for r in P.label_table(df, "h", slices=8).collect()}
    assert [codes[k] for k in sorted(codes)] == list(range(501))


def test_slices_follow_the_data(spark):
    from furlong.operators.skew import slice_by_value, stored_ranges, text_slices

    df = spark.range(5000).select((F.col("id") / 5e6).alias("v"), F.concat(F.lit("2024010101"), F.format_string("%06d", "id")).alias("t"))
    # small numbers, milliseconds of one hour, ids far from zero
    for shift, scale in ((0, 1.0), (1_700_000_000_000, 720 * 1e6), (10**12, 1e6)):
        moved = df.select(F.lit(1).alias("g"), (F.col("v") * scale + shift).alias("v"))
        sizes = [r["count"] for r in slice_by_value(moved, ["g"], "v", hot_rows=10).groupBy("_slice").count().collect()]
        assert len(sizes) >= 250 and max(sizes) < 200
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
        ranges = stored_ranges(moved.groupBy("g", "v").count(), ["g"], "v").groupBy("_slice").count().collect()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(ranges) >= 4 and max(r["count"] for r in ranges) < 2000
    rows = text_slices(df.select("t"), "t", "s", 64).collect()
    sizes = Counter(r["s"] for r in rows)
    assert len(sizes) >= 60 and max(sizes.values()) < 600
    assert [r["s"] for r in sorted(rows, key=lambda r: r["t"])] == sorted(r["s"] for r in rows)


def test_value_slices_keep_the_order(spark):
    from furlong.operators.skew import slice_by_value

    values = [float("-inf"), -1e9, -3.0, -2e-300, 0.0, 1e-310, 0.5, 0.5001, 7.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "i int, g int, v double")
    for down in (False, True):
        got = [r["_slice"] for r in slice_by_value(df, ["g"], "v", down, hot_rows=1).orderBy("i").collect()]
        assert got == sorted(got, reverse=down) and len(set(got)) == len(values)


def test_one_value_of_ninety_percent_goes_to_many_slices(spark):
    from furlong.operators.skew import ranked, slice_by_value

    data = [(i, 1, None if i % 50 == 0 else 5.0 if i % 10 else float(i)) for i in range(4000)]
    df = spark.createDataFrame(data, "i int, g int, v double").repartition(6)
    sizes = [r["count"] for r in slice_by_value(df, ["g"], "v", False, True, 100).groupBy("_slice").count().collect()]
    assert len(sizes) > 150 and max(sizes) < 100
    for down in (False, True):
        got = {r["i"]: r["rk"] for r in ranked(df, ["g"], "v", "rk", down, hot_rows=100).collect()}
        known = [v for _, _, v in data if v is not None]
        for i, _, v in data[::37]:
            better = len(known) if v is None else sum(x > v if down else x < v for x in known)
            assert got[i] == 1 + better


def test_rank_correlations_take_one_plan_for_all_features(spark):
    import numpy as np

    from furlong.operators.analysis import outlier_rate, spearman_target

    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (300, 4)).astype(float)
    y = x[:, 0] - x[:, 1] + rng.normal(size=300)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    df = spark.createDataFrame([(None, *r[1:]) if k % 9 == 0 else r for k, r in enumerate(rows)], "a double, b double, c double, d double, y double")
    got = {r["feature"]: r["spearman"] for r in spearman_target(df, ["a", "b", "c", "d"], "y").collect()}

    def ranks(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    filled = x.copy()
    filled[::9, 0] = np.median(np.delete(x[:, 0], np.arange(0, 300, 9)))
    for k, name in enumerate("abcd"):
        assert got[name] == pytest.approx(np.corrcoef(ranks(filled[:, k]), ranks(y))[0, 1])
    size = lambda cols: len(spearman_target(df, cols, "y")._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(["a"]) == size(["a", "b", "c", "d"])
    few = df.limit(5).select("a", "b")
    assert {r["outlier_rate"] for r in outlier_rate(few, ["a", "b"]).collect()} == {None}


def test_shuffle_uses_every_value_once(spark):
    from furlong.operators.analysis import shuffled_column

    df = spark.createDataFrame([(i, float(i)) for i in range(300)], "k int, v double")
    out = shuffled_column(df, "v", ["k"]).collect()
    assert sorted(r["v"] for r in out) == [float(i) for i in range(300)]
    assert sum(r["k"] == r["v"] for r in out) < 30


def test_auc_against_pairs(spark):
    data = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)]
    m = M.eval_metrics(spark.createDataFrame(data, "p double, y int"), "p", "y").first()
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert m["auc"] == pytest.approx(want)


def test_done_dates(spark):
    df = spark.createDataFrame([("2024-01-01", 6, False), ("2024-01-02", 5, False), ("2024-01-03", 0, True), ("2024-02-01", 9, False)], "d string, race_count int, no_race boolean").withColumn("day", F.col("d").cast("date"))
    done = R.done_dates(df, F.lit("2024-02-05").cast("date"))
    assert sorted(r["d"] for r in done.collect()) == ["2024-01-01", "2024-01-03"]


def test_stream_keeps_late_rows_out(spark):
    path = shared_dir(spark, "test-stream")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("event_type", T.StringType())])

    def drop(name, rows):
        df = spark.createDataFrame(rows, "id long, t string, event_type string").select("id", F.col("t").cast("timestamp").alias("ts"), "event_type")
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")

    def run():
        stream = S.read_files(spark, f"{path}/in", schema, 1)
        q = S.stream_window_counts(stream, "ts", "event_type", "10 minutes", None, "10 minutes", f"{path}/rows", f"{path}/cp", once=True)
        q.awaitTermination(60)

    drop("a", [(1, "2024-01-01 00:01:00", "error"), (2, "2024-01-01 00:02:00", "error")])
    run()
    drop("b", [(3, "2024-01-01 03:00:00", "click")])
    run()
    drop("c", [(4, "2024-01-01 00:03:00", "error"), (5, "2024-01-01 03:01:00", "click")])
    run()
    counts_schema = S.window_counts(spark.createDataFrame([], schema), "ts", "event_type", "10 minutes").schema
    out = S.final_counts(S.read_batches(spark, f"{path}/rows", counts_schema), "event_type").collect()
    assert {(r["window_start"].strftime("%H:%M"), r["events"]) for r in out} == {("00:00", 2), ("03:00", 2)}


def test_a_card_of_one_race_is_read_by_a_pushed_filter(spark, small):
    from furlong.operators.lookup import race_card
    from furlong.verify.base import entries

    card = race_card(entries(spark, small), ["horse_id"], only=7)
    plan = card._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,7)" in plan and {r["race_id"] for r in card.collect()} == {7}


def test_importance_deals_rows_once_for_all_features_and_ranks_match_brute_force(spark, monkeypatch):
    from furlong.operators import analysis

    calls, number_rows = [], analysis.number_rows
    monkeypatch.setattr(analysis, "number_rows", lambda *a, **b: calls.append(a) or number_rows(*a, **b))
    rows = [(i, (i * 7) % 11, (i * 5) % 3, float(i % 4 > 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, a bigint, b bigint, y double")
    predict = lambda d: d.select((F.col("y") * 2 + F.col("a") * 0.01 + F.col("b") * 0).alias("p"), "y")
    out = {r.feature: r.importance for r in analysis.permutation_importance(df, predict, ["a", "b"], "y", "p", ["k"]).collect()}
    assert len(calls) == 2 and abs(out["b"]) < 1e-12 and set(out) == {"a", "b"}

    def mean_ranks(values):
        place = sorted(values)
        return [place.index(v) + (place.count(v) + 1) / 2 for v in values]

    long = [(f, float(x), float(y)) for f, n in (("u", 5), ("v", 40)) for x, y in (((i * 13) % n, (i * i) % 9) for i in range(200))]
    long += [("flat", 1.0, float(i)) for i in range(9)]
    got = {r.feature: r.spearman for r in analysis.rank_correlations(spark.createDataFrame(long, "feature string, x double, y double")).collect()}
    for f in ("u", "v"):
        x, y = (mean_ranks([r[k] for r in long if r[0] == f]) for k in (1, 2))
        mx, my = sum(x) / len(x), sum(y) / len(y)
        cov = sum((a - mx) * (b - my) for a, b in zip(x, y))
        want = cov / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
        assert abs(got[f] - want) < 1e-9
    assert got["flat"] == 0.0
