"""The prediction plan against the build over all rows."""

import math

import pytest
from pyspark.sql import functions as F

from furlong.operators import model as M
from furlong.plans import features as P
from furlong.plans import predict as W
from furlong.plans.partitioned import partitioned_build
from furlong.verify.base import TIE, runners

CUT = "1997-06-01"


@pytest.fixture(scope="module")
def rows(spark, small):
    gone = lambda c, every: F.when(F.xxhash64("race_id", "runner_no") % every != 0, F.col(c)).alias(c)
    df = runners(spark, small).filter("race_id % 4 = 0")
    return P.stored(df.select(*[gone(c, 7) if c in ("jockey_id", "sire") else F.col(c) for c in df.columns]))


@pytest.fixture(scope="module")
def made(rows):
    return P.stored(W.target_features(rows.filter(F.col("race_date") >= CUT), rows.filter(F.col("race_date") < CUT), TIE))


def cell(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def test_target_features_equal_the_whole_build(rows, made):
    hidden = rows.withColumn("finish", F.when(F.col("race_date") < CUT, F.col("finish")))
    want = partitioned_build(hidden, TIE).filter(F.col("race_date") >= CUT)
    assert set(want.columns) == set(made.columns)
    columns = sorted(want.columns)
    got, whole = ([tuple(cell(r[c]) for c in columns) for r in df.collect()] for df in (made, want))
    assert len(got) > 100 and sorted(got, key=str) == sorted(whole, key=str)


def test_results_of_the_target_do_not_reach_its_features(rows, made):
    late = rows.filter(F.col("race_date") >= CUT)
    changed = W.target_features(late.withColumn("finish", F.lit(1)), rows.filter(F.col("race_date") < CUT), TIE)
    columns = sorted(made.columns)
    assert sorted(str(tuple(cell(r[c]) for c in columns)) for r in changed.collect()) == sorted(
        str(tuple(cell(r[c]) for c in columns)) for r in made.collect()
    )


def test_a_fitted_model_scores_and_races_sum_to_one(rows, made):
    train = rows.filter("finish IS NOT NULL").withColumn("label", (F.col("finish") <= 3).cast("double"))
    model = M.train_logistic(train, M.prep_stages(["odds", "runner_no"], ["surface"]))
    out = W.predict_races(made, W.Scorer.of_model(model), W.Scorer.of_model(model, "place3")).collect()
    assert len(out) == made.count()
    races = {}
    for r in out:
        races.setdefault(r["race_id"], []).append(r)
        assert r["expected_value"] == pytest.approx(r["p_norm"] * r["odds"])
    for group in races.values():
        assert sum(r["p_norm"] for r in group) == pytest.approx(1)
        assert sum(r["p_ensemble"] for r in group) == pytest.approx(1)
        best = max(group, key=lambda r: r["p_raw"])
        assert best["predicted_rank"] == 1


def test_races_are_dealt_once_and_hot_or_missing_ones_get_the_same_numbers(spark, rows, made):
    main = W.Scorer.of_column(F.round(0.1 + F.col("odds") / 300, 9))
    place = W.Scorer.of_column(F.when(F.col("runner_no") != 3, F.col("odds") / 500), "place3")
    known = made.filter("race_id IS NOT NULL")
    usual = W.predict_races(known, main, place)
    plan = usual._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(race_id") == plan.count("Exchange hashpartitioning(") == 1
    columns = ["race_id", "runner_no", "horse_id", "p_raw", "p_norm", "predicted_rank", "p_ensemble", "expected_value"]
    got, hot = ([tuple(cell(r[c]) for c in columns) for r in df.collect()] for df in (usual, W.predict_races(known, main, place, hot_rows=3)))
    assert sorted(got, key=str) == sorted(hot, key=str)
    speed = [W.predict_races(known, W.Scorer(main.score, "rank"), hot_rows=n).collect() for n in (2_000_000, 3)]
    got, hot = ([tuple(cell(r[c]) for c in columns) for r in out] for out in speed)
    assert sorted(got, key=str) == sorted(hot, key=str)


def test_a_race_that_is_also_in_the_history_counts_once(rows, made):
    late, early = rows.filter(F.col("race_date") >= CUT), rows.filter(F.col("race_date") < CUT)
    twice = W.target_features(late, early.unionByName(late.filter("race_id % 8 = 0")), TIE)
    columns = sorted(made.columns)
    got, want = (sorted(str(tuple(cell(r[c]) for c in columns)) for r in df.collect()) for df in (twice, made))
    assert got == want


def test_empty_target_and_no_history(spark, rows):
    none = rows.filter("false")
    assert W.target_features(none, rows, TIE).count() == 0
    one = W.target_features(rows.filter("race_id % 40 = 0"), none, TIE)
    got = one.collect()
    assert len(got) > 0 and {r["jockey_course_win_rate"] for r in got} == {0.0}


def test_features_are_not_written_where_races_are_counted_on_a_source(rows, made, monkeypatch):
    main = W.Scorer.of_column(F.round(0.1 + F.col("odds") / 300, 9))
    place = W.Scorer.of_column(F.when(F.col("runner_no") != 3, F.col("odds") / 500), "place3")
    known = made.filter("race_id IS NOT NULL")
    columns = ["race_id", "runner_no", "horse_id", "p_raw", "p_norm", "predicted_rank", "p_ensemble", "expected_value"]
    cells = lambda df: sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=str)
    want = cells(W.predict_races(known, main, place))
    written, store = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df: written.append(df) or store(df))
    lazy = W.predict_races(known, main, place, source=known)
    assert not written and cells(lazy) == want
    plan = lazy.select("race_id", "p_norm")._jdf.queryExecution().executedPlan().toString()
    assert "jockey_180d" not in plan
    assert cells(W.predict_races(known, main, place, hot_rows=3, source=known)) == want and len(written) == 1
