"""The partitioned build against the build of single operators, with hot and missing keys."""

import math

import pytest
from pyspark.sql import functions as F

from furlong.plans import features as P
from furlong.plans.partitioned import entities, partitioned_build, uneven
from furlong.verify.base import TIE, runners
from furlong.verify.windows import with_closing


@pytest.fixture(scope="module")
def rows(spark, small):
    """Runners with numbers, some without a jockey, horse, trainer or race."""
    df = with_closing(runners(spark, small)).filter("race_id % 3 = 0")
    gone = lambda c, every: F.when(F.xxhash64("race_id", "runner_no") % every != 0, F.col(c)).alias(c)
    lost = {"jockey_id": 7, "horse_id": 11, "sire": 5}
    return P.stored(
        df.select(*[gone(c, lost[c]) if c in lost else F.col(c) for c in df.columns])
    )


def values(df, columns):
    def cell(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=str)


def test_equals_the_build_of_single_operators(rows):
    stages = [*P.RACE_STAGES, P.rest, P.aptitude, P.people, P.gates, lambda d, b: P.form(d, b, TIE)]
    want = P.feature_build(rows, stages).drop("inner_gate")
    usual, hot = partitioned_build(rows, TIE), partitioned_build(rows, TIE, hot_rows=8)
    assert set(usual.columns) == set(hot.columns) == set(want.columns)
    columns = sorted(want.columns)
    expected = values(want, columns)
    assert values(usual, columns) == expected
    assert values(hot, columns) == expected


def test_one_pass_finds_the_hot_and_the_missing_keys(rows):
    base = P.with_scalars(rows)
    keys = list(entities(base))
    assert uneven(base, keys) == {"jockey_id": [None], "horse_id": [None], "sire": [None]}
    found = uneven(base, keys, 8)
    for key in keys:
        counts = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
        assert set(found.get(key, [])) == {k for k, n in counts.items() if n > 8 or k is None}


def test_a_window_of_an_entity_needs_one_shuffle(spark, rows):
    known = rows.filter("jockey_id IS NOT NULL AND horse_id IS NOT NULL AND sire IS NOT NULL")
    base = P.with_scalars(P.stored(known))
    for key, build in entities(base, TIE).items():
        from furlong.plans.partitioned import of_entity

        plan = of_entity(base, key, build, ())._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, key


def test_branches_read_a_number_for_ties_and_send_totals(spark, rows):
    known = P.stored(rows.filter("jockey_id IS NOT NULL AND horse_id IS NOT NULL AND sire IS NOT NULL"))
    course = spark.createDataFrame([("v", "A", 1000, 300.0)], "venue string, surface string, distance int, straight double")
    out = partitioned_build(known, TIE, [P.course(course, {"straight": 250.0})])
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [line for line in plan if "FileScan parquet" in line and "_row#" in line]
    assert len(scans) == 7 and sum("price#" in line for line in scans) == 1  # the rows themselves, no branch
    assert not [line for line in plan if "Exchange hashpartitioning(race_id" in line]


def test_laps_and_course_stages(spark):
    rows = spark.createDataFrame(
        [("v", "A", 1000, 1, {200: 12.0, 400: 24.0, 600: 37.0, 800: 50.0, 1000: 900.0}), ("v", "A", 900, 5, {200: 13.0}), ("w", "A", 300, None, None)],
        "venue string, surface string, distance int, runner_no int, laps map<int,double>",
    )
    course = spark.createDataFrame([("v", "A", 1000, 300.0, 1), ("v", "A", 2000, 400.0, 0)], "venue string, surface string, distance int, straight double, bias int")
    out = P.course(course, {"straight": 250.0, "bias": 0}, "bias")(P.laps("laps", [200, 400, 600, 800, 1000])(rows, rows), rows)
    first, second, third = sorted(out.collect(), key=lambda r: -r.distance)
    assert (first.lap_400m, first.lap_sect_400m, first.lap_sect_1000m) == (24.0, 12.0, None)
    assert (first.race_pace_front, first.race_pace_back, first.race_pace_diff) == (12.0, 13.0, -1.0)
    assert (first.straight, first.inner_advantage, second.straight, second.inner_advantage) == (300.0, 1, 300.0, 0)
    assert second.race_pace_front is None and (third.straight, third.inner_advantage, third.lap_200m) == (250.0, 0, None)


def exchanged(df, column, capsys):
    """How many exchanges carry the column."""
    capsys.readouterr()
    df.explain("formatted")
    parts = capsys.readouterr().out.split("\n\n")
    return sum(") Exchange" in p and f"{column}#" in p.split("Arguments")[0] for p in parts)


def test_the_build_of_single_operators_shuffles_whole_rows_once(rows, capsys):
    df = rows.filter("race_id IS NOT NULL").withColumn("note", F.concat_ws("-", "race_id", "runner_no"))
    out = P.feature_build(df)
    assert "_row" not in out.columns and exchanged(out, "note", capsys) == 1
    assert out.select("note").count() == df.count()


def test_market_deals_even_races_twice(rows):
    base = P.with_scalars(P.stored(rows.filter("race_id IS NOT NULL")))
    plan = P.market(base, base)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(race_id") == plan.count("Exchange hashpartitioning(") == 2
    lost = rows.filter("race_id % 2 = 0").withColumn("race_id", F.when(F.col("runner_no") < 3, F.col("race_id")))
    base = P.with_scalars(P.stored(lost))
    assert not P.even(base, "race_id") and P.market(base, base).count() == lost.count()


def test_rows_meet_without_what_they_tell_by_themselves(rows, capsys):
    known = P.stored(rows.filter("jockey_id IS NOT NULL AND horse_id IS NOT NULL AND sire IS NOT NULL"))
    out = partitioned_build(known, TIE)
    assert {"gate_ratio", "implied_prob", "odds_is_missing"} <= set(out.columns)
    assert [exchanged(out, c, capsys) for c in ("gate_ratio", "implied_prob", "odds_is_missing")] == [0, 0, 0]
