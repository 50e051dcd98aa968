"""History operators: nothing ahead, ties, order of rows, and hot entities against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from furlong.operators import history as H
from furlong.operators import skew as K
from furlong.operators import stats as S
from furlong.operators import within_group as G

SCHEMA = "race_id long, race_date date, jockey_id long, runner_no int, finish int, odds double"


def rows(seed=7, races=60, hot=True):
    import datetime

    rnd = random.Random(seed)
    out = []
    for race in range(races):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=race // 3)
        for no in range(1, 6):
            jockey = 1 if hot and rnd.random() < 0.4 else rnd.choice([2, 3, 4, None])
            out.append((race, day, jockey, no, rnd.choice([1, 2, 3, None]), rnd.choice([2.0, 3.5, 8.0, None])))
    return out


def frame(spark, data, parts=4):
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def collect(df, *cols):
    return {(r["race_id"], r["runner_no"]): tuple(r[c] for c in cols) for r in df.collect()}


def brute_prior(data, jockey, race):
    return [x for x in data if x[2] == jockey and (x[1], x[0]) < race]


@pytest.mark.parametrize("hot_rows", [10, K.HOT_ROWS])
def test_expanding_is_brute_force(spark, hot_rows):
    data = rows()
    got = collect(H.expanding_rate(frame(spark, data), ["jockey_id"], "j", hot_rows=hot_rows), "j_win_rate", "j_count")
    for race, day, jockey, no, _, _ in data:
        prior = brute_prior(data, jockey, (day, race)) if jockey else []
        wins = sum(x[4] == 1 for x in prior)
        assert got[race, no] == pytest.approx((wins / len(prior) if prior else 0.0, len(prior)))


@pytest.mark.parametrize("hot_rows", [10, K.HOT_ROWS])
def test_rolling_is_brute_force(spark, hot_rows):
    data = rows(seed=11)
    out = H.recent_rate(
        frame(spark, data), "jockey_id", "r", ["runner_no"], length=7, least=2, hot_rows=hot_rows
    )
    got = collect(out, "r")
    for race, day, jockey, no, _, _ in data:
        prior = sorted(brute_prior(data, jockey, (day, race)) if jockey else [], key=lambda x: (x[1], x[0], x[3]))[-7:]
        known = [x[4] for x in prior if x[4] is not None]
        want = sum(f == 1 for f in known) / len(known) if len(known) >= 2 else None
        assert got[race, no][0] == (None if want is None else pytest.approx(want))


def test_day_range_is_brute_force(spark):
    data = rows(seed=3)
    got = collect(H.range_rates(frame(spark, data), "jockey_id", "j", days=5), "j_rides", "j_win_rate")
    for race, day, jockey, no, _, _ in data:
        prior = [x for x in data if jockey and x[2] == jockey and 1 <= (day - x[1]).days <= 5]
        wins = sum(x[4] == 1 for x in prior)
        assert got[race, no] == pytest.approx((len(prior), wins / len(prior) if prior else 0.0))


@pytest.mark.parametrize("hot_rows", [10, K.HOT_ROWS])
def test_no_look_ahead(spark, hot_rows):
    """Other outcomes from a race on leave the features up to that race as they were."""
    data = rows(seed=5)
    cut = 31  # the second race of its day
    changed = [x if x[0] < cut else (*x[:4], 1 if x[4] != 1 else 3, x[5]) for x in data]

    def features(d):
        df = frame(spark, d)
        out = H.entity_career(df, "jockey_id", "j", hot_rows=hot_rows)
        out = H.recent_form(out, "jockey_id", ["runner_no"], hot_rows=hot_rows, source=df)
        out = H.range_rates(out, "jockey_id", "k", days=30)
        names = [c for c in out.columns if c not in df.columns]
        return collect(out.filter(F.col("race_id") <= cut), *names)

    assert features(data) == features(changed)


def test_order_of_rows_does_not_matter(spark):
    data = rows(seed=9)
    shuffled = random.Random(1).sample(data, len(data))

    def run(d, parts):
        df = frame(spark, d, parts)
        out = H.recent_form(H.entity_career(df, "jockey_id", "j"), "jockey_id", ["runner_no"], source=df)
        return collect(out, *[c for c in out.columns if c not in df.columns])

    assert run(data, 1) == run(shuffled, 7)


def test_compat_counts_missing_finish(spark):
    data = [(1, "2024-01-01", 5, None), (2, "2024-01-02", 5, 1)]
    df = spark.createDataFrame(data, "race_id long, d string, jockey_id long, finish int").withColumn("race_date", F.col("d").cast("date"))
    for compat, want in ((False, 0.0), (True, 1.0)):
        out = H.entity_career(df, "jockey_id", "j", compat=compat).filter("race_id = 2").first()
        assert out["j_top3_rate"] == want


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.recent_form(H.expanding_rate(df, ["jockey_id"], "j"), "jockey_id", ["runner_no"]).count() == 0


@pytest.mark.parametrize("hot_rows", [10, K.HOT_ROWS])
def test_ranks_of_hot_groups(spark, hot_rows):
    rnd = random.Random(2)
    data = [(i, 1 if i < 150 else i % 5, rnd.choice([None, round(rnd.random() * 50, 1)])) for i in range(300)]
    df = spark.createDataFrame(data, "i int, g int, v double").repartition(5)
    for descending in (False, True):
        got = {r["i"]: r["rk"] for r in K.ranked(df, ["g"], "v", "rk", descending, hot_rows=hot_rows).collect()}
        avg = {r["i"]: r["a"] for r in G.average_rank(df, ["g"], "v", "a", hot_rows=hot_rows).collect()}
        for i, g, v in data:
            peers = [x[2] for x in data if x[1] == g]
            if v is None:
                assert got[i] == 1 + sum(x is not None for x in peers) and avg[i] is None
                continue
            better = sum(x is not None and (x > v if descending else x < v) for x in peers)
            assert got[i] == 1 + better
            lower, same = sum(x is not None and x < v for x in peers), sum(x == v for x in peers)
            assert avg[i] == lower + (same + 1) / 2


@pytest.mark.parametrize("hot_rows", [10, K.HOT_ROWS])
def test_running_money_of_a_hot_user(spark, hot_rows):
    data = [(i, 1 if i % 3 else 2, f"2024-01-{1 + i % 20:02d} 10:00:{i % 60:02d}", 100, 250 if i % 4 == 0 else 0) for i in range(120)]
    df = spark.createDataFrame(data, "event_id int, u int, t string, cost long, payout long").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r["event_id"]: (r["cum_cost"], r["cum_return"]) for r in H.cumulative_pnl(df, ["u"], "ts", "event_id", hot_rows=hot_rows).collect()}
    for i, u, t, _, _ in data:
        upto = [x for x in data if x[1] == u and (x[2], x[0]) <= (t, i)]
        assert got[i] == (sum(x[3] for x in upto), sum(x[4] for x in upto))


def test_quantiles_are_exact(spark):
    import numpy as np

    rnd = random.Random(4)
    xs = [rnd.choice([rnd.gauss(0, 100), 5.0, -3.25, 1e6 * rnd.random()]) for _ in range(501)]
    df = spark.createDataFrame([(x, None if i % 3 else x) for i, x in enumerate(xs)], "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["column"]: r["q"] for r in K.column_quantiles(df, ["a", "b"], probs).collect()}
    assert got["a"] == pytest.approx(list(np.quantile(xs, probs)))
    assert got["b"] == pytest.approx(list(np.quantile(xs[::3], probs)))


def test_implied_probabilities_sum_to_one(spark):
    data = [("r", 1, 2.0), ("r", 2, 4.0), ("r", 3, 8.0), ("s", 1, 2.0), ("s", 2, None), ("s", 3, 8.0)]
    df = spark.createDataFrame(data, "race_id string, no int, odds double").withColumn("p", 1 / F.col("odds"))
    sums = G.normalise(df, ["race_id"], "p", "n").groupBy("race_id").agg(F.sum("n").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)


def test_gate_bias_as_of_sees_only_the_past(spark):
    df = frame(spark, rows(seed=8)).withColumn("gate", F.col("runner_no") % 2)
    first = S.gate_bias(df, ["gate"], least=1, as_of=True).filter("race_id = 0").select("gate_win_rate").distinct().collect()
    assert [r[0] for r in first] == [0.5]
