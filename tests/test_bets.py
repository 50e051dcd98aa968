"""Bets stay inside the row of their race: brute force values, and a plan without a sort of candidates."""

import random
from itertools import combinations, permutations

from furlong.operators import betting as B


def scored(spark, races=12):
    rng = random.Random(4)
    rows = [(k, n, rng.random() * 3, rng.random()) for k in range(races) for n in range(1, 1 + k % 8)]
    rows += [(99, n, 1.5, 0.5) for n in range(1, 7)]  # equal values: the ranks decide
    return spark.createDataFrame(rows, "race_id int, no int, ev double, p double"), rows


def test_candidates_and_list(spark):
    df, rows = scored(spark)
    got, gathered = {}, B.bet_candidates(df, "race_id", "no", "ev", "p", ["no"], gathered=True)
    for r in B.bet_candidates(df, "race_id", "no", "ev", "p", ["no"]).collect():
        got.setdefault(r["race_id"], []).append(tuple(r)[1:])
    names = df.filter("no <> 2").selectExpr("race_id", "no", "concat('H', no) AS name")
    listed = {(r["race_id"], r["bet_no"]): r for r in B.bet_list(gathered, names, "race_id", "no", "name", 1.2, 0.05, 4).collect()}
    n = 0
    for race in {r[0] for r in rows}:
        top = sorted((r for r in rows if r[0] == race), key=lambda r: (-r[2], r[1]))[:5]
        want = []
        for kind, rule in B.BET_TYPES.items():
            ways = list((permutations if rule["ordered"] else combinations)(range(len(top)), rule["size"]))
            bets = []
            for w in ways:
                p = rule["factor"]
                for i in w:
                    p *= top[i][3]
                mean = sum(top[i][2] for i in w) / len(w)
                bets.append((-round(mean, 9), w, ("→" if rule["ordered"] else "-").join(str(top[i][1]) for i in w), mean, p))
            bets.sort()
            want += [(kind, b[2], b[3], b[4], k) for k, b in enumerate(bets[: rule["keep"]], 1)]
        kinds = list(B.BET_TYPES)
        have = sorted(got[race], key=lambda b: (kinds.index(b[0]), b[4]))
        assert [(b[0], b[1], b[4]) for b in have] == [(b[0], b[1], b[4]) for b in want]
        assert all(abs(x[2] - y[2]) < 1e-9 and abs(x[3] - y[3]) < 1e-9 for x, y in zip(have, want, strict=True))
        for k, b in enumerate([b for b in want if b[2] >= 1.2 and b[3] >= 0.05][:4], 1):
            legs = b[1].replace("→", "-").split("-")
            r = listed[race, k]
            assert (r["bet_type"], r["combination"], r["position"]) == (b[0], b[1], b[4])
            assert r["horse_names"] == ["#2" if x == "2" else f"H{x}" for x in legs]
            n += 1
    assert n == len(listed)


def test_no_window_over_candidates(spark):
    df, _ = scored(spark)
    # the one over runners, cut to the best of a race, is the only one
    for gathered in (False, True):
        bets = B.bet_candidates(df, "race_id", "no", "ev", "p", ["no"], gathered=gathered)
        plan = bets._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 1 and plan.count("Sort ") == 0
    listed = B.bet_list(bets, df.selectExpr("race_id", "no", "'x' AS name"), "race_id", "no", "name", 1.2, 0.05, 4)
    assert listed._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
