"""Betting queries: scored runners are line items, their probability made from the price."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.functions.racing import month_season
from furlong.operators import betting as B
from furlong.verify.base import TIE, entries, query, r, races, runners, table, with_entries, with_runners

ID = ["race_id", "runner_no", "horse_id", "jockey_id"]
ID_SQL = "race_id, runner_no, horse_id, jockey_id"
TIE_SQL = "runner_no, horse_id, jockey_id, price, qty, discount, tax"

# p from the root of the price, odds from the quantity: irrational values have no rounding ties.
SCORED_SQL = """scored AS (SELECT *, sqrt(price) / 1000 AS p, CASE WHEN runner_no <> 7 THEN qty / 2 + 1.0::DOUBLE END AS o,
  CASE WHEN runner_no <> 7 THEN sqrt(price) / 1000 * (qty / 2 + 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS ev FROM entries)"""


def scored(df):
    df = df.withColumn("p", F.sqrt("price") / 1000)
    df = df.withColumn("o", F.when(F.col("runner_no") != 7, F.col("qty") / 2 + 1.0))
    return df.withColumn("ev", B.expected_value(F.col("o"), F.col("p")))


@query(
    "expected_value",
    with_entries(
        f"""SELECT {ID_SQL}, round(CASE WHEN runner_no = 7 THEN 0.0 ELSE coalesce(nullif(discount, 0), nullif(tax, 0), 0.25) * sqrt(odds) END, 6) AS expected_value FROM entries"""
    ),
)
def expected_value(spark, sf):
    odds = F.when(F.col("runner_no") != 7, F.sqrt("odds"))
    ev = B.expected_value(odds, F.col("discount"), F.col("tax"), F.lit(0.25))
    return entries(spark, sf).select(*ID, F.round(ev, 6).alias("expected_value"))


@query(
    "difficulty",
    with_entries(
        f""", {SCORED_SQL}, seen AS (SELECT race_id, CASE WHEN race_id % 40 <> 0 AND runner_no <> 3 THEN p END AS p FROM scored)
        SELECT race_id, round(CASE WHEN count(p) = 0 THEN 0.0 ELSE least(1.0::DOUBLE, (stddev_pop(p) * 10 + max(p) / (avg(p) + 1e-6) / 5) / 2) END, 6) AS difficulty,
        round(CASE WHEN count(p) = 0 THEN 0.0 ELSE least(stddev_pop(p) * 5, 1.0::DOUBLE) END, 6) AS difficulty_spread FROM seen GROUP BY race_id"""
    ),
)
def difficulty(spark, sf):
    df = scored(entries(spark, sf))
    df = df.withColumn("p", F.when((F.col("race_id") % 40 != 0) & (F.col("runner_no") != 3), F.col("p")))
    a = B.difficulty(df, "race_id", "p")
    b = B.difficulty(df, "race_id", "p", "spread").withColumnRenamed("difficulty", "difficulty_spread")
    return a.join(b, "race_id").select("race_id", r("difficulty"), r("difficulty_spread"))


@query(
    "longshot",
    with_entries(
        f""", {SCORED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY coalesce(o, 999.0), {TIE_SQL}) AS rk FROM scored),
        g AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY rk) AS first_no FROM k WHERE rk BETWEEN 4 AND 9 AND ev >= 2.5 AND o >= 8)
        SELECT race_id, CAST(rk AS INTEGER) AS popularity_rank, o, round(ev, 6) AS ev, runner_no, horse_id FROM g WHERE first_no = 1"""
    ),
)
def longshot(spark, sf):
    out = B.longshot(scored(entries(spark, sf)), "race_id", "o", "ev", TIE, ["runner_no", "horse_id"])
    return out.select("race_id", "popularity_rank", "o", r("ev"), "runner_no", "horse_id")


@query(
    "season_bonus",
    "SELECT o_orderkey AS race_id, CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 1.10 WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 0.90 WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 1.05 ELSE 1.0 END::DOUBLE AS bonus FROM orders",
)
def season_bonus(spark, sf):
    return races(spark, sf).select("race_id", B.season_bonus(F.col("race_date")).alias("bonus"))


@query(
    "jockey_bonus",
    with_entries(
        f""", {SCORED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY ev DESC, {TIE_SQL}) AS rk FROM scored)
        SELECT race_id, count(s_suppkey) AS listed_jockeys, CASE WHEN count(s_suppkey) > 0 THEN 1.15 ELSE 1.0 END::DOUBLE AS bonus
        FROM k LEFT JOIN supplier ON jockey_id = s_suppkey AND s_acctbal > 8000 WHERE rk <= 3 GROUP BY race_id"""
    ),
)
def jockey_bonus(spark, sf):
    listed = table(spark, sf, "supplier").filter("s_acctbal > 8000").select(F.col("s_suppkey").alias("jockey_id"))
    return B.jockey_bonus(scored(entries(spark, sf)), listed, "race_id", "jockey_id", "ev", TIE)


_DIFF_SQL = f"""{SCORED_SQL}, d AS (SELECT race_id, round(least(1.0::DOUBLE, (stddev_pop(p) * 10 + max(p) / (avg(p) + 1e-6) / 5) / 2), 6) AS difficulty,
   round(max(ev), 6) AS max_ev, round(max(p), 6) AS max_p FROM scored GROUP BY race_id)"""
_ACTION_SQL = """CASE WHEN difficulty >= 0.7 AND max_ev >= 3 THEN '勝負' WHEN max_ev < 1.2 THEN '見送り' WHEN difficulty < 0.15 AND max_ev < 1.5 THEN '見送り' ELSE '通常' END"""


def _assessed(spark, sf):
    df = scored(entries(spark, sf))
    top = df.groupBy("race_id").agg(F.round(F.max("ev"), 6).alias("max_ev"), F.round(F.max("p"), 6).alias("max_p"))
    return B.difficulty(df, "race_id", "p").withColumn("difficulty", F.round("difficulty", 6)).join(top, "race_id")


@query(
    "pro_action",
    with_entries(
        f""", {_DIFF_SQL} SELECT race_id, {_ACTION_SQL} AS action, CASE WHEN difficulty >= 0.6 THEN 'high' WHEN difficulty >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM d"""
    ),
)
def pro_action(spark, sf):
    action, confidence = B.pro_action(F.col("difficulty"), F.col("max_ev"))
    return _assessed(spark, sf).select("race_id", action.alias("action"), confidence.alias("confidence"))


def _combo(kind, legs, cond, mark, factor):
    names = f" || '{mark}' || ".join(f"{x}.runner_no" for x in legs) if len(legs) > 1 else "CAST(a.runner_no AS VARCHAR)"
    total = " + ".join(f"{x}.ev" for x in legs)
    prod = " * ".join(f"{x}.p" for x in legs)
    joins = " ".join(f"JOIN top {x} ON a.race_id = {x}.race_id" for x in legs[1:])
    seq = ", ".join(f"{x}.rk AS k{i}" for i, x in enumerate(legs)) + "".join(f", 0 AS k{i}" for i in range(len(legs), 3))
    where = f"WHERE {cond}" if cond else ""
    return (
        f"SELECT a.race_id, '{kind}' AS bet_type, {names} AS combination, ({total}) / {len(legs)} AS ev, "
        f"{factor}::DOUBLE * {prod} AS p, {seq} FROM top a {joins} {where}"
    )


CANDIDATES_SQL = f"""{SCORED_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY ev DESC, {TIE_SQL}) AS rk FROM scored) WHERE rk <= 5),
  combos AS ({" UNION ALL ".join([
      _combo("単勝", ["a"], "", "", 1.0),
      _combo("馬連", ["a", "b"], "a.rk < b.rk", "-", 1.0),
      _combo("ワイド", ["a", "b"], "a.rk < b.rk", "-", 1.0),
      _combo("三連複", ["a", "b", "c"], "a.rk < b.rk AND b.rk < c.rk", "-", 1.0),
      _combo("馬単", ["a", "b"], "a.rk <> b.rk", "→", 0.5),
      _combo("三連単", ["a", "b", "c"], "a.rk <> b.rk AND b.rk <> c.rk AND a.rk <> c.rk", "→", 0.3),
  ])}),
  cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id, bet_type ORDER BY round(ev, 9) DESC, k0, k1, k2) AS position FROM combos)
    WHERE position <= CASE bet_type WHEN '馬単' THEN 20 WHEN '三連単' THEN 30 ELSE 1000 END)"""


def _candidates(spark, sf):
    return B.bet_candidates(scored(entries(spark, sf)), "race_id", "runner_no", "ev", "p", TIE)


@query(
    "bet_candidates",
    with_entries(
        f", {CANDIDATES_SQL} SELECT race_id, bet_type, combination, round(ev, 6) AS expected_value, round(p, 8) AS probability, CAST(position AS INTEGER) AS position FROM cand"
    ),
)
def bet_candidates(spark, sf):
    return _candidates(spark, sf).select(
        "race_id", "bet_type", "combination", r("expected_value"), r("probability", 8), "position"
    )


_BEST_SQL = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(mx, 9) DESC, list_position(['単勝', '馬連', 'ワイド', '三連複', '馬単', '三連単'], bet_type)) AS rn FROM
   (SELECT race_id, bet_type, max(ev) AS mx, avg(ev) AS av, count(*) AS n, max(p) AS mp FROM cand GROUP BY 1, 2) WHERE mx > 0) WHERE rn = 1)"""


@query(
    "best_bet_type",
    with_entries(
        f", {CANDIDATES_SQL}, {_BEST_SQL} SELECT race_id, bet_type AS best_bet_type, round(av, 2) AS avg_ev, round(mx, 2) AS max_ev, n AS candidates, round(mp, 4) AS max_probability FROM best"
    ),
)
def best_bet_type(spark, sf):
    return B.best_bet_type(_candidates(spark, sf), "race_id")


_LEVEL_SQL = f"""CASE WHEN {_ACTION_SQL} = '見送り' THEN 'skip' WHEN max_ev < 1.2 THEN 'skip' WHEN difficulty >= 0.7 OR (max_ev >= 4 AND max_p >= 0.25) OR max_ev >= 6 THEN 'decisive' ELSE 'normal' END"""


def _levels(spark, sf):
    df = _assessed(spark, sf)
    action, _ = B.pro_action(F.col("difficulty"), F.col("max_ev"))
    return df.withColumn("level", B.race_level(action, F.col("max_ev"), F.col("max_p"), F.col("difficulty")))


@query("race_level", with_entries(f", {_DIFF_SQL} SELECT race_id, {_LEVEL_SQL} AS level FROM d"))
def race_level(spark, sf):
    return _levels(spark, sf).select("race_id", "level")


@query(
    "stake_sizing",
    with_entries(
        f""", {_DIFF_SQL}, l AS (SELECT race_id, {_LEVEL_SQL} AS level, [1000, 3000, 5000, 10000][race_id % 4 + 1] AS lim, ['単勝', '馬連', '馬単', '三連単', '?'][race_id % 5 + 1] AS bt FROM d),
        u AS (SELECT *, CASE level WHEN 'skip' THEN 100 WHEN 'decisive' THEN CASE WHEN lim >= 5000 THEN 1000 WHEN lim >= 3000 THEN 500 ELSE 200 END ELSE CASE WHEN lim >= 3000 THEN 200 ELSE 100 END END AS up,
          CAST(floor(lim * CASE level WHEN 'skip' THEN 0.0 WHEN 'normal' THEN 0.4 ELSE 0.8 END) AS BIGINT) AS budget, CASE bt WHEN '単勝' THEN 3 WHEN '馬連' THEN 10 WHEN '馬単' THEN 20 WHEN '三連単' THEN 30 ELSE 10 END AS pts FROM l)
        SELECT race_id, level, up AS unit_price, budget, CASE WHEN budget <= 0 THEN 0 ELSE greatest(1, least(pts, budget // up)) END AS purchase_count,
          CASE WHEN budget <= 0 THEN 0 ELSE greatest(1, least(pts, budget // up)) END * up AS total_cost FROM u"""
    ),
)
def stake_sizing(spark, sf):
    k = F.col("race_id")
    limit = F.get(F.array(*[F.lit(x) for x in (1000, 3000, 5000, 10000)]), (k % 4).cast("int"))
    kind = F.get(F.array(*[F.lit(x) for x in ("単勝", "馬連", "馬単", "三連単", "?")]), (k % 5).cast("int"))
    stake = B.stake_sizing(F.col("level"), kind, limit)
    return _levels(spark, sf).select("race_id", "level", *[c.alias(n) for n, c in stake.items()])


@query(
    "kelly",
    with_entries(
        f""", {SCORED_SQL} SELECT {ID_SQL}, CASE WHEN o > 1 AND (p * o - 1) / (o - 1) > 0 THEN CAST(floor(100000 * least((p * o - 1) / (o - 1) * 0.25::DOUBLE, 0.05::DOUBLE)) AS BIGINT) ELSE 0 END AS stake FROM scored"""
    ),
)
def kelly(spark, sf):
    return scored(entries(spark, sf)).select(*ID, B.kelly(F.col("p"), F.col("o"), 100000.0).alias("stake"))


_LIST_SQL = f"""{CANDIDATES_SQL}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY list_position(['単勝', '馬連', 'ワイド', '三連複', '馬単', '三連単'], bet_type), position) AS bet_no
   FROM cand WHERE ev >= 1.2 AND p >= 0.005) WHERE bet_no <= 6),
  nm AS (SELECT race_id, runner_no, min(horse_id) AS h FROM entries GROUP BY 1, 2),
  legs AS (SELECT race_id, bet_no, unnest(regexp_split_to_array(combination, '[-→]')) AS no, generate_subscripts(regexp_split_to_array(combination, '[-→]'), 1) AS i FROM kept),
  named AS (SELECT l.race_id, bet_no, string_agg('H' || h, ' / ' ORDER BY i) AS horses FROM legs l JOIN nm ON l.race_id = nm.race_id AND CAST(l.no AS INTEGER) = nm.runner_no GROUP BY 1, 2)"""


def _bets(spark, sf):
    df = scored(entries(spark, sf)).withColumn("name", F.col("horse_id"))
    cand = B.bet_candidates(df, "race_id", "runner_no", "ev", "p", TIE, gathered=True)
    names = df.groupBy("race_id", "runner_no").agg(F.concat(F.lit("H"), F.min("name")).alias("name"))
    return B.bet_list(cand, names, "race_id", "runner_no", "name", 1.2, 0.005, 6)


@query(
    "bet_list",
    with_entries(
        f""", {_LIST_SQL} SELECT k.race_id, CAST(k.bet_no AS INTEGER) AS bet_no, bet_type, combination, horses AS horse_names, 100 AS total_cost, round(ev, 3) AS expected_value
        FROM kept k JOIN named n ON k.race_id = n.race_id AND k.bet_no = n.bet_no"""
    ),
)
def bet_list(spark, sf):
    return _bets(spark, sf).select(
        "race_id", "bet_no", "bet_type", "combination", F.array_join("horse_names", " / ").alias("horse_names"),
        "total_cost", r("expected_value", 3),
    )


@query(
    "bet_totals",
    with_entries(f", {_LIST_SQL} SELECT count(*) AS bets, count(DISTINCT race_id) AS races, count(*) * 100 AS total_cost FROM kept"),
)
def bet_totals(spark, sf):
    return B.bet_totals(_bets(spark, sf), "race_id")


@query(
    "season_label",
    with_runners(
        f"""SELECT {ID_SQL}, CASE WHEN month(race_date) BETWEEN 3 AND 5 THEN '春' WHEN month(race_date) BETWEEN 6 AND 8 THEN '夏' WHEN month(race_date) BETWEEN 9 AND 11 THEN '秋' ELSE '冬' END AS season,
        CASE WHEN qty % 3 > 0 THEN round(CAST(qty AS INTEGER) * 100 / CAST((CAST(qty AS INTEGER) % 3) * 300 AS DOUBLE) * 100, 1) ELSE 0.0 END AS recovery_rate FROM runners"""
    ),
)
def season_label(spark, sf):
    from furlong.operators.stats import percent

    q = F.col("qty").cast("int")
    return runners(spark, sf).select(
        *ID, month_season(F.col("race_date")).alias("season"), percent(q * 100, (q % 3) * 300).alias("recovery_rate")
    )
