"""From scored runners to bets: expected value, race assessment, combinations, stakes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions.racing import season_code
from furlong.operators.joins import top_per_group

# Bet types in the order that decides ties, the number of runners in one,
# whether order matters, the factor on the probability, the most candidates kept and the
# most points bought.
BET_TYPES = {
    "単勝": {"size": 1, "ordered": False, "factor": 1.0, "keep": None, "points": 3},
    "馬連": {"size": 2, "ordered": False, "factor": 1.0, "keep": None, "points": 10},
    "ワイド": {"size": 2, "ordered": False, "factor": 1.0, "keep": None, "points": 10},
    "三連複": {"size": 3, "ordered": False, "factor": 1.0, "keep": None, "points": 10},
    "馬単": {"size": 2, "ordered": True, "factor": 0.5, "keep": 20, "points": 20},
    "三連単": {"size": 3, "ordered": True, "factor": 0.3, "keep": 30, "points": 30},
}
LEGS = max(rule["size"] for rule in BET_TYPES.values())
# Month factors from winter to autumn.
SEASON_FACTORS = [1.00, 1.10, 0.90, 1.05]
# Share of the race limit by level.
BUDGET_SHARES = {"skip": 0.0, "normal": 0.4, "decisive": 0.8}
JOCKEY_BONUS = 1.15


def expected_value(odds: Column, *probabilities: Column) -> Column:
    """p * odds with the first probability that is neither null nor 0; 0 without odds."""
    p = F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in probabilities], F.lit(0.0))
    return F.when(odds.isNotNull(), p * odds).otherwise(F.lit(0.0))


def difficulty(df: DataFrame, race: str, probability: str, variant: str = "concentration") -> DataFrame:
    """(race, difficulty): higher is easier to predict.

    "concentration" joins spread and how far the best stands out; "spread" is five
    times the deviation, at most 1. A race without any probability has difficulty 0.
    """
    s = df.groupBy(race).agg(
        F.stddev_pop(probability).alias("d"), F.max(probability).alias("m"), F.avg(probability).alias("a")
    )
    if variant == "spread":
        value = F.least(F.col("d") * 5, F.lit(1.0))
    else:
        value = F.least(F.lit(1.0), (F.col("d") * 10 + F.col("m") / (F.col("a") + 1e-6) / 5) / 2)
    # least() skips nulls, so a race without probabilities would get the bound
    return s.select(race, F.when(F.col("m").isNotNull(), value).otherwise(F.lit(0.0)).alias("difficulty"))


def longshot(df: DataFrame, race: str, odds: str, ev: str, ties: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per race the first of ranks 4 to 9 by odds with expected value 2.5 and odds 8 at least."""
    price = F.coalesce(F.col(odds), F.lit(999.0))
    nine = top_per_group(df.withColumn("_o", price), [race], [F.col("_o"), *[F.col(t) for t in ties]], 9, "popularity_rank")
    good = nine.filter((F.col("popularity_rank") >= 4) & (F.col(ev) >= 2.5) & (F.col(odds) >= 8))
    best = good.groupBy(race).agg(F.min(F.struct("popularity_rank", odds, ev, *fields)).alias("_b"))
    return best.select(race, "_b.*")


def season_bonus(day: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in SEASON_FACTORS]), season_code(day))


def jockey_bonus(
    df: DataFrame, listed: DataFrame, race: str, jockey: str, ev: str, ties: Sequence[str], top_n: int = 3
) -> DataFrame:
    """(race, listed_jockeys, bonus): 1.15 if a listed jockey rides one of the best by expected value."""
    top = top_per_group(df, [race], [F.desc(ev), *[F.col(t) for t in ties]], top_n, "_rn")
    hits = top.join(listed.select(jockey).distinct().withColumn("_l", F.lit(1)), jockey, "left")
    n = F.count("_l")
    return hits.groupBy(race).agg(
        n.alias("listed_jockeys"), F.when(n > 0, F.lit(JOCKEY_BONUS)).otherwise(F.lit(1.0)).alias("bonus")
    )


def pro_action(difficulty_: Column, max_ev: Column) -> tuple[Column, Column]:
    """Recommended action (play, pass or normal) and confidence level."""
    action = (
        F.when((difficulty_ >= 0.7) & (max_ev >= 3.0), "勝負")
        .when(max_ev < 1.2, "見送り")
        .when((difficulty_ < 0.15) & (max_ev < 1.5), "見送り")
        .otherwise("通常")
    )
    confidence = F.when(difficulty_ >= 0.6, "high").when(difficulty_ >= 0.4, "medium").otherwise("low")
    return action, confidence


def _ways(kind: str, top_n: int) -> Column:
    """All combinations of a bet type over top_n ranks: an array of (last, l0, l1, l2), a constant."""
    rule = BET_TYPES[kind]
    found = []
    for legs in (permutations if rule["ordered"] else combinations)(range(top_n), rule["size"]):
        found.append(F.struct(F.lit(max(legs)).alias("last"), *[F.lit(i).alias(f"l{n}") for n, i in enumerate(legs)]))
    return F.array(*found)


def _mean_ev(legs: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, [x["ev"] for x in legs]) / len(legs)


def _bets_of(kind: str, runners: Column, top_n: int) -> Column:
    """The candidates of a bet type in order of position: an array by falling expected value, then by rising ranks."""
    rule = BET_TYPES[kind]
    ranks = [f"l{n}" for n in range(rule["size"])]

    def bet(way: Column) -> Column:
        legs = [F.get(runners, way[n]) for n in ranks]
        mean = _mean_ev(legs)
        return F.struct(
            F.round(mean, 9).alias("_k"),
            *[(-way[n]).alias(f"_{n}") for n in ranks],
            F.concat_ws("→" if rule["ordered"] else "-", *[x["no"] for x in legs]).alias("combination"),
            mean.alias("expected_value"),
            reduce(lambda x, y: x * y, [x["p"] for x in legs], F.lit(rule["factor"])).alias("probability"),
        )

    # those that need a rank the race does not have go at once
    there = F.filter(_ways(kind, top_n), lambda w: w["last"] < F.size(runners))
    placed = F.sort_array(F.transform(there, bet), asc=False)
    return F.slice(placed, 1, rule["keep"]) if rule["keep"] else placed


def bet_candidates(
    df: DataFrame, race: str, number: str, ev: str, probability: str, ties: Sequence[str], top_n: int = 5, gathered: bool = False
) -> DataFrame:
    """(race, bet_type, combination, expected_value, probability, position) from the best top_n by expected value.

    Expected values are averaged, probabilities multiplied; position orders the
    candidates of a type, and types with a limit keep that many. The runners of a race
    are gathered once, after the cut to top_n; all types read them by rank. The candidates of a
    race are put in order inside its row, so they are neither shuffled nor sorted as rows. With
    gathered they stay there: (race, bets), an array of the other columns by type and position.
    """
    order = [F.desc(ev), *[F.col(t) for t in ties]]
    top = top_per_group(df, [race], order, top_n, "_rn")
    runner = F.struct(
        "_rn", F.col(number).cast("string").alias("no"), F.col(ev).alias("ev"), F.col(probability).alias("p")
    )
    arrays = top.groupBy(race).agg(F.array_sort(F.collect_list(runner)).alias("_a"))
    fields = ("combination", "expected_value", "probability")
    made = arrays.select(race, *[_bets_of(kind, F.col("_a"), top_n).alias(f"_{n}") for n, kind in enumerate(BET_TYPES)])
    if gathered:

        def placed(kind: str) -> Callable[[Column, Column], Column]:
            return lambda b, i: F.struct(F.lit(kind).alias("bet_type"), *[b[f].alias(f) for f in fields], (i + 1).alias("position"))

        each = [F.transform(F.col(f"_{n}"), placed(kind)) for n, kind in enumerate(BET_TYPES)]
        return made.select(race, F.concat(*each).alias("bets"))
    # the fields of a type are arrays of one order
    typed = [
        F.struct(F.lit(kind).alias("bet_type"), *[F.col(f"_{n}")[f].alias(f) for f in fields]) for n, kind in enumerate(BET_TYPES)
    ]
    rows = made.select(race, F.explode(F.array(*typed)).alias("_t")).select(
        race, "_t.bet_type", F.posexplode(F.arrays_zip(*[F.col(f"_t.{f}").alias(f) for f in fields])).alias("_at", "_b")
    )
    return rows.select(race, "bet_type", *[f"_b.{f}" for f in fields], (F.col("_at") + 1).alias("position"))


def best_bet_type(candidates: DataFrame, race: str) -> DataFrame:
    """Per race the bet type with the highest expected value; the order of the types settles ties."""
    order = F.lit(0)
    for i, kind in enumerate(BET_TYPES):
        order = F.when(F.col("bet_type") == kind, F.lit(i)).otherwise(order)
    per_type = candidates.groupBy(race, "bet_type").agg(
        F.max("expected_value").alias("max_ev"),
        F.avg("expected_value").alias("avg_ev"),
        F.count(F.lit(1)).alias("candidates"),
        F.max("probability").alias("max_probability"),
    )
    best = per_type.filter(F.col("max_ev") > 0).groupBy(race).agg(
        F.min(
            F.struct((-F.round("max_ev", 9)).alias("k"), order.alias("o"), "bet_type", "max_ev", "avg_ev", "candidates", "max_probability")
        ).alias("_b")
    )
    return best.select(
        race,
        F.col("_b.bet_type").alias("best_bet_type"),
        F.round("_b.avg_ev", 2).alias("avg_ev"),
        F.round("_b.max_ev", 2).alias("max_ev"),
        F.col("_b.candidates").alias("candidates"),
        F.round("_b.max_probability", 4).alias("max_probability"),
    )


def race_level(action: Column | None, max_ev: Column, max_probability: Column, difficulty_: Column, min_ev: float = 1.2) -> Column:
    decisive = (difficulty_ >= 0.7) | ((max_ev >= 4.0) & (max_probability >= 0.25)) | (max_ev >= 6.0)
    out = F.when(max_ev < min_ev, "skip").when(decisive, "decisive").otherwise("normal")
    return out if action is None else F.when(action == "見送り", "skip").otherwise(out)


def unit_price(level: Column, race_limit: Column, dynamic: bool = True) -> Column:
    if not dynamic:
        return F.lit(100)
    big = F.when(race_limit >= 5000, 1000).when(race_limit >= 3000, 500).otherwise(200)
    return (
        F.when(level == "skip", 100)
        .when(level == "decisive", big)
        .otherwise(F.when(race_limit >= 3000, 200).otherwise(100))
    )


def stake_sizing(level: Column, bet_type: Column, race_limit: Column, dynamic: bool = True) -> dict[str, Column]:
    """Unit price, budget, number of points and cost of a race."""
    price = unit_price(level, race_limit, dynamic)
    share = F.lit(0.4)
    for name, s in BUDGET_SHARES.items():
        share = F.when(level == name, F.lit(s)).otherwise(share)
    points = F.lit(10)
    for kind, rule in BET_TYPES.items():
        points = F.when(bet_type == kind, F.lit(rule["points"])).otherwise(points)
    budget = F.floor(race_limit * share)
    count = F.when(budget <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(points, F.floor(budget / price))))
    return {"unit_price": price, "budget": budget, "purchase_count": count, "total_cost": count * price}


def kelly(p: Column, odds: Column, bankroll: float, fraction: float = 0.25, most: float = 0.05) -> Column:
    """Stake by fractional Kelly, at most ``most`` of the bankroll, 0 without an edge."""
    edge = (p * odds - 1) / (odds - 1)
    stake = F.floor(F.lit(bankroll) * F.least(edge * fraction, F.lit(most)))
    return F.when((p > 0) & (odds > 1) & (edge > 0), stake).otherwise(F.lit(0)).cast("bigint")


def bet_list(
    candidates: DataFrame,
    runners: DataFrame,
    race: str,
    number: str,
    name: str,
    min_ev: float,
    min_probability: float,
    per_race: int,
    price: int = 100,
) -> DataFrame:
    """Candidates worth buying, the first per_race of each race in type order, with runner names.

    candidates are those of bet_candidates, gathered by race; a race is cut to its bets inside its row, and
    meets the names of its runners once. A runner without a name is #number.
    """
    good = F.filter("bets", lambda b: (b["expected_value"] >= min_ev) & (b["probability"] >= min_probability))
    kept = candidates.select(race, F.slice(good, 1, per_race).alias("_bets"))
    names = runners.groupBy(race).agg(
        F.collect_list(F.struct(F.col(number).cast("string").alias("no"), F.col(name).alias("name"))).alias("_names")
    )
    # the outer form: the plain one puts a filter below the join that works all bets out a second time
    rows = kept.join(names, race, "left").select(race, "_names", F.posexplode_outer("_bets").alias("_at", "_b"))

    def named(no: Column) -> Column:
        of = F.transform(F.filter("_names", lambda x: x["no"] == no), lambda x: x["name"])
        return F.coalesce(F.array_min(of), F.concat(F.lit("#"), no))

    return rows.filter(F.col("_at").isNotNull()).select(
        race, *[f"_b.{c}" for c in ("bet_type", "combination", "expected_value", "probability", "position")],
        (F.col("_at") + 1).alias("bet_no"),
        F.transform(F.split("_b.combination", "[-→]"), named).alias("horse_names"),
        F.lit(price).alias("unit_price"), F.lit(price).alias("total_cost"),
    )


def bet_totals(bets: DataFrame, race: str) -> DataFrame:
    return bets.agg(
        F.count(F.lit(1)).alias("bets"),
        F.count_distinct(race).alias("races"),
        F.coalesce(F.sum("total_cost"), F.lit(0)).alias("total_cost"),
    )
