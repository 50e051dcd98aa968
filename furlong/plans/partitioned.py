"""The whole feature build with one shuffle for each entity.

Rows are dealt by race first, for what the runners of a race tell about each other, and written once, with
a number for each row. From this base they are dealt by horse once, and all that windows of a horse tell
(win rates by surface, venue, distance and their pairs, last starts, days of rest) is worked out there: a
window over (horse, venue) needs nothing more than rows that are together by horse. The same by jockey,
trainer, sire and dam. Each branch carries only the columns that it reads and sends totals, so sorts and
shuffles stay narrow; the results meet by row number, which no key can skew. Rates, and what a row tells
by itself, are worked out where they have met.

A window sends a group to one task, so one pass over the base counts the rows of every key of every
entity together. Entities whose keys are all known and of usual size, which is the rule, take the short
way. Rows of a hot key, or without the key, are split off and go through the operators that cut hot
groups into slices. The list of hot keys is bounded as in ``operators.skew``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions import racing as R
from furlong.operators import history as H
from furlong.operators.skew import HOT_ROWS, MAX_HOT
from furlong.operators.within_group import EPS, LOG_EPS
from furlong.plans import features as P

ROW = P.ROW
TIE_NO = "_tie"

#: What the runners of a race tell about each other, in the order of the build.
RACE_COLUMNS = (
    "implied_prob_norm", "odds_rank_in_race", "odds_z_in_race", "field_size", "market_entropy", "top3_probability", "gate_ratio",
)

#: Rows of one entity, the base of the whole build, and the options of the operators to the rows with more columns.
Entity = Callable[[DataFrame, DataFrame, dict], DataFrame]


#: Win rates of a horse: the columns besides the horse, and the prefix.
HORSE_RATES = (
    (["surface"], "horse_surface"),
    (["venue"], "horse_venue"),
    (["venue", "surface"], "horse_venue_surface"),
    (["distance_band"], "horse_band"),
    (["distance_band", "surface"], "horse_band_surface"),
)


def _rate_sums(prefix: str) -> dict[str, Column]:
    return {f"_{prefix}_w": H.win(), f"_{prefix}_n": H.runs()}


def _rate(prefix: str) -> dict[str, Column]:
    return H.rate_columns(prefix, f"_{prefix}_w", f"_{prefix}_n")


def _career_sums(prefix: str) -> dict[str, Column]:
    return H.career_sums(mark=f"_{prefix}_")


def horse(tie: Sequence[str]) -> Entity:
    def build(df: DataFrame, base: DataFrame, how: dict) -> DataFrame:
        df = H.days_since_last(df, **how)
        for more, prefix in HORSE_RATES:
            df = H.expanding(df, ["horse_id", *more], _rate_sums(prefix), **how)
        df = H.expanding(df, ["horse_id", "distance"], H.multi_sums(mark="_horse_distance_"), **how)
        stats, inputs = P.start_stats(base)
        return H.rolling(df, ["horse_id"], stats, 10, inputs, tie, **how)

    return build


def jockey(tie: Sequence[str]) -> Entity:
    def build(df: DataFrame, base: DataFrame, how: dict) -> DataFrame:
        df = H.expanding(df, ["jockey_id"], _career_sums("jockey"), **how)
        df = H.expanding(df, ["jockey_id", "venue"], _rate_sums("jockey_course"), **how)
        df = H.expanding(df, ["jockey_id", "trainer_id"], _rate_sums("combo"), **how)
        df = H.day_range(df, ["jockey_id"], H.range_sums(mark="_jockey_180d_"), 180, **how)
        return H.recent_rate(df, "jockey_id", "jockey_recent30", tie, **how)

    return build


def trainer(tie: Sequence[str]) -> Entity:
    def build(df: DataFrame, base: DataFrame, how: dict) -> DataFrame:
        df = H.expanding(df, ["trainer_id"], _career_sums("trainer"), **how)
        df = H.day_range(df, ["trainer_id"], H.range_sums(mark="_trainer_180d_"), 180, **how)
        return H.recent_rate(df, "trainer_id", "trainer_recent30", tie, **how)

    return build


def parent(key: str, prefix: str) -> Entity:
    def build(df: DataFrame, base: DataFrame, how: dict) -> DataFrame:
        return H.expanding(df, [key], _career_sums(prefix), **how)

    return build


def _career(prefix: str) -> dict[str, Column]:
    columns = H.career_columns(prefix, f"_{prefix}_")
    smooth = H.smooth_rate(columns[f"{prefix}_win_rate"], columns[f"{prefix}_race_count"])
    return columns | {f"{prefix}_win_rate_smooth": smooth}


def told(base: DataFrame) -> dict[str, Column]:
    """The features of entities from what their branches send, in the order of the build.

    Branches send totals and leave rates to the rows where they have met: totals are small whole
    numbers, which are shuffled in a few bytes, and one total serves several rates.
    """
    out = {"days_since_last": F.col("days_since_last"), "rest_code": R.rest_code(F.col("days_since_last"))}
    for _, prefix in HORSE_RATES:
        out |= _rate(prefix)
    out |= H.multi_columns("horse_distance", mark="_horse_distance_")
    out |= {n: F.col(n) for n in P.start_stats(base)[0]}
    out |= _career("jockey") | _rate("jockey_course")
    pair = _rate("combo")
    out |= pair | {"combo_win_rate_smooth": H.smooth_rate(pair["combo_win_rate"], pair["combo_count"])}
    out |= H.range_columns("jockey_180d", "_jockey_180d_") | {"jockey_recent30": F.col("jockey_recent30")}
    out |= _career("trainer") | H.range_columns("trainer_180d", "_trainer_180d_")
    out |= {"trainer_recent30": F.col("trainer_recent30")}
    for key, prefix in (("sire", "sire"), ("dam", "damsire")):
        if key in base.columns:
            out |= _career(prefix)
    return out | {"gate_win_rate": F.col("gate_win_rate")}


def race(df: DataFrame, base: DataFrame, how: dict) -> DataFrame:
    """Odds, market and field against the other runners of the race."""
    if how.get("hot_rows", HOT_ROWS) is not None:
        return P.field(P.market(df, how["source"]), how["source"])
    together = Window.partitionBy("race_id")
    priced = F.when(F.col("odds") > 0, 1 / F.col("odds"))
    prob, total = F.col("implied_prob"), F.sum("implied_prob").over(together)
    spread = F.stddev_samp("odds").over(together) + F.lit(EPS)
    df = df.withColumns(
        {
            "implied_prob_norm": F.when(total > 0, prob / total).otherwise(prob),
            "odds_rank_in_race": F.rank().over(together.orderBy(F.asc_nulls_last("odds"))).cast("bigint"),
            "odds_z_in_race": (F.col("odds") - F.avg("odds").over(together)) / spread,
            "_k": F.count(priced).over(together),
            "_p": priced / F.sum(priced).over(together),
            "field_size": F.count(F.lit(1)).over(together),
        }
    )
    df = df.withColumn("_best", F.row_number().over(together.orderBy(F.desc_nulls_last("_p"))))
    entropy = F.sum(-F.col("_p") * F.ln(F.col("_p") + F.lit(LOG_EPS))).over(together)
    first = F.sum(F.when(F.col("_best") <= 3, F.col("_p"))).over(together)
    return df.withColumns(
        {
            "market_entropy": F.when(F.col("_k") >= 2, entropy).otherwise(F.lit(0.0)),
            "top3_probability": F.when(F.col("_k") >= 2, first).otherwise(F.lit(0.5)),
            "gate_ratio": R.ratio(F.col("runner_no"), F.col("field_size")),
        }
    ).drop("_k", "_p", "_best")


def entities(base: DataFrame, tie: Sequence[str] = P.TIE) -> dict[str, Entity]:
    """What is worked out by each key; sire and dam where the base has them."""
    own = {"race_id": race, "horse_id": horse(tie), "jockey_id": jockey(tie), "trainer_id": trainer(tie)}
    parents = {"sire": parent("sire", "sire"), "dam": parent("dam", "damsire")}
    return own | {k: v for k, v in parents.items() if k in base.columns}


def uneven(base: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> dict[str, list]:
    """The hot values of each key that has any, None for rows without it; one pass for all keys.

    At most MAX_HOT values, the most frequent first; what is left out is below a MAX_HOT-th of all rows.
    """
    counts = base.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id(*keys).alias("_set"), F.count(F.lit(1)).alias("_n")
    )
    missing = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNull()
    found = counts.filter((F.col("_n") > hot_rows) | missing).orderBy(F.desc(missing), F.desc("_n"), *keys).limit(MAX_HOT)
    full, out = (1 << len(keys)) - 1, {}
    for row in found.collect():
        key = keys[len(keys) - (full ^ row["_set"]).bit_length()]
        out.setdefault(key, []).append(row[key])
    return out


def of_entity(base: DataFrame, key: str, build: Entity, hot: Sequence) -> DataFrame:
    if not hot:
        return build(base.repartition(key), base, {"hot_rows": None})
    values = [v for v in hot if v is not None]
    known = base.filter(F.col(key).isNotNull())
    kind = base.schema[key].dataType.simpleString()
    listed = F.broadcast(base.sparkSession.createDataFrame([(v,) for v in values], f"`{key}` {kind}"))
    usual = build(known.join(listed, key, "left_anti").repartition(key), base, {"hot_rows": None})
    rest = known.join(listed, key, "left_semi").unionByName(base.filter(F.col(key).isNull()))
    return usual.unionByName(build(rest, base, {"source": rest}))


def raced(df: DataFrame, tie: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, Sequence[str]]:
    """What the runners of a race tell about each other, and columns that order them inside a race.

    Where no race is hot or missing the rows are dealt by race before they are written (a frame that was
    joined by race last is not shuffled again) and numbered in their race by ``tie``: one number goes to
    the branches in place of all columns of ``tie``.
    """
    hot = uneven(df, ["race_id"], hot_rows).get("race_id", ())
    if hot:
        rows = P.stored(df)  # read more than once
        return of_entity(rows, "race_id", race, hot), tie
    numbered = F.row_number().over(Window.partitionBy("race_id").orderBy(*tie))
    return of_entity(df, "race_id", race, ()).withColumn(TIE_NO, numbered), [TIE_NO]


def carried(base: DataFrame, first: Sequence[str]) -> DataFrame:
    """base without the columns that finished() works out again from the others."""
    again = ("implied_prob", "distance_band", "gate_ratio", *[f"{c}_is_missing" for c in P.FLAGGED])
    return base.drop(*[c for c in again if c in first or c in RACE_COLUMNS])


def finished(out: DataFrame, base: DataFrame, stages: Sequence[P.Stage], first: Sequence[str]) -> DataFrame:
    """Rates, stages and seasons of rows on which all branches have met.

    What a row tells by itself is worked out here, so that it is not shuffled; ``first`` has the columns that come first.
    """
    made = told(base)
    out = P.with_inputs(out)
    if "field_size" in out.columns:
        out = out.withColumn("gate_ratio", R.ratio(F.col("runner_no"), F.col("field_size")))
    sent = set(out.columns)
    out = P.with_season(out)
    for stage in stages:
        out = stage(out, base)
    of_stages = [c for c in out.columns if c not in sent and c not in first]
    of_race = [c for c in RACE_COLUMNS if c in out.columns]
    front = [c for c in first if c in out.columns]
    out = out.select(*front, *of_stages, *of_race, *[c.alias(n) for n, c in made.items()])
    return P.with_changes(out)


def partitioned_build(
    df: DataFrame,
    tie: Sequence[str] = P.TIE,
    stages: Sequence[P.Stage] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All features of features.feature_build, with the same names and values, one row for each row of df.

    stages are for what a row tells by itself or by a small table (categories, laps, course).
    """
    first = P.with_scalars(df).columns
    rows, tie = raced(P.with_inputs(df), tie, hot_rows)
    base = P.stored(rows.withColumn(ROW, F.monotonically_increasing_id()))
    of = {key: build for key, build in entities(base, tie).items() if key != "race_id"}
    hot = uneven(base, list(of), hot_rows)
    out = carried(base, first)
    branches = [of_entity(base, key, build, hot.get(key, ())) for key, build in of.items()]
    for branch in [*branches, P.gates(base, base)]:
        out = out.join(branch.select(ROW, *[c for c in branch.columns if c not in (*base.columns, "inner_gate")]), ROW)
    return finished(out, base, stages, first)
