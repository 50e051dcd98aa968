"""The feature build: ordered stages, each a function of the frame so far and the base.

The base has the rows of the frame and the columns that exist before any stage; totals
and hot keys are counted on it, so the plan grows by one step per operator. A base that
joins several tables should be written once (``stored``). A stage adds what the columns at
hand allow: dam, closing, payout and style are optional. Without history only what a race
itself tells is added. Stages are the extension point: ``feature_build(df, stages=[*STAGES, mine])``.

The stages of this module read the base alone. The build writes the base once with row numbers, works each of
them on the columns that it reads, and lets the results meet by row number, so that whole rows are shuffled once
and not for every operator. Other stages get the frame so far.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.functions import arrays as A
from furlong.functions import racing as R
from furlong.operators import history as H
from furlong.operators import within_group as G
from furlong.operators.joins import course_lookup, history_plus_target
from furlong.operators.skew import HOT_ROWS, join_group_stats
from furlong.operators.stats import gate_bias
from furlong.session import shared_dir

Stage = Callable[[DataFrame, DataFrame], DataFrame]

TIE = ("runner_no",)

ROW = "_row"


def reads_base(stage: Stage) -> Stage:
    """Marks a stage that reads no column of an earlier one."""
    stage.reads_base = True
    return stage


#: Up to this many courses are sent to all tasks, so that the runners are not shuffled to meet them.
MAX_COURSES = 10_000

#: Columns whose gaps are told by a flag, where the frame has them.
FLAGGED = ("odds", "popularity", "weight", "age")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: what is before the build runs and is planned once."""
    path = shared_dir(df.sparkSession, "features")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def even(base: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> bool:
    """Whether every row has the key and no key is hot."""
    counts = base.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col(key).isNull() | (F.col("_n") > hot_rows)).isEmpty()


def _has(df: DataFrame, *columns: str) -> bool:
    return set(columns) <= set(df.columns)


def with_scalars(df: DataFrame) -> DataFrame:
    """What a row tells by itself."""
    return with_inputs(with_season(df))


def with_season(df: DataFrame) -> DataFrame:
    return df.withColumns(R.season_cycle(F.col("race_date")))


def with_inputs(df: DataFrame) -> DataFrame:
    """The scalars that statistics of entities and races read, and the flags of gaps."""
    return df.withColumns(
        {
            "distance_band": R.distance_band(F.col("distance")),
            "implied_prob": R.implied_prob(F.col("odds")),
            **{f"{c}_is_missing": R.missing_flag(F.col(c)) for c in FLAGGED if _has(df, c)},
        }
    )


def categories(values: Mapping[str, Sequence[str]]) -> Stage:
    """A stage with one 0/1 column per declared value."""

    def stage(df: DataFrame, base: DataFrame) -> DataFrame:
        return df.select("*", *[flag for c, known in values.items() for flag in R.one_hot(F.col(c), known, c)])

    return stage


def laps(column: str, distances: Sequence[int] = A.LAP_DISTANCES, timed: Sequence[int] | None = None) -> Stage:
    """A stage from cumulative lap times (a map by distance): laps, section times, and the pace of the halves.

    timed are the distances that have a section column, all by default.
    """
    timed = distances if timed is None else timed

    def stage(df: DataFrame, base: DataFrame) -> DataFrame:
        out = A.with_sectionals(df, column, "_sections").withColumn("_sections", F.map_from_entries("_sections"))
        out = out.select("*", *A.lap_columns(F.col(column), "lap", distances), *A.lap_columns(F.col("_sections"), "lap_sect", timed))
        return A.with_pace(out, {d: f"lap_sect_{d}m" for d in timed}, "distance").drop("_sections", column)

    return stage


def course(table: DataFrame, values: Mapping[str, object], bias: str | None = None, inner: int = 3) -> Stage:
    """A stage with the attributes of the course: exact distance, default, nearest distance, or constant.

    With the name of a bias among the values it adds ``inner_advantage``: the bias, for the inner gates only.
    """

    def stage(df: DataFrame, base: DataFrame) -> DataFrame:
        few = base.select("venue", "surface", "distance").distinct().count() <= MAX_COURSES
        out = course_lookup(df, table, ["venue", "surface"], "distance", values, source=base, few=few)
        if bias:
            near = F.coalesce(F.col("runner_no") <= inner, F.lit(False))
            out = out.withColumn("inner_advantage", F.col(bias) * near.cast("int"))
        return out

    return stage


@reads_base
def field(df: DataFrame, base: DataFrame) -> DataFrame:
    """Number of runners, and the place in the row of gates as a share of it."""
    df = join_group_stats(df, ["race_id"], {"field_size": F.count(F.lit(1))}, base)
    return df.withColumn("gate_ratio", R.ratio(F.col("runner_no"), F.col("field_size")))


@reads_base
def market(df: DataFrame, base: DataFrame) -> DataFrame:
    how = {"source": base, "hot_rows": None if even(base, "race_id") else HOT_ROWS}
    df = G.normalise(df, ["race_id"], "implied_prob", "implied_prob_norm", **how)
    df = G.odds_rank(df, ["race_id"], "odds", "odds_rank_in_race", **how)
    df = G.zscore(df, ["race_id"], "odds", "odds_z_in_race", **how)
    return df.join(G.market_entropy(base.filter(F.col("race_id").isNotNull()).select("race_id", "odds")), "race_id", "left")


@reads_base
def rest(df: DataFrame, base: DataFrame) -> DataFrame:
    df = H.days_since_last(df, source=base)
    return df.withColumn("rest_code", R.rest_code(F.col("days_since_last")))


@reads_base
def aptitude(df: DataFrame, base: DataFrame) -> DataFrame:
    """Prior win rates of the horse by surface, venue and both, by distance and its band, and by band and surface."""
    df = H.expanding_rate(df, ["horse_id", "surface"], "horse_surface", source=base)
    df = H.expanding_rate(df, ["horse_id", "venue"], "horse_venue", source=base)
    df = H.expanding_rate(df, ["horse_id", "venue", "surface"], "horse_venue_surface", source=base)
    df = H.expanding_rate(df, ["horse_id", "distance_band"], "horse_band", source=base)
    df = H.expanding_rate(df, ["horse_id", "distance_band", "surface"], "horse_band_surface", source=base)
    return H.expanding_multi(df, ["horse_id", "distance"], "horse_distance", source=base)


@reads_base
def people(df: DataFrame, base: DataFrame) -> DataFrame:
    """Careers of jockey, trainer, sire and dam's side, the pair of jockey and trainer, and their last 180 days."""
    entities = {"jockey_id": "jockey", "trainer_id": "trainer", "sire": "sire", "dam": "damsire"}
    for entity, prefix in ((e, p) for e, p in entities.items() if _has(base, e)):
        df = H.entity_career(df, entity, prefix, source=base)
        df = df.withColumn(
            f"{prefix}_win_rate_smooth", H.smooth_rate(F.col(f"{prefix}_win_rate"), F.col(f"{prefix}_race_count"))
        )
    df = H.expanding_rate(df, ["jockey_id", "venue"], "jockey_course", source=base)
    df = H.pair_smoothed(df, ["jockey_id", "trainer_id"], "combo", source=base)
    df = H.range_rates(df, "jockey_id", "jockey_180d", source=base)
    return H.range_rates(df, "trainer_id", "trainer_180d", source=base)


@reads_base
def gates(df: DataFrame, base: DataFrame, inner: int = 4) -> DataFrame:
    """Earlier win rate of the inner or outer gates on the course."""
    near = lambda d: d.withColumn("inner_gate", (F.col("runner_no") <= inner).cast("int"))
    keys = ["venue", "distance_band", "surface", "inner_gate"]
    return gate_bias(near(df), keys, as_of=True, source=near(base))


def start_stats(base: DataFrame) -> tuple[dict, list[str]]:
    """Statistics of a horse's last starts and the columns they read: what the base allows."""
    stats = H.form_stats() | H.previous_stats(["distance", "surface"])
    inputs = ["finish", "distance", "surface"]
    if _has(base, "closing", "closing_rank"):
        stats |= H.closing_stats("closing", "closing_rank")
        inputs += ["closing", "closing_rank"]
    if _has(base, "payout"):
        stats |= H.payout_stats("payout", "log_payout_avg_5")
        inputs.append("payout")
    if _has(base, "style"):
        stats |= H.style_stats("style")
        inputs.append("style")
    return stats, inputs


@reads_base
def form(df: DataFrame, base: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    """Last starts of the horse (one shuffle for all of them), of the jockey and of the trainer."""
    stats, inputs = start_stats(base)
    df = H.rolling(df, ["horse_id"], stats, 10, inputs, tie, source=base)
    df = H.recent_rate(df, "jockey_id", "jockey_recent30", tie, source=base)
    df = H.recent_rate(df, "trainer_id", "trainer_recent30", tie, source=base)
    return with_changes(df)


def with_changes(df: DataFrame) -> DataFrame:
    """What differs from the previous start, and the jockey's course against the last rides: what the frame allows."""
    changes = {
        "distance_change": F.col("distance") - F.col("prev_distance"),
        "surface_changed": F.coalesce((F.col("surface") != F.col("prev_surface")).cast("int"), F.lit(0)),
        "jockey_course_advantage": F.col("jockey_course_win_rate") - F.col("jockey_recent30"),
    }
    needs = {"distance_change": ["prev_distance"], "surface_changed": ["prev_surface"], "jockey_course_advantage": ["jockey_course_win_rate", "jockey_recent30"]}
    return df.withColumns({n: c for n, c in changes.items() if n not in df.columns and _has(df, *needs[n])})


RACE_STAGES: list[Stage] = [market, field]
HISTORY_STAGES: list[Stage] = [rest, aptitude, people, gates, form]
STAGES: list[Stage] = RACE_STAGES + HISTORY_STAGES


def feature_build(df: DataFrame, stages: Sequence[Stage] = STAGES) -> DataFrame:
    apart = [getattr(getattr(s, "func", s), "reads_base", False) for s in stages]  # a partial has its function in func
    if not any(apart):
        base = out = with_scalars(df)
    else:
        base = out = with_scalars(stored(df.withColumn(ROW, F.monotonically_increasing_id())))
    for stage, alone in zip(stages, apart):
        if alone:
            made = stage(base, base)
            out = out.join(made.select(ROW, *[c for c in made.columns if c not in out.columns]), ROW)
            out = with_changes(out)
        else:
            out = stage(out, base)
    return out.drop(ROW)


def feature_build_for(target: DataFrame, history: DataFrame, stages: Sequence[Stage] = STAGES) -> DataFrame:
    """Features of the target races with the history behind them; only the target rows come back."""
    both = history_plus_target(history, target.withColumn("_target", F.lit(True)))
    return feature_build(both, stages).filter(F.col("_target")).drop("_target")
