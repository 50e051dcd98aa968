"""From earlier races and entries to calibrated chances and expected values, as one plan.

Only what the target races need is worked out: each branch of the feature build takes the history of the
horses, jockeys, trainers and parents that run in them (a semi join on the entity, which Spark broadcasts
where the entries are few), not the whole past.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators import model as M
from furlong.operators.prep import FUTURE_FIELDS
from furlong.operators.skew import HOT_ROWS
from furlong.plans import features as P
from furlong.plans.partitioned import ROW, carried, entities, finished, of_entity, uneven

TARGET = "_target"

#: Columns that are known only after a race: emptied in the target rows, whatever they hold.
OUTCOME = (*FUTURE_FIELDS, "closing", "closing_rank", "payout")


def before_the_race(target: DataFrame, outcome: Sequence[str] = OUTCOME) -> DataFrame:
    """The target rows without what is known only afterwards."""
    kinds = dict(target.dtypes)
    return target.withColumns({c: F.lit(None).cast(kinds[c]) for c in outcome if c in kinds})


def target_features(
    target: DataFrame,
    history: DataFrame,
    tie: Sequence[str] = P.TIE,
    stages: Sequence[P.Stage] = (),
    hot_rows: int = HOT_ROWS,
    outcome: Sequence[str] = OUTCOME,
) -> DataFrame:
    """The features of partitioned.partitioned_build for the target rows, with the history behind them.

    Races of the target are left out of the history. A target row without a key (no jockey yet) is kept;
    its features of that key have their defaults. Columns that only one side has are null in the other.
    """
    entries = before_the_race(target, outcome).withColumn(TARGET, F.lit(True))
    both = history.unionByName(entries, allowMissingColumns=True)
    first = P.with_scalars(both).columns
    base = P.stored(P.with_inputs(both).withColumn(ROW, F.monotonically_increasing_id()))
    # races of the target in the history: looked for among the written rows, so neither side is read a second time
    kinds = base.groupBy("race_id").agg(F.max(TARGET).alias("_entered"), F.bool_or(F.col(TARGET).isNull()).alias("_run"))
    again = kinds.filter(F.col("_entered") & F.col("_run") & F.col("race_id").isNotNull()).select("race_id")
    if not again.isEmpty():
        base = P.stored(base.filter(F.col(TARGET).isNull()).join(again, "race_id", "left_anti").unionByName(base.filter(TARGET)))
    wanted = base.filter(TARGET)
    of = entities(base, tie)
    hot = uneven(base, list(of), hot_rows)
    out = carried(wanted, first)
    branches = []
    for key, build in of.items():
        near = base.join(wanted.select(key).distinct(), key, "left_semi")
        if None in hot.get(key, ()):
            near = near.unionByName(wanted.filter(F.col(key).isNull()))
        # a join that shuffles by the key has dealt the rows already: without a union they are not shuffled again
        branches.append(of_entity(near, key, build, hot.get(key, ())))
    for branch in [*branches, P.gates(base, base)]:
        made = [c for c in branch.columns if c not in (*base.columns, "inner_gate")]
        out = out.join(branch.filter(TARGET).select(ROW, *made), ROW)
    return finished(out, wanted, stages, [c for c in first if c != TARGET])


@dataclass
class Scorer:
    """A raw score of a row, what it stands for, and how to calibrate it.

    score adds the column ``raw`` to a frame of features; of_model() makes it from a fitted pipeline.
    """

    score: Callable[[DataFrame, str], DataFrame]
    target: str = "win"
    calibrator: Callable[[Column], Column] | None = None

    @classmethod
    def of_model(cls, model: PipelineModel, target: str = "win", calibrator: Callable[[Column], Column] | None = None) -> Scorer:
        classes = target not in ("speed_deviation", "rank")

        def score(df: DataFrame, out: str) -> DataFrame:
            scored = model.transform(df)
            value = M.vector_to_array("probability")[1] if classes else F.col("prediction")
            return scored.select(*df.columns, value.alias(out))

        return cls(score, target, calibrator)

    @classmethod
    def of_column(cls, column: Column, target: str = "win", calibrator: Callable[[Column], Column] | None = None) -> Scorer:
        return cls(lambda df, out: df.withColumn(out, column), target, calibrator)


def predict_races(
    features: DataFrame, main: Scorer, place: Scorer | None = None, race: str = "race_id", odds: str = "odds",
    hot_rows: int = HOT_ROWS, source: DataFrame | None = None,
) -> DataFrame:
    """Add p_raw, p_norm, predicted_rank, p_ensemble and expected_value to feature rows.

    The main score is calibrated and shared out so that a race sums to 1 (operators.model.score_races). The
    ensemble blends it with the shares of the place score where a race has all of them. expected_value is
    p_norm * odds, null where there are no odds above 0 or no chance.

    source has the same races as the features and a shorter plan. Races are counted on it, and where none is hot or
    missing the features are not written in between: the plan carries the columns that the result is asked for.
    """
    scored = main.score(features, "p_raw") if place is None else place.score(main.score(features, "p_raw"), "_place")
    hot = None if source is None else uneven(source, [race], hot_rows).get(race, ())
    base = P.stored(scored) if hot is None or hot else scored

    def build(df: DataFrame, whole: DataFrame, how: dict) -> DataFrame:
        hot_rows = how.get("hot_rows", HOT_ROWS)
        out = M.score_races(df, race, "p_raw", main.target, "p_norm", "predicted_rank", hot_rows, main.calibrator)
        if place is None:
            return out.withColumn("p_ensemble", F.col("p_norm"))
        out = M.score_races(out, race, "_place", place.target, "_share", "_place_rank", hot_rows, place.calibrator)
        out = M.ensemble(out, race, "p_norm", "_share", main.target, "p_ensemble", hot_rows)
        return out.drop("_place", "_share", "_place_rank")

    # rows are dealt by race once for all that is worked out in it; hot and missing races go another way
    out = of_entity(base, race, build, uneven(base, [race], hot_rows).get(race, ()) if hot is None else hot)
    price = F.when(F.col(odds) > 0, F.col(odds).cast("double"))
    return out.withColumn("expected_value", F.col("p_norm") * price)
