"""Laps, corners and pace: array and map columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The distances that get a lap column of their own.
LAP_DISTANCES = list(range(200, 2401, 200))


def lap_map(c: Column) -> Column:
    """JSON text {distance: seconds} as a map with integer keys; unreadable text gives null."""
    parsed = F.from_json(c, "map<string,double>")
    return F.transform_keys(
        F.map_filter(parsed, lambda k, v: k.rlike("^[0-9]+$") & v.isNotNull()), lambda k, v: k.cast("int")
    )


def lap_columns(laps: Column, prefix: str, distances: Sequence[int] = LAP_DISTANCES) -> list[Column]:
    return [F.try_element_at(laps, F.lit(d)).alias(f"{prefix}_{d}m") for d in distances]


def with_sectionals(df: DataFrame, cumulative: str, out: str, low: float = 5.0, high: float = 200.0) -> DataFrame:
    """Add section times, an array of (d, t) by distance, from a map of cumulative laps.

    Cumulative times outside low..high are dropped first. The sorted laps are a column
    of their own, so that they are built once per row.
    """
    kept = F.map_filter(cumulative, lambda k, v: v.between(low, high))
    entries = F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("d"), e["value"].alias("t")))
    ends = F.transform("_laps", lambda e: e["t"])
    starts = F.concat(F.array(F.lit(0.0)), F.slice(ends, 1, F.greatest(F.size("_laps") - 1, F.lit(0))))
    steps = F.zip_with(
        "_laps", starts, lambda e, s: F.struct(e["d"].alias("d"), F.round(e["t"] - s, 1).alias("t"))
    )
    return (
        df.withColumn("_laps", F.array_sort(entries))
        .withColumn(out, F.when(F.size("_laps") > 0, steps).when(F.col("_laps").isNotNull(), F.slice(steps, 1, 0)))
        .drop("_laps")
    )


def with_pace(df: DataFrame, sections: Mapping[int, str], distance: str) -> DataFrame:
    """Add mean section time of the first and second half up to the race distance.

    sections maps each timed distance to its column. Plain arithmetic in three steps, so
    that every term is written once and generated code stays small.
    """
    ordered = sorted(sections.items())
    n = sum((F.when(F.col(distance) >= d, 1).otherwise(0) for d, _ in ordered), F.lit(0))

    def used(i: int, d: int, c: str, front: bool) -> Column:
        side = F.lit(i) < F.col("_half") if front else F.lit(i) >= F.col("_half")
        return side & (F.col(distance) >= d) & (F.col(c) > 0)

    def total(front: bool) -> Column:
        return sum((F.when(used(i, d, c, front), F.col(c)).otherwise(0.0) for i, (d, c) in enumerate(ordered)), F.lit(0.0))

    def count(front: bool) -> Column:
        return sum((F.when(used(i, d, c, front), 1).otherwise(0) for i, (d, c) in enumerate(ordered)), F.lit(0))

    front = F.col("_ft") / F.col("_fn")
    back = F.col("_bt") / F.col("_bn")
    timed = (F.col("_n") >= 2) & (F.col("_fn") > 0) & (F.col("_bn") > 0)
    return (
        df.withColumn("_n", n)
        .withColumn("_half", F.floor(F.col("_n") / 2))
        .withColumns({"_ft": total(True), "_fn": count(True), "_bt": total(False), "_bn": count(False)})
        .withColumns(
            {
                "race_pace_front": F.when(timed, front),
                "race_pace_back": F.when(timed, back),
                "race_pace_diff": F.when(timed, front - back),
                "race_pace_ratio": F.when(timed & (F.col("_bt") > 0), front / back),
            }
        )
        .drop("_n", "_half", "_ft", "_fn", "_bt", "_bn")
    )


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def corner_stats(corners: Column) -> dict[str, Column]:
    n = F.size(corners)
    mean = F.when(n > 0, _total(corners) / n)
    squares = F.aggregate(corners, F.lit(0.0), lambda s, x: s + x * x)
    spread = F.greatest(squares / n - mean * mean, F.lit(0.0))
    last = F.try_element_at(corners, F.lit(-1))
    return {
        "corner_position_avg": mean,
        "corner_position_variance": F.when(n > 1, spread).otherwise(F.lit(0.0)),
        "last_corner_position": last,
        "position_change": F.when(n > 1, F.get(corners, 0) - last).otherwise(F.lit(0)),
    }


# Running styles from the front of the field to the back; the code is the position.
STYLES = ["逃げ", "先行", "差し", "追込"]


def running_style(corners: Column, field_size: Column) -> Column:
    """Code 0..3 of where in the field a runner travels; null without corner positions.

    Unknown field sizes count as 8, the smallest is 2.
    """
    size = F.when(F.coalesce(field_size, F.lit(0)) == 0, F.lit(8)).otherwise(field_size)
    size = F.greatest(size.cast("int"), F.lit(2))
    mean = _total(corners) / F.size(corners)
    return F.when(
        F.size(corners) > 0,
        F.when((F.get(corners, 0) <= 2) & (mean <= size / 3), F.lit(0))
        .when(mean <= size / 3, F.lit(1))
        .when(mean <= size * 2 / 3, F.lit(2))
        .otherwise(F.lit(3)),
    )


def style_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STYLES]), code)
