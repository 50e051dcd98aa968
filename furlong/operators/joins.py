"""Joins between races, runners, dimensions, predictions and outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entry_result(entries: DataFrame, results: DataFrame, keys: Sequence[str] = ("race_id", "horse_id")) -> DataFrame:
    return entries.join(results, list(keys))


def star(
    fact: DataFrame, required: Mapping[str, DataFrame], optional: Mapping[str, DataFrame]
) -> DataFrame:
    """Fact with dimensions: inner joins for required ones, left joins for the others.

    Whether a dimension is broadcast is left to its size at run time.
    """
    for key, dim in required.items():
        fact = fact.join(dim, key)
    for key, dim in optional.items():
        fact = fact.join(dim, key, "left")
    return fact


def parent_fill(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the parent's columns; where both have a column the child's value comes first."""
    renamed = parents.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in parents.columns if c not in keys])
    joined = children.join(renamed, list(keys), "left")
    out = [
        F.coalesce(F.col(c), F.col(f"_p_{c}")).alias(c) if c in parents.columns and c not in keys else F.col(c)
        for c in children.columns
    ]
    new = [F.col(f"_p_{c}").alias(c) for c in parents.columns if c not in children.columns]
    return joined.select(*out, *new)


def drop_flagged(df: DataFrame, flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(flagged, list(keys), "left_anti")


def course_lookup(
    runners: DataFrame,
    course: DataFrame,
    keys: Sequence[str],
    distance: str,
    values: Mapping[str, object],
    source: DataFrame | None = None,
    few: bool = False,
) -> DataFrame:
    """Course attributes by exact distance, else the default of (venue, surface), which has
    no distance, else the nearest distance, else constants.

    The choice is made once per distinct (venue, surface, distance); source has the same
    rows with a shorter plan. few says that these are few enough to go to every task.
    """
    wanted = (runners if source is None else source).select(*keys, distance).distinct()
    row = F.struct(*values)
    options = course.select(*keys, F.col(distance).alias("_d"), row.alias("_row"))
    gap = F.abs(F.col("_d") - F.col(distance))
    chosen = (
        wanted.join(options, list(keys), "left")
        .groupBy(*keys, distance)
        .agg(
            F.min_by("_row", F.when(gap == 0, F.col("_d"))).alias("_exact"),
            F.min_by("_row", F.when(F.col("_d").isNull() & F.col("_row").isNotNull(), F.lit(0))).alias("_default"),
            F.min_by("_row", F.when(gap.isNotNull(), F.struct(gap, F.col("_d")))).alias("_near"),
        )
        .withColumn("_use", F.coalesce("_exact", "_default", "_near"))
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in [*keys, distance]],
            *[F.coalesce(F.col(f"_use.{v}"), F.lit(const)).alias(v) for v, const in values.items()],
        )
    )
    cond = F.lit(True)
    for k in [*keys, distance]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return runners.join(F.broadcast(chosen) if few else chosen, cond, "left").drop(*[f"_k_{k}" for k in [*keys, distance]])


def join_back(df: DataFrame, features: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Features back on (entity, race), one row per key, missing keys matching missing keys.

    Of several rows of a key the smallest values are kept, so the result does not depend
    on the order of rows.
    """
    once = features.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.min(F.struct(*values)).alias("_v")
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(once, cond, "left").select(*[F.col(c) for c in df.columns], *[F.col(f"_v.{v}").alias(v) for v in values])


def without_children(parents: DataFrame, children: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parents.join(children.select(*keys), list(keys), "left_anti")


def with_children(parents: DataFrame, children: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parents.join(children.select(*keys), list(keys), "left_semi")


def history_plus_target(history: DataFrame, target: DataFrame, race: str = "race_id") -> DataFrame:
    """History without the target races, and the target rows with what they know."""
    rest = history.join(target.select(race).distinct(), race, "left_anti")
    return rest.unionByName(target, allowMissingColumns=True)


def latest(df: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """The newest row of each key; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in at]
    best = df.groupBy(*keys).agg(F.max(F.struct(*at, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def prediction_outcome(
    predictions: DataFrame, outcomes: DataFrame, keys: Sequence[str], at: Sequence[str]
) -> DataFrame:
    """Latest prediction per runner with its outcome, if there is one."""
    return latest(predictions, keys, at).join(outcomes, list(keys), "left")


def keyed_compare(
    existing: DataFrame, candidates: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Existing rows next to the candidate of the same key: keep, update or no candidate."""
    cand = candidates.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_there"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"new_{v}"))
    joined = existing.join(cand, list(keys), "left")
    decision = (
        F.when(F.col("_there").isNull(), F.lit("no-candidate")).when(same, F.lit("keep")).otherwise(F.lit("update"))
    )
    return joined.withColumn("decision", decision).drop("_there")


def availability(candidates: DataFrame, cache: DataFrame, keys: Sequence[str], out: str = "cache_status") -> DataFrame:
    there = cache.select(*keys).distinct().withColumn("_there", F.lit(True))
    return (
        candidates.join(there, list(keys), "left")
        .withColumn(out, F.when(F.col("_there").isNotNull(), F.lit("available")).otherwise(F.lit("missing")))
        .drop("_there")
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """First n rows of each group. The limit also applies inside each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def top_combinations(
    df: DataFrame,
    race: str,
    order: Sequence[Column],
    fields: Sequence[str],
    size: int,
    top_n: int = 5,
    ordered: bool = False,
) -> DataFrame:
    """All pairs or triples of the first top_n runners of each race, as columns a, b (and c).

    Runners are collected after the cut to top_n, so an array never has more than top_n
    elements. ordered=True gives permutations.
    """
    top = top_per_group(df, [race], order, top_n, "_rn")
    arrays = top.groupBy(race).agg(F.array_sort(F.collect_list(F.struct("_rn", *fields))).alias("_a"))
    legs = ["a", "b", "c"][:size]
    out = arrays.withColumn("a", F.explode("_a"))
    for prev, leg in zip(legs, legs[1:]):
        out = out.withColumn(leg, F.explode("_a"))
        if ordered:
            for other in legs[: legs.index(leg)]:
                out = out.filter(F.col(f"{leg}._rn") != F.col(f"{other}._rn"))
        else:
            out = out.filter(F.col(f"{leg}._rn") > F.col(f"{prev}._rn"))
    return out.drop("_a")
