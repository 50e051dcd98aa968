"""Statistics of a runner against the other runners of its race."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators.skew import HOT_ROWS, join_group_stats, ranked, slice_by_value, value_carry

EPS = 1e-8
LOG_EPS = 1e-10


def normalise(
    df: DataFrame, keys: Sequence[str], value: str, out: str, source: DataFrame | None = None, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """value / group total; unchanged where the total is not positive.

    With hot_rows=None it, zscore and odds_rank work in plain windows, which share one shuffle: the caller
    knows that no group is hot or missing.
    """
    if hot_rows is None:
        total = F.sum(value).over(Window.partitionBy(*keys))
        return df.withColumn(out, F.when(total > 0, F.col(value) / total).otherwise(F.col(value)))
    withsum = join_group_stats(df, keys, {"_sum": F.sum(value)}, source)
    return withsum.withColumn(
        out, F.when(F.col("_sum") > 0, F.col(value) / F.col("_sum")).otherwise(F.col(value))
    ).drop("_sum")


def zscore(
    df: DataFrame, keys: Sequence[str], value: str, out: str, zero_for_single: bool = False,
    source: DataFrame | None = None, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """(x - mean) / (sample deviation + 1e-8) within the group.

    zero_for_single gives 0 in groups of one row, missing values included.
    """
    stats = {"_m": F.avg(value), "_d": F.stddev_samp(value), "_k": F.count(F.lit(1))}
    if hot_rows is None:
        s = df.select("*", *[c.over(Window.partitionBy(*keys)).alias(n) for n, c in stats.items()])
    else:
        s = join_group_stats(df, keys, stats, source)
    z = (F.col(value) - F.col("_m")) / (F.col("_d") + F.lit(EPS))
    if zero_for_single:
        z = F.when(F.col("_k") > 1, z).otherwise(F.lit(0.0))
    return s.withColumn(out, z).drop("_m", "_d", "_k")


def odds_rank(
    df: DataFrame, keys: Sequence[str], odds: str, out: str, popularity: str | None = None, hot_rows: int | None = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Smallest odds first, missing odds last; also stands in for a missing popularity."""
    if hot_rows is None:
        order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(odds))
        ranked_df = df.withColumn(out, F.rank().over(order).cast("bigint"))
    else:
        ranked_df = ranked(df, keys, odds, out, hot_rows=hot_rows, source=source)
    if popularity:
        ranked_df = ranked_df.withColumn(popularity, F.coalesce(F.col(popularity), F.col(out)))
    return ranked_df


def market_entropy(df: DataFrame, race: str = "race_id", odds: str = "odds") -> DataFrame:
    """Per race: entropy of the normalised 1/odds and the sum of the three largest shares.

    0.0 and 0.5 for races with fewer than two priced runners.
    """
    share = Window.partitionBy(race)
    priced = df.filter(F.col(race).isNotNull()).select(race, F.when(F.col(odds) > 0, 1 / F.col(odds)).alias("_q"))
    p = F.col("_p")
    placed = priced.withColumn("_p", F.col("_q") / F.sum("_q").over(share)).withColumn(
        "_rn", F.row_number().over(share.orderBy(F.desc_nulls_last("_p")))
    )
    # rows are dealt by race once for shares, order and sums
    sums = placed.groupBy(race).agg(
        F.count("_p").alias("_k"), F.sum(-p * F.ln(p + F.lit(LOG_EPS))).alias("_e"), F.sum(F.when(F.col("_rn") <= 3, p)).alias("_s")
    )
    enough = F.col("_k") >= 2
    missing = df.filter(F.col(race).isNull()).select(race).limit(1)  # rows without a race are no race together
    return sums.select(
        race,
        F.when(enough, F.col("_e")).otherwise(F.lit(0.0)).alias("market_entropy"),
        F.when(enough, F.col("_s")).otherwise(F.lit(0.5)).alias("top3_probability"),
    ).unionByName(missing.select(race, F.lit(0.0).alias("market_entropy"), F.lit(0.5).alias("top3_probability")))


def closing_rank(
    df: DataFrame, race: str, time: str, out: str, ties: Sequence[Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Order of closing times in the race; runners without a usable time stay unranked."""
    r = ranked(df, [race], time, out, ties=ties, method="first", hot_rows=hot_rows)
    return r.withColumn(out, F.when(F.col(time).isNotNull(), F.col(out)))


def softmax(df: DataFrame, keys: Sequence[str], score: str, out: str) -> DataFrame:
    top = join_group_stats(df, keys, {"_max": F.max(score)})
    e = top.withColumn("_e", F.exp(F.col(score) - F.col("_max")))
    return (
        join_group_stats(e, keys, {"_sum": F.sum("_e")})
        .withColumn(out, F.col("_e") / F.col("_sum"))
        .drop("_max", "_e", "_sum")
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean of the places that equal values share, inside each group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    sliced = slice_by_value(counts, keys, value, hot_rows=hot_rows)
    w = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    carry = value_carry(sliced, keys, F.sum("_n"), "_before")
    ranks = (
        sliced.withColumn("_lower", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .join(carry, [*keys, "_first"], "left")
        .select(
            *keys,
            value,
            (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_lower") + (F.col("_n") + 1) / 2.0).alias(out),
        )
    )
    return df.join(ranks, [*keys, value], "left")
