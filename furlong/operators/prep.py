"""Between features and model: filling, splitting, encoding, dropping, aligning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.operators.skew import column_quantiles, join_group_stats, text_slices, with_row


def fill_policy(
    df: DataFrame,
    zero: Sequence[str] = (),
    unknown: Sequence[str] = (),
    median: Mapping[str, float] | None = None,
    first_start: str | None = None,
) -> DataFrame:
    """Fill missing values by column: 0, "Unknown", or the median of the positive values.

    median maps a column to what is used if it has no positive value at all; first_start
    names the column whose absence marks an entity's first event.
    """
    if first_start:
        df = df.withColumn("is_first_race", F.col(first_start).isNull().cast("int"))
    for c in zero:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    for c in unknown:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("Unknown")))
    if median:
        valid = {c: F.when(F.col(c) > 0, F.col(c)) for c in median}
        exact = column_quantiles(df.select(*[v.alias(c) for c, v in valid.items()]), list(median), [0.5])
        # one row with one column per filled column, whatever the size of the table
        medians = exact.agg(
            *[
                F.coalesce(F.max(F.when(F.col("column") == c, F.get("q", F.lit(0)))), F.lit(default)).alias(f"_m_{c}")
                for c, default in median.items()
            ]
        )
        df = with_row(df, medians)
        for c in median:
            df = df.withColumn(c, F.coalesce(valid[c], F.col(f"_m_{c}"))).drop(f"_m_{c}")
    return df


# What is only known after a race, ids, and the text columns that go with them.
FUTURE_FIELDS = [
    "time_seconds", "finish_time", "last_3f", "last_3f_time", "last_3f_rank", "last_3f_rank_normalized",
    "corner_1", "corner_2", "corner_3", "corner_4", "corner_positions", "corner_positions_list",
    "corner_position_avg", "corner_position_variance", "last_corner_position", "position_change",
    "margin", "prize_money", "finish", "finish_position", "actual_finish",
]
ID_COLUMNS = ["race_id", "horse_id", "jockey_id", "trainer_id", "owner_id"]


def label(
    df: DataFrame,
    target: str,
    finish: str = "finish",
    race: str = "race_id",
    time: str = "time",
    seconds: str = "time_seconds",
    distance: str = "distance",
    surface: str = "surface",
    out: str = "label",
    source: DataFrame | None = None,
) -> DataFrame:
    """Add a label: win, place3, win_tie, speed_deviation or rank."""
    base = df if source is None else source
    f = F.col(finish)
    won = F.coalesce(f == 1, F.lit(False))
    if target == "win":
        return df.withColumn(out, won.cast("int"))
    if target == "place3":
        return df.withColumn(out, F.coalesce(f <= 3, F.lit(False)).cast("int"))
    if target == "win_tie":
        timed = F.when(F.trim(time) != "", F.col(time))
        s = join_group_stats(df, [race], {"_wt": F.min(F.when(won, timed))}, base)
        tie = F.coalesce((timed == F.col("_wt")) & f.isNotNull(), F.lit(False))
        return s.withColumn(out, (won | tie).cast("int")).drop("_wt")
    if target == "speed_deviation":
        speed = F.col(distance) / F.nullif(F.col(seconds), F.lit(0))
        s = join_group_stats(
            df.withColumn("_v", speed), [distance, surface], {"_m": F.avg(speed), "_d": F.stddev_samp(speed)}, base
        )
        return s.withColumn(out, (F.col("_v") - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0))).drop("_v", "_m", "_d")
    if target == "rank":
        worst = base.agg(F.max(f).alias("_max"))  # one row
        score = F.greatest(F.col("_max") - f + 1, F.lit(0))
        return with_row(df, worst).withColumn(out, F.coalesce(score, F.lit(0)).cast("int")).drop("_max")
    raise ValueError(f"unknown target: {target}")


def in_period(day: Column, race_id: Column, first: str | None, last: str | None) -> Column:
    """Whether the month of a row lies in first..last (YYYYMM); the id gives the month where the date is unusable."""
    month = F.when(F.trim(day).rlike("^[0-9]{8}$"), F.substring(F.trim(day), 1, 6)).otherwise(
        F.substring(race_id.cast("string"), 1, 6)
    )
    cond = F.lit(True)
    if first:
        cond = cond & (month >= first.replace("-", ""))
    if last:
        cond = cond & (month <= last.replace("-", ""))
    return cond


def stable_unit(keys: Sequence[str], seed: int = 42) -> Column:
    """A number in 0..1 that depends on the row's keys only, so it survives recomputation."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) / 1_000_000.0


def time_split(
    df: DataFrame,
    day: str,
    keys: Sequence[str],
    last_days: int | None = None,
    test_size: float = 0.2,
    method: str = "date",
    out: str = "split",
) -> DataFrame:
    """Mark rows train or test: by "date", the last N days or the last share of the rows, or by a
    "hash" of their keys.

    The method never changes with the size of the data, so with "date" no later row is trained on. A
    side may be empty (a single day); side_sizes() tells before training.
    """
    if method == "hash":
        return df.withColumn(out, F.when(stable_unit(keys) < test_size, "test").otherwise("train"))
    if method != "date":
        raise ValueError(f"unknown method {method}")
    number = F.unix_date(F.col(day))
    if last_days is not None:
        cut = df.agg((F.max(number) - last_days - 1).cast("double").alias("_cut"))
    else:
        cut = column_quantiles(df.select(number.alias("d")), ["d"], [1 - test_size]).select(
            F.floor(F.get("q", F.lit(0))).cast("double").alias("_cut")
        )
    return with_row(df, cut).withColumn(out, F.when(number > F.col("_cut"), "test").otherwise("train")).drop("_cut")


def side_sizes(split: DataFrame, out: str = "split") -> DataFrame:
    """One row: rows to train on, rows to test on."""
    return split.agg(*[F.count(F.when(F.col(out) == side, 1)).alias(side) for side in ("train", "test")])


def leak_guard(df: DataFrame, keep: Sequence[str] = ("label",), also: Sequence[str] = ()) -> DataFrame:
    """Only what may reach a model: no post-race fields, ids or text; raises if one would remain."""
    banned = {*FUTURE_FIELDS, *ID_COLUMNS, *also} - set(keep)
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)} - set(keep)
    out = df.drop(*banned, *text)
    left = [c for c in out.columns if c in banned]
    if left:
        raise ValueError(f"post-race columns would reach the model: {left}")
    return out


def label_table(df: DataFrame, column: str, unknown: str = "Unknown", slices: int = 1024) -> DataFrame:
    """Codes 0, 1, 2, ... of the sorted categories: (column, code); missing is a category of its own.

    Categories are numbered within ranges of about even size, then shifted by the categories of
    the earlier ranges, so a column with very many categories is not sorted by one task.
    """
    cats = df.select(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias(column)).distinct()
    cats = text_slices(cats, column, "_slice", slices)
    sizes = cats.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy(column)
    return (
        cats.withColumn("_rn", F.row_number().over(inside))
        .join(carry, "_slice")
        .select(column, (F.col("_before") + F.col("_rn") - 1).cast("bigint").alias("code"))
    )


def label_encode(df: DataFrame, column: str, labels: DataFrame, out: str, unknown: str = "Unknown") -> DataFrame:
    """Code of each category; missing is looked up as Unknown, unseen categories give null."""
    keyed = df.withColumn("_c", F.coalesce(F.col(column).cast("string"), F.lit(unknown)))
    table = labels.select(F.col(column).alias("_c"), F.col("code").alias(out))
    return keyed.join(table, "_c", "left").drop("_c")


def drop_sparse(df: DataFrame, keep: Sequence[str], share: float = 0.9) -> DataFrame:
    """Without the columns that are null in at least ``share`` of the rows. One pass over the data."""
    tested = [c for c in df.columns if c not in keep]
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in tested]).first()
    return df.drop(*[c for c in tested if rates[c] is not None and rates[c] >= share])


def drop_constant(df: DataFrame, keep: Sequence[str], least: float = 1e-6) -> DataFrame:
    """Without the numeric columns that do not vary. One pass over the data."""
    numeric = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keep
    ]
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first()
    return df.drop(*[c for c in numeric if spread[c] is not None and spread[c] < least])


def align_features(df: DataFrame, trained: Sequence[str], max_missing: float = 0.1) -> DataFrame:
    """The trained columns in their order, absent ones as null; raises if too many are absent."""
    absent = [c for c in trained if c not in df.columns]
    if len(absent) > max_missing * len(trained):
        raise ValueError(f"{len(absent)} of {len(trained)} features are missing: {absent}")
    return df.select(*[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in trained])


def number_rows(df: DataFrame, key: Column, out: str, bits: int = 18) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of a hash, slice by slice.

    The 2 ** bits slices are ranges of the hash, so they are of even size whatever the data; rows
    of equal hash are ordered by all their columns.
    """
    keyed = df.withColumn("_h", key).withColumn("_slice", F.shiftrightunsigned(F.col("_h"), 64 - bits))
    sizes = keyed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy("_h", *[F.col(c) for c in df.columns])
    return (
        keyed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(carry), "_slice")  # at most one row per slice
        .withColumn(out, F.col("_before") + F.col("_rn") - 1)
        .drop("_h", "_slice", "_rn", "_before")
    )
