"""Statistics of an entity's earlier events. Nothing here sees the event it describes.

With ``hot_rows=None`` an operator works in plain windows over the entity: the caller knows that no
entity is hot or missing. A frame that is partitioned by a part of the entity is then not shuffled
again, so many statistics share one shuffle (see ``plans.partitioned``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from furlong.operators.skew import HOT_ROWS, slice_carry, slice_hot

ORDER = ("race_date", "race_id")


def _zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _known(entity: Sequence[str]) -> Column:
    known = F.lit(True)
    for e in entity:
        known = known & F.col(e).isNotNull()
    return known


def _totals_before(part: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> dict[str, Column]:
    """Running totals including the event, less the event's own."""
    upto = Window.partitionBy(*part).orderBy(*order)
    own = Window.partitionBy(*part, *order)
    return {
        n: F.sum(_zero_if_null(c)).over(upto) - F.sum(_zero_if_null(c)).over(own) for n, c in sums.items()
    }


def expanding(
    df: DataFrame,
    entity: Sequence[str],
    sums: Mapping[str, Column],
    order: Sequence[str] = ORDER,
    hot_rows: int | None = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Totals over all strictly earlier events of the entity, one column per entry of sums.

    ``order`` starts with a date and identifies the event, so rows of one event are
    peers: the running total includes them and the event's own total is taken off.
    That needs one shuffle and one sort, and no join back. Totals must be integers or
    decimals, for which the difference is exact. Rows without an entity get null.
    """
    known = _known(entity)
    if hot_rows is None:
        before = _totals_before(entity, order, sums)
        return df.select("*", *[F.when(known, c).alias(n) for n, c in before.items()])
    how = (entity, F.unix_date(F.col(order[0])), order, hot_rows, source)
    sliced = slice_hot(df, *how)
    base = sliced if source is None else slice_hot(source, *how)
    part = [*entity, "_slice"]
    local = sliced.select("*", *[c.alias(f"_l_{n}") for n, c in _totals_before(part, order, sums).items()])
    carry = slice_carry(base, entity, {f"_c_{n}": F.sum(_zero_if_null(c)) for n, c in sums.items()})
    joined = local.join(carry, part, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            F.when(known, F.col(f"_l_{n}") + _zero_if_null(F.col(f"_c_{n}"))).alias(n)
            for n in sums
        ],
    )


def rolling(
    df: DataFrame,
    entity: Sequence[str],
    stats: Mapping[str, Callable[[Callable[[int, int], WindowSpec]], Column]],
    length: int,
    inputs: Sequence[str],
    tie: Sequence[str] = (),
    order: Sequence[str] = ORDER,
    hot_rows: int | None = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Statistics over the last rows of the entity before the event.

    Each entry of stats gets ``last(frm, to)``, the window of rows frm..to counted back
    from the current row (``last(3, 1)`` is the last three), none longer than
    ``length``. ``tie`` orders rows inside one event; every row of an event receives
    what its first row saw, so nothing of the event itself leaks in. ``inputs`` are the
    columns the statistics read.

    A slice of a hot entity is preceded by copies of the last ``length`` rows before it.
    """
    seq = [*order, *[t for t in tie if t not in order and t not in entity]]
    if hot_rows is None:
        plain = df.withColumn("_halo", F.lit(False))
        return _last_rows(plain, df.columns, entity, entity, stats, order, seq).drop("_halo")
    how = (entity, F.unix_date(F.col(order[0])), order, hot_rows, source)
    sliced = slice_hot(df, *how)
    base = sliced if source is None else slice_hot(source, *how)
    part = [*entity, "_slice"]
    kept = list(dict.fromkeys([*seq, *[c for c in inputs if c not in entity]]))

    newest = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in seq])
    tails = (
        base.filter("_hot")
        .select(*part, *kept, F.row_number().over(newest).alias("_rn"))
        .filter(F.col("_rn") <= length)
        .groupBy(*part)
        .agg(F.collect_list(F.struct(*kept)).alias("_rows"))
    )
    earlier = Window.partitionBy(*entity).orderBy("_slice").rowsBetween(-length, -1)
    halo = (
        tails.select(*part, F.flatten(F.collect_list("_rows").over(earlier)).alias("_rows"))
        .select(*part, F.explode(F.slice(F.reverse(F.array_sort("_rows")), 1, length)).alias("_r"))
        .select(*part, *[F.col(f"_r.{c}").alias(c) for c in kept], F.lit(True).alias("_halo"))
    )
    rows = sliced.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)

    return _last_rows(rows, df.columns, entity, part, stats, order, seq).filter(~F.col("_halo")).drop("_halo")


def _last_rows(
    rows: DataFrame, columns: Sequence[str], entity: Sequence[str], part: Sequence[str], stats: Mapping, order: Sequence[str], seq: Sequence[str]
) -> DataFrame:
    """The columns, _halo, and the statistics as the first row of each event sees them."""
    in_order = Window.partitionBy(*part).orderBy(*seq)

    def last(frm: int, to: int) -> WindowSpec:
        return in_order.rowsBetween(-frm, -to)

    seen = rows.select("*", *[fn(last).alias(f"_s_{n}") for n, fn in stats.items()])
    first_row = Window.partitionBy(*part, *order).orderBy(*seq[len(order):] or [F.lit(0)])
    known = _known(entity)
    return seen.select(
        *[F.col(c) for c in columns],
        "_halo",
        *[F.when(known, F.first(f"_s_{n}").over(first_row)).alias(n) for n in stats],
    )


def day_range(
    df: DataFrame,
    entity: Sequence[str],
    sums: Mapping[str, Column],
    days: int,
    day: str = "race_date",
    source: DataFrame | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Totals over the events of the entity in the ``days`` days before the row's day.

    Totals per entity and day come first: an entity then has at most one row per
    calendar day, however many events it has. In plain windows the totals are differences of two
    running ones, as a moving range would go over all rows of the range for each row.
    """
    known = _known(entity)
    if hot_rows is None:
        by_day = Window.partitionBy(*entity).orderBy(F.unix_date(F.col(day)))
        upto, out = (by_day.rangeBetween(Window.unboundedPreceding, -k) for k in (1, days + 1))
        moved = {n: _zero_if_null(F.sum(c).over(upto)) - _zero_if_null(F.sum(c).over(out)) for n, c in sums.items()}
        return df.select("*", *[F.when(known & F.col(day).isNotNull(), c).alias(n) for n, c in moved.items()])
    daily = (df if source is None else source).filter(known).groupBy(*entity, day).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    window = Window.partitionBy(*entity).orderBy(F.unix_date(F.col(day))).rangeBetween(-days, -1)
    prior = daily.select(*entity, day, *[F.sum(n).over(window).alias(n) for n in sums])
    return df.join(prior, [*entity, day], "left")


def days_since_last(
    df: DataFrame,
    entity: str = "horse_id",
    event: str = "race_id",
    day: str = "race_date",
    out: str = "days_since_last",
    source: DataFrame | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Days since the entity's previous event, positive values only.

    Of several events of one day the first one counts the days, the others have none.
    """
    if hot_rows is None:
        earlier = Window.partitionBy(entity).orderBy(F.unix_date(F.col(day))).rangeBetween(Window.unboundedPreceding, -1)
        gap = F.datediff(F.col(day), F.max(day).over(earlier))
        first = F.min(event).over(Window.partitionBy(entity, day))
        return df.withColumn(out, F.when(F.col(day).isNotNull() & (F.col(event) == first), gap).cast("bigint"))
    daily = (
        (df if source is None else source).filter(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(entity, day)
        .agg(F.min(event).alias("_first"))
    )
    w = Window.partitionBy(entity).orderBy(day)
    gaps = daily.select(entity, day, "_first", F.datediff(F.col(day), F.lag(day).over(w)).alias("_gap"))
    return (
        df.join(gaps, [entity, day], "left")
        .withColumn(out, F.when(F.col(event) == F.col("_first"), F.col("_gap")).cast("bigint"))
        .drop("_first", "_gap")
    )


def win(finish: str = "finish") -> Column:
    return (F.col(finish) == 1).cast("bigint")


def within_top(n: int, finish: str = "finish", null_counts: bool = False) -> Column:
    """1 for a finish among the first n. null_counts=True treats a missing finish as 0, which counts."""
    if null_counts:
        return (F.coalesce(F.col(finish), F.lit(0)) <= n).cast("bigint")
    return F.col(finish).between(1, n).cast("bigint")


def runs() -> Column:
    return F.lit(1).cast("bigint")


def rate(total: str, count: str, default: float | None = 0.0) -> Column:
    return F.when(F.col(count) > 0, F.col(total) / F.col(count)).otherwise(
        F.lit(default).cast("double")
    )


def rate_columns(prefix: str, total: str = "_w", count: str = "_n") -> dict[str, Column]:
    """Win rate and count from totals."""
    return {f"{prefix}_win_rate": rate(total, count), f"{prefix}_count": F.coalesce(F.col(count), F.lit(0)).cast("bigint")}


def expanding_rate(
    df: DataFrame,
    entity: Sequence[str],
    prefix: str,
    finish: str = "finish",
    order: Sequence[str] = ORDER,
    hot_rows: int | None = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Prior win rate and prior count; 0 with no history."""
    out = expanding(df, entity, {"_w": win(finish), "_n": runs()}, order, hot_rows, source)
    return out.withColumns(rate_columns(prefix)).drop("_w", "_n")


def multi_sums(finish: str = "finish", null_as_zero: bool = False, mark: str = "_") -> dict[str, Column]:
    seen = runs() if null_as_zero else F.col(finish).isNotNull().cast("bigint")
    return {f"{mark}w": win(finish), f"{mark}n": runs(), f"{mark}f": F.col(finish).cast("bigint"), f"{mark}m": seen}


def multi_columns(prefix: str, defaults: tuple[float, int, float | None] = (0.0, 0, None), mark: str = "_") -> dict[str, Column]:
    """Win rate, count and mean finish from multi_sums."""
    return {
        f"{prefix}_win_rate": rate(f"{mark}w", f"{mark}n", defaults[0]),
        f"{prefix}_count": F.coalesce(F.col(f"{mark}n"), F.lit(defaults[1])).cast("bigint"),
        f"{prefix}_avg_finish": rate(f"{mark}f", f"{mark}m", defaults[2]),
    }


def expanding_multi(
    df: DataFrame,
    entity: Sequence[str],
    prefix: str,
    finish: str = "finish",
    order: Sequence[str] = ORDER,
    null_as_zero: bool = False,
    defaults: tuple[float, int, float | None] = (0.0, 0, None),
    hot_rows: int | None = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Prior win rate, count and mean finish, with a default for each where there is no history.

    null_as_zero=True counts a missing finish as 0 in the mean.
    """
    out = expanding(df, entity, multi_sums(finish, null_as_zero), order, hot_rows, source)
    return out.withColumns(multi_columns(prefix, defaults)).drop("_w", "_n", "_f", "_m")


def career_sums(finish: str = "finish", compat: bool = False, mark: str = "_") -> dict[str, Column]:
    return {
        f"{mark}1": win(finish),
        f"{mark}2": within_top(2, finish, compat),
        f"{mark}3": within_top(3, finish, compat),
        f"{mark}n": runs(),
    }


def career_columns(prefix: str, mark: str = "_") -> dict[str, Column]:
    """Win, top-2 and top-3 rates and the number of events from career_sums."""
    n = f"{mark}n"
    rates = {f"{prefix}_{name}_rate": rate(f"{mark}{k}", n) for k, name in ((1, "win"), (2, "top2"), (3, "top3"))}
    return rates | {f"{prefix}_race_count": F.coalesce(F.col(n), F.lit(0)).cast("bigint")}


def entity_career(
    df: DataFrame,
    entity: str,
    prefix: str,
    finish: str = "finish",
    compat: bool = False,
    order: Sequence[str] = ORDER,
    hot_rows: int | None = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Prior win, top-2 and top-3 rates. compat=True lets a missing finish count as placed."""
    out = expanding(df, [entity], career_sums(finish, compat), order, hot_rows, source)
    return out.withColumns(career_columns(prefix)).drop("_1", "_2", "_3", "_n")


def smooth_rate(rate_col: Column, count: Column, prior: float = 0.075, strength: int = 5) -> Column:
    """Rate pulled towards a prior worth ``strength`` events."""
    n = F.coalesce(count, F.lit(0))
    return (n * F.coalesce(rate_col, F.lit(0.0)) + F.lit(strength * prior)) / (n + F.lit(strength))


def has_history(count: Column, least: int = 3) -> Column:
    return (F.coalesce(count, F.lit(0)) >= least).cast("int")


def pair_smoothed(
    df: DataFrame, pair: Sequence[str], prefix: str, order: Sequence[str] = ORDER, hot_rows: int | None = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    out = expanding_rate(df, pair, prefix, order=order, hot_rows=hot_rows, source=source)
    return out.withColumn(
        f"{prefix}_win_rate_smooth", smooth_rate(F.col(f"{prefix}_win_rate"), F.col(f"{prefix}_count"))
    )


def form_stats(finish: str = "finish") -> dict:
    """Mean finish of the last 3, 5 and 10 starts, win rate of the last 3 and 5."""
    stats = {f"avg_finish_{n}": (lambda last, n=n: F.avg(finish).over(last(n, 1))) for n in (3, 5, 10)}
    return stats | {f"win_rate_{n}": (lambda last, n=n: F.avg(win(finish)).over(last(n, 1))) for n in (3, 5)}


def recent_form(df: DataFrame, entity: str, tie: Sequence[str], finish: str = "finish", **kw) -> DataFrame:
    return rolling(df, [entity], form_stats(finish), 10, [finish], tie, **kw)


def recent_rate(
    df: DataFrame, entity: str, out: str, tie: Sequence[str], length: int = 30, least: int = 5,
    finish: str = "finish", **kw,
) -> DataFrame:
    """Win rate of the last ``length`` rides, null below ``least`` known results."""

    def stat(last):
        w = last(length, 1)
        return F.when(F.count(finish).over(w) >= least, F.avg(win(finish)).over(w))

    return rolling(df, [entity], {out: stat}, length, [finish], tie, **kw)


def closing_stats(time: str, rank: str) -> dict:
    """Mean closing time of the last 3 and 5, mean closing rank of the last 3."""
    return {
        "closing_avg_3": lambda last: F.avg(time).over(last(3, 1)),
        "closing_avg_5": lambda last: F.avg(time).over(last(5, 1)),
        "closing_rank_avg_3": lambda last: F.avg(rank).over(last(3, 1)),
    }


def recent_closing(df: DataFrame, entity: str, time: str, rank: str, tie: Sequence[str], **kw) -> DataFrame:
    return rolling(df, [entity], closing_stats(time, rank), 5, [time, rank], tie, **kw)


def payout_stats(payout: str, out: str) -> dict:
    """Mean log(1 + payout) of the last 5, a missing payout counts as 0."""
    value = F.log1p(F.coalesce(F.col(payout), F.lit(0.0)))
    return {out: lambda last: F.avg(value).over(last(5, 1))}


def recent_log_payout(df: DataFrame, entity: str, payout: str, out: str, tie: Sequence[str], **kw) -> DataFrame:
    return rolling(df, [entity], payout_stats(payout, out), 5, [payout], tie, **kw)


def style_stats(style: str) -> dict:
    """Mean and spread of the running-style code over the last 5; the spread is 0 below two values."""

    def spread(last):
        w = last(5, 1)
        return F.when(
            F.count(F.lit(1)).over(w) > 0, F.coalesce(F.stddev_samp(style).over(w), F.lit(0.0))
        )

    return {"style_avg_5": lambda last: F.avg(style).over(last(5, 1)), "style_std_5": spread}


def recent_style(df: DataFrame, entity: str, style: str, tie: Sequence[str], **kw) -> DataFrame:
    return rolling(df, [entity], style_stats(style), 5, [style], tie, **kw)


def previous_stats(columns: Sequence[str]) -> dict:
    """prev_<column>: the value at the previous start."""
    return {f"prev_{c}": (lambda last, c=c: F.max(c).over(last(1, 1))) for c in columns}


def past10_panel(
    df: DataFrame, entity: str, tie: Sequence[str], finish: str = "finish", popularity: str = "popularity", **kw
) -> DataFrame:
    """Summary of the last ten starts, zeros where there is none."""
    f = F.col(finish)

    def over(fn, frm=10, to=1):
        return lambda last: fn().over(last(frm, to))

    stats = {
        "_n": over(lambda: F.count(F.lit(1))),
        "_avg": over(lambda: F.avg(f)),
        "_std": over(lambda: F.stddev_samp(f)),
        "_best": over(lambda: F.min(f)),
        "_worst": over(lambda: F.max(f)),
        "_w1": over(lambda: F.sum(within_top(1, finish))),
        "_w2": over(lambda: F.sum(within_top(2, finish))),
        "_w3": over(lambda: F.sum(within_top(3, finish))),
        "_pop": over(lambda: F.avg(popularity)),
        "_r3": over(lambda: F.avg(f), 3),
        "_o7": over(lambda: F.avg(f), 10, 4),
    }
    n = F.coalesce(F.col("_n"), F.lit(0))
    out = rolling(df, [entity], stats, 10, [finish, popularity], tie, **kw)

    def share(c):
        return F.when(n > 0, F.coalesce(F.col(c), F.lit(0)) / n).otherwise(F.lit(0.0))

    def filled(c):
        return F.when(n > 0, F.col(c).cast("double")).otherwise(F.lit(0.0))

    return out.select(
        *[F.col(c) for c in df.columns],
        n.cast("bigint").alias("past10_count"),
        filled("_avg").alias("past10_avg_finish"),
        F.when(n > 1, F.col("_std")).otherwise(F.lit(0.0)).alias("past10_std_finish"),
        filled("_best").alias("past10_best_finish"),
        filled("_worst").alias("past10_worst_finish"),
        share("_w1").alias("past10_win_rate"),
        share("_w2").alias("past10_top2_rate"),
        share("_w3").alias("past10_top3_rate"),
        filled("_pop").alias("past10_avg_popularity"),
        filled("_r3").alias("recent3_avg_finish"),
        F.when(n >= 10, F.col("_o7")).otherwise(F.lit(0.0)).alias("older7_avg_finish"),
        F.when(n > 1, 1 / (1 + F.col("_std"))).when(n == 1, F.lit(0.5)).otherwise(F.lit(0.0)).alias(
            "finish_consistency"
        ),
        F.when(n >= 3, F.greatest(F.lit(0.0), 10 - F.col("_r3")) / 10).otherwise(F.lit(0.0)).alias(
            "form_score"
        ),
    )


def past5_weight_trend(
    df: DataFrame, entity: str, tie: Sequence[str], weight: str = "weight", change: str = "weight_change", **kw
) -> DataFrame:
    """Least-squares slope of body weight over the last five starts, newest first, and mean change."""
    out = rolling(
        df,
        [entity],
        {
            "_w": lambda last: F.collect_list(weight).over(last(5, 1)),
            "_cn": lambda last: F.count(change).over(last(5, 1)),
            "_ca": lambda last: F.avg(change).over(last(5, 1)),
        },
        5,
        [weight, change],
        tie,
        **kw,
    )
    y = F.reverse(F.col("_w"))
    n = F.size("_w").cast("double")
    sx = n * (n - 1) / 2
    sxx = (n - 1) * n * (2 * n - 1) / 6
    sy = F.aggregate(y, F.lit(0.0), lambda a, v: a + v)
    sxy = F.aggregate(F.transform(y, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return out.select(
        *[F.col(c) for c in df.columns],
        F.when(F.size("_w") >= 3, (n * sxy - sx * sy) / (n * sxx - sx * sx))
        .otherwise(F.lit(0.0))
        .alias("past5_weight_slope"),
        F.when(F.col("_cn") >= 2, F.col("_ca")).otherwise(F.lit(0.0)).alias("past5_weight_avg_change"),
    )


def past10_closing(df: DataFrame, entity: str, time: str, rank: str, tie: Sequence[str], **kw) -> DataFrame:
    """Mean and best closing time of the last ten, mean of the last three, mean rank, share of rank 1."""
    stats = {
        "past10_avg_closing": lambda last: F.avg(time).over(last(10, 1)),
        "past10_best_closing": lambda last: F.min(time).over(last(10, 1)),
        "recent3_avg_closing": lambda last: F.avg(time).over(last(3, 1)),
        "past10_avg_closing_rank": lambda last: F.avg(rank).over(last(10, 1)),
        "past10_closing_top1_rate": lambda last: F.coalesce(
            F.avg((F.col(rank) == 1).cast("int")).over(last(10, 1)), F.lit(0.0)
        ),
    }
    return rolling(df, [entity], stats, 10, [time, rank], tie, **kw)


def range_sums(finish: str = "finish", mark: str = "_") -> dict[str, Column]:
    seen = F.col(finish).isNotNull().cast("bigint")
    return career_sums(finish, mark=mark) | {f"{mark}f": F.col(finish).cast("bigint"), f"{mark}m": seen}


def range_columns(prefix: str, mark: str = "_") -> dict[str, Column]:
    """Win, top-2 and top-3 rate, rides and mean finish from range_sums."""
    n = F.coalesce(F.col(f"{mark}n"), F.lit(0))
    rates = {
        f"{prefix}_{name}_rate": F.when(n > 0, F.coalesce(F.col(f"{mark}{k}"), F.lit(0)) / n).otherwise(F.lit(0.0))
        for k, name in ((1, "win"), (2, "top2"), (3, "top3"))
    }
    mean = F.when(F.col(f"{mark}m") > 0, F.col(f"{mark}f") / F.col(f"{mark}m")).otherwise(F.lit(0.0))
    return rates | {f"{prefix}_rides": n.cast("bigint"), f"{prefix}_avg_finish": mean}


def range_rates(
    df: DataFrame, entity: str, prefix: str, days: int = 180, finish: str = "finish", day: str = "race_date",
    source: DataFrame | None = None, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Win, top-2 and top-3 rate, rides and mean finish over the last ``days`` days."""
    out = day_range(df, [entity], range_sums(finish), days, day, source, hot_rows)
    return out.select(*[F.col(c) for c in df.columns], *[c.alias(n) for n, c in range_columns(prefix).items()])


def cumulative_pnl(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    ident: str,
    cost: str = "cost",
    payout: str = "payout",
    hot_rows: int = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Running cost, return, profit and recovery percentage in time order, per key.

    cost and payout should be integers or decimals, so that the totals are exact.
    """
    how = (keys, F.unix_date(F.col(time).cast("date")), [time, ident], hot_rows, source)
    sliced = slice_hot(df, *how)
    base = sliced if source is None else slice_hot(source, *how)
    upto = Window.partitionBy(*keys, "_slice").orderBy(time, ident).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = sliced.select(
        "*", F.sum(cost).over(upto).alias("_lc"), F.sum(payout).over(upto).alias("_lp")
    )
    carry = slice_carry(base, keys, {"_cc": F.sum(cost), "_cp": F.sum(payout)})
    total_cost = F.col("_lc") + F.coalesce(F.col("_cc"), F.lit(0))
    total_return = F.col("_lp") + F.coalesce(F.col("_cp"), F.lit(0))
    return local.join(carry, [*keys, "_slice"], "left").select(
        *[F.col(c) for c in df.columns],
        total_cost.alias("cum_cost"),
        total_return.alias("cum_return"),
        (total_return - total_cost).alias("cum_profit"),
        F.when(total_cost > 0, F.round(total_return / total_cost * 100, 1)).otherwise(F.lit(0.0)).alias(
            "cum_recovery"
        ),
    )
