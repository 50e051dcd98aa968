"""Aggregations: money, coverage, rates, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.history import ORDER, expanding, runs, win
from furlong.operators.skew import HOT_ROWS, join_group_stats, ranked, with_row


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, 0 where there is no whole."""
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def bet_stats(
    df: DataFrame,
    keys: Sequence[str] = ("bet_type", "season"),
    cost: str = "total_cost",
    payout: str = "actual_return",
    hit: str = "is_hit",
) -> DataFrame:
    """Count, cost, return, hits and rates per value of each key, and overall.

    Every bet is counted under each key in one pass. Rows: (dimension, value, ...).
    """
    dims = [F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys]
    dims.append(F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value")))
    out = (
        df.select(cost, payout, hit, F.explode(F.array(*dims)).alias("_d"))
        .groupBy(F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum(F.coalesce(cost, F.lit(0))).alias("total_cost"),
            F.sum(F.coalesce(payout, F.lit(0))).alias("total_return"),
            F.sum(F.coalesce(hit, F.lit(0))).cast("bigint").alias("hit_count"),
        )
    )
    return out.withColumn("recovery_rate", percent(F.col("total_return"), F.col("total_cost"))).withColumn(
        "hit_rate", percent(F.col("hit_count"), F.col("count"))
    )


def table_stats(docs: DataFrame, data: str, key: str, day: str, exact: bool = True) -> DataFrame:
    """Row count, distinct keys and latest day of a table of JSON documents."""
    k, d = F.get_json_object(data, f"$.{key}"), F.get_json_object(data, f"$.{day}")
    distinct = F.count_distinct(k) if exact else F.approx_count_distinct(k)
    return docs.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_keys"), F.max(d).alias("latest"))


def field_size(df: DataFrame, race: str = "race_id", declared: str | None = None, out: str = "field_size") -> DataFrame:
    """Runners per race; a declared size comes first where it is given."""
    sized = join_group_stats(df, [race], {"_n": F.count(F.lit(1))})
    n = F.coalesce(F.col(declared), F.col("_n")) if declared else F.col("_n")
    return sized.withColumn(out, n).drop("_n")


def payout_pivot(
    df: DataFrame, race: str, bet_type: str, payout: str, columns: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Per race one column per (bet type, min or max); payouts of zero are ignored."""
    paid = F.when(F.col(payout) > 0, F.col(payout))
    fns = {"min": F.min, "max": F.max}
    return df.groupBy(race).agg(
        *[fns[how](F.when(F.col(bet_type) == kind, paid)).alias(out) for out, (kind, how) in columns.items()]
    )


def gate_bias(
    df: DataFrame,
    keys: Sequence[str],
    finish: str = "finish",
    least: int = 10,
    neutral: float = 0.5,
    out: str = "gate_win_rate",
    as_of: bool = False,
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Win rate of the group, a neutral value below ``least`` samples.

    By default over all rows, later ones included; as_of=True looks at earlier events only.
    """
    if as_of:
        s = expanding(df, keys, {"_w": win(finish), "_n": runs()}, order, hot_rows, source)
    else:
        s = join_group_stats(df, keys, {"_w": F.sum(win(finish)), "_n": F.count(F.lit(1))}, source)
    rate = F.when(F.col("_n") >= least, F.coalesce(F.col("_w"), F.lit(0)) / F.col("_n")).otherwise(F.lit(neutral))
    return s.withColumn(out, rate).drop("_w", "_n")


def prediction_stats(
    df: DataFrame,
    race: str,
    rank: str,
    finish: str,
    odds: str,
    probability: str,
    stake: float = 100.0,
) -> DataFrame:
    """One row: decided races, how the top pick did, ROI of a flat stake on it, expected values.

    A race is decided when one of its runners has a finish; a race counts once for the
    top pick whatever the number of rows ranked first.
    """
    ev = F.col(probability) * F.col(odds)
    top = F.col(rank) == 1
    won = top & (F.col(finish) == 1)
    per_race = df.groupBy(race).agg(
        (F.count(finish) > 0).cast("int").alias("decided"),
        F.max(F.when(won, 1).otherwise(0)).alias("won"),
        F.max(F.when(top & F.col(finish).between(1, 3), 1).otherwise(0)).alias("placed"),
        F.max(F.when(won, F.col(odds))).alias("paid"),
        F.max(F.when(top, ev)).alias("ev"),
    )
    d = F.col("decided")
    decided = F.sum(d)
    return per_race.agg(
        F.count(F.lit(1)).alias("races"),
        decided.alias("decided"),
        percent(F.sum(d * F.col("won")), decided).alias("top1_win_rate"),
        percent(F.sum(d * F.col("placed")), decided).alias("top1_in3_rate"),
        percent(F.sum(d * F.coalesce(F.col("paid"), F.lit(0.0)) * stake), decided * stake).alias("roi"),
        F.round(F.avg("ev"), 3).alias("average_ev"),
        percent(F.sum((F.col("ev") >= 1).cast("int")), F.count("ev")).alias("positive_ev_rate"),
    )


def backtest_roi(
    df: DataFrame,
    race: str,
    score: str,
    finish: str,
    implied: str,
    default: float = 0.1,
    floor: float = 0.02,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row: how runners ranked by score did, and the ROI of backing the first.

    The payoff of a winner is 100 over its implied probability, which is at least
    ``floor`` and ``default`` where it is missing.
    """
    r = ranked(df, [race], score, "_rank", descending=True, hot_rows=hot_rows)
    won = F.col(finish) == 1
    payoff = F.when(won, 100 / F.greatest(F.coalesce(F.col(implied), F.lit(default)), F.lit(floor))).otherwise(0.0)
    top = F.col("_rank") == 1
    races = r.groupBy(race).agg(F.max((won & (F.col("_rank") <= 3)).cast("int")).alias("_in3")).agg(
        F.count(F.lit(1)).alias("races"), F.round(F.avg(F.coalesce("_in3", F.lit(0))), 6).alias("winner_in_top3")
    )
    picks = r.filter(top).agg(
        F.count(F.lit(1)).alias("picks"),
        F.round(F.avg(F.coalesce(won.cast("int"), F.lit(0))), 6).alias("top1_win"),
        F.round(F.avg(F.coalesce((F.col(finish) <= 3).cast("int"), F.lit(0))), 6).alias("top1_show"),
        F.round(F.sum(payoff) / (F.count(F.lit(1)) * 100), 6).alias("roi"),
    )
    return with_row(picks, races)


def hit_roi(df: DataFrame, hit: str, roi: str) -> DataFrame:
    """Hit rate and mean ROI over the rows where both are numbers."""
    h, r = F.col(hit).try_cast("double"), F.col(roi).try_cast("double")
    rows = df.select(h.alias("h"), r.alias("r")).filter(F.col("h").isNotNull() & F.col("r").isNotNull())
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("h"), 6).alias("hit_rate"),
        F.round(F.avg("r"), 6).alias("mean_roi"),
    )


def date_coverage(df: DataFrame, day: str) -> DataFrame:
    """First and last month and day among texts that are a YYYYMMDD date or start with a YYYYMM month."""
    t = F.trim(day)
    month = F.when(t.rlike("^(19|20)[0-9]{2}(0[1-9]|1[0-2])"), F.substring(t, 1, 6))
    whole = F.when(F.try_to_timestamp(t, F.lit("yyyyMMdd")).isNotNull(), t)
    return df.agg(
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
        F.min(whole).alias("first_day"),
        F.max(whole).alias("last_day"),
    )


def overview(
    races: DataFrame, runners: DataFrame, race: str, day: str, horse: str, sire: str
) -> DataFrame:
    """One row: days, races, races without runners, horses without pedigree, field sizes."""
    days = races.agg(F.count_distinct(day).alias("days"), F.count_distinct(race).alias("races"))
    empty = races.select(race).distinct().join(runners.select(race), race, "left_anti").agg(
        F.count(F.lit(1)).alias("races_without_runners")
    )
    horses = (
        runners.filter(F.col(horse).isNotNull())
        .groupBy(horse)
        .agg(F.max(sire).alias("_s"))
        .agg(
            F.count(F.lit(1)).alias("horses"),
            F.sum(F.col("_s").isNull().cast("int")).cast("bigint").alias("horses_without_pedigree"),
        )
    )
    fields = runners.groupBy(race).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.min("_n").alias("min_field"), F.max("_n").alias("max_field"), F.round(F.avg("_n"), 6).alias("avg_field")
    )
    return with_row(with_row(with_row(days, empty), horses), fields)


# ---- audits of text rows ----------------------------------------------------

# Fields of a runner row by how much they are needed.
CORE_FIELDS = ["race_id", "race_date", "venue", "race_number", "horse_id", "horse_name", "frame_number", "horse_number"]
RESULT_FIELDS = ["finish_position", "result_time", "margin"]
IMPORTANT_FIELDS = ["odds", "popularity", "horse_weight", "jockey", "trainer", "sire", "dam", "broodmare_sire"]
GROUP_KEYS = ["year", "month", "venue", "race_type", "distance", "surface", "class", "source_page_type"]


def is_missing(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def domain_allowed(field: str) -> Column:
    """A gap that racing itself explains: no margin for the winner, nothing for non-finishers."""
    finish = F.trim(F.coalesce("finish_position", F.lit("")))
    placed = finish.rlike("^[0-9]+$")
    if field == "margin":
        return (finish == "1") | ~placed
    if field == "result_time":
        return ~placed
    if field == "finish_position":
        return F.coalesce(F.lower("source_page_type").isin("entry", "shutuba"), F.lit(False))
    return F.lit(False)


def derivable(field: str) -> Column:
    return F.col("race_number_derived").isNotNull() if field == "race_number" else F.lit(False)


def gap_kind(field: str) -> Column:
    """null, or why the field is missing: domain, derivable or true."""
    return kind_of_gap(is_missing(field), domain_allowed(field), derivable(field))


def kind_of_gap(missing: Column, allowed: Column, derived: Column) -> Column:
    return F.when(
        missing, F.when(allowed, F.lit("domain")).when(derived, F.lit("derivable")).otherwise(F.lit("true"))
    )


def required_level(field: str) -> str:
    if field in CORE_FIELDS:
        return "required"
    return "required_if_result" if field in RESULT_FIELDS else "important_warn"


def example_key() -> Column:
    return F.concat_ws(":", F.coalesce("race_id", F.lit("")), F.trim(F.coalesce("horse_id", F.lit(""))))


def group_missingness(
    df: DataFrame, required: Sequence[str] = CORE_FIELDS + RESULT_FIELDS, keys: Sequence[str] = GROUP_KEYS
) -> DataFrame:
    """Rows with any required field missing, by the value of each grouping key; one pass for all keys."""
    gap = F.lit(False)
    for f in required:
        gap = gap | is_missing(f)
    dims = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k), F.lit("")).alias("value")) for k in keys])
    return (
        df.select(gap.cast("int").alias("_gap"), F.explode(dims).alias("_d"))
        .groupBy(F.col("_d.key").alias("group_key"), F.col("_d.value").alias("group_value"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_gap").alias("n_missing"))
        .withColumn("missing_rate", F.round(F.col("n_missing") / F.col("n_rows"), 6))
    )


def reason_breakdown(df: DataFrame, keys: Sequence[str], priority: str = "priority") -> DataFrame:
    """Counts per combination, with the total of its priority, largest first."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    total = counted.groupBy(priority).agg(F.sum("count").alias("priority_total"))
    return counted.join(total, priority).orderBy(F.desc("count"), *keys)
