"""Audits of text rows at several grains from one pass.

``audit_grains`` reads the rows once and keeps one small row of counters per (race, horse, number). What an
audit asks of rows, horses, races and the whole table is a sum over that table, so the audit frame, which is
often a join, is never built a second time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions.text import int_or_null, number_or_null
from furlong.operators.joins import top_per_group
from furlong.operators.skew import with_row
from furlong.operators.stats import (
    CORE_FIELDS,
    IMPORTANT_FIELDS,
    RESULT_FIELDS,
    derivable,
    domain_allowed,
    example_key,
    is_missing,
    kind_of_gap,
    required_level,
)
from furlong.session import shared_dir

FIELDS = CORE_FIELDS + RESULT_FIELDS + IMPORTANT_FIELDS
KINDS = ("domain", "derivable", "true")
# The column that names the key which supplied a field.
ALIAS_SOURCES = {"race_number": "race_number_source"}
ROW_CHECKS = ("finish_position_range", "race_date_out_of_target_period", "odds_non_numeric", "popularity_non_numeric")


def _kinds(field: str) -> list[str]:
    """The kinds of gap that a field can have."""
    allowed = ["domain"] if field in RESULT_FIELDS else []
    return [*allowed, *(["derivable"] if field == "race_number" else []), "true"]


def alias_of(field: str, source: str) -> Column:
    """The key that supplied a field which is not missing, where that is not the field itself; else null."""
    named = F.coalesce(F.col(source).cast("string"), F.lit(""))
    return F.when(~is_missing(field) & ~named.isin("", field), named)


def _missing_bits(fields: Sequence[str]) -> Column:
    """One number with the bit of each missing field set, that of the first field last."""
    cells = F.array(*[F.col(f).cast("string") for f in reversed(fields)])
    is_gone = lambda v: F.coalesce(F.trim(v) == "", F.lit(True))
    return F.aggregate(cells, F.lit(0).cast("bigint"), lambda bits, v: bits * 2 + is_gone(v).cast("bigint"))


def audit_grains(
    rows: DataFrame, first_day: str = "", last_day: str = "99999999", aliases: Mapping[str, str] = ALIAS_SOURCES
) -> DataFrame:
    """The grains of rows (see counted_grains), written once to the shared folder."""
    path = shared_dir(rows.sparkSession, "audit")
    counted_grains(rows, first_day, last_day, aliases).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def counted_grains(rows: DataFrame, first_day: str, last_day: str, aliases: Mapping[str, str] = ALIAS_SOURCES) -> DataFrame:
    """Counters per (race_id, horse, number, alias) and set of flags.

    horse is the trimmed id, '' if missing; number is null if missing; an alias column is left out if the rows
    do not have it. The counters are combined before the shuffle, so a race or a missing id that holds a large share
    of all rows costs each task one row per number and set of flags. Flags are bits of two numbers and are told apart
    after the grouping: with a column for each, the loop over the joined rows is too long for the JVM to compile.
    """
    finish = int_or_null(F.col("finish_position"))
    checks = {
        "finish_position_range": ~finish.between(1, 30),
        "race_date_out_of_target_period": ~F.col("race_date").between(first_day, last_day),
        "odds_non_numeric": ~is_missing("odds") & number_or_null(F.col("odds")).isNull(),
        "popularity_non_numeric": ~is_missing("popularity") & number_or_null(F.col("popularity")).isNull(),
    }
    known = {f: s for f, s in aliases.items() if s in rows.columns}
    flags = {
        **checks,
        **{f"{f}__domain": domain_allowed(f) for f in FIELDS if "domain" in _kinds(f)},
        **{f"{f}__derivable": derivable(f) for f in FIELDS if "derivable" in _kinds(f)},
    }
    noted = rows.select(
        "race_id",
        F.trim(F.coalesce("horse_id", F.lit(""))).alias("horse"),
        F.when(~is_missing("horse_number"), F.col("horse_number")).alias("number"),
        example_key().alias("key"),
        *[(alias_of(f, known[f]) if f in known else F.lit(None).cast("string")).alias(f"alias__{f}") for f in aliases],
        _missing_bits(FIELDS).alias("missing"),
        sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(flags.values())), F.lit(0)).alias("flags"),
    )
    keys = ["race_id", "horse", "number", "key", *[f"alias__{f}" for f in aliases]]
    n = F.col("n")
    gone = {f: F.getbit("missing", F.lit(k)) == 1 for k, f in enumerate(FIELDS)}
    flag = {c: F.getbit("flags", F.lit(k)) == 1 for k, c in enumerate(flags)}
    kind = {
        f: kind_of_gap(gone[f], flag.get(f"{f}__domain", F.lit(False)), flag.get(f"{f}__derivable", F.lit(False)))
        for f in FIELDS
    }
    return noted.groupBy(*keys, "missing", "flags").agg(F.count(F.lit(1)).alias("n")).select(
        *keys,
        "n",
        (~(gone["finish_position"] & gone["result_time"] & gone["margin"])).cast("int").alias("result"),
        (~gone["sire"]).cast("int").alias("bred"),
        *[F.when(flag[c], n).otherwise(0).alias(c) for c in checks],
        *[F.when(kind[f] == k, n).otherwise(0).alias(f"{f}__{k}") for f in FIELDS for k in _kinds(f)],
    )


def alias_candidates(grains: DataFrame) -> DataFrame:
    """(column, source, rows): the other keys that supplied a field, and how many rows each did."""
    fields = [c.removeprefix("alias__") for c in grains.columns if c.startswith("alias__")]
    named = F.array(*[F.struct(F.lit(f).alias("column"), F.col(f"alias__{f}").alias("source")) for f in fields])
    return (
        grains.select("n", F.explode(named).alias("a"))
        .filter(F.col("a.source").isNotNull())
        .groupBy("a.column", "a.source")
        .agg(F.sum("n").alias("rows"))
    )


def gap_examples(grains: DataFrame, examples: int = 5) -> DataFrame:
    """The smallest keys of each (column, kind) with such a gap, joined by commas.

    Keys are made unique before they are listed by column, and the cut to a few applies in each task.
    """
    listed = F.array(
        *[
            F.when(F.col(f"{f}__{k}") > 0, F.struct(F.lit(f).alias("column"), F.lit(k).alias("kind")))
            for f in FIELDS
            for k in _kinds(f)
        ]
    )
    gaps = [F.max(f"{f}__{k}").alias(f"{f}__{k}") for f in FIELDS for k in _kinds(f)]
    keys = grains.groupBy("key").agg(*gaps).select("key", F.explode(F.array_compact(listed)).alias("g"))
    return (
        top_per_group(keys.select("key", "g.*"), ["column", "kind"], [F.col("key")], examples)
        .groupBy("column", "kind")
        .agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("examples"))
    )


def column_missingness(grains: DataFrame, examples: int = 5) -> DataFrame:
    """Per field: missing, allowed, derivable and truly missing rows, severity, example keys, alias names.

    grains come from audit_grains. An empty table has no rate (null) and nothing to fail.
    """
    sums = [F.coalesce(F.sum(f"{f}__{k}"), F.lit(0)).alias(f"{f}__{k}") for f in FIELDS for k in _kinds(f)]
    wide = grains.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), F.max("result").alias("has_results"), *sums)
    per_field = F.array(
        *[
            F.struct(
                F.lit(f).alias("column"),
                F.lit(required_level(f)).alias("required_level"),
                *[(F.col(f"{f}__{k}") if k in _kinds(f) else F.lit(0).cast("bigint")).alias(k) for k in KINDS],
            )
            for f in FIELDS
        ]
    )
    long = wide.select("total_count", "has_results", F.explode(per_field).alias("x")).select(
        "total_count", "has_results", "x.*"
    )
    missing = F.col("domain") + F.col("derivable") + F.col("true")
    result = F.coalesce(F.col("has_results") == 1, F.lit(False))
    severity = (
        F.when(
            F.col("required_level") == "required",
            F.when(F.col("true") > 0, "fail").when(missing > 0, "warn").otherwise("pass"),
        )
        .when(
            F.col("required_level") == "required_if_result",
            F.when(result & (F.col("true") > 0), "fail").when(result & (missing > 0), "warn").otherwise("pass"),
        )
        .otherwise(F.when(F.col("true") > 0.1 * F.col("total_count"), "warn").otherwise("pass"))
    )
    shown = gap_examples(grains, examples).groupBy("column").pivot("kind", list(KINDS)).agg(F.first("examples"))
    shown = shown.select("column", *[F.col(k).alias(f"{k}_keys") for k in KINDS])
    named = alias_candidates(grains).groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_list("source")), ",").alias("alias_candidate"),
        F.count(F.lit(1)).alias("alias_count"),
        F.sum("rows").alias("alias_rows"),
    )
    total = F.nullif(F.col("total_count"), F.lit(0))
    return (
        long.join(shown, "column", "left")
        .join(named, "column", "left")
        .select(
            "column",
            "required_level",
            "total_count",
            missing.alias("missing_count"),
            F.col("domain").alias("domain_allowed_count"),
            F.col("derivable").alias("derivable_count"),
            F.col("true").alias("true_missing_count"),
            F.round(missing / total, 6).alias("missing_rate"),
            F.round(F.col("true") / total, 6).alias("true_missing_rate"),
            severity.alias("severity"),
            F.coalesce("true_keys", F.lit("")).alias("example_keys"),
            F.coalesce("domain_keys", F.lit("")).alias("domain_example_keys"),
            F.coalesce("derivable_keys", F.lit("")).alias("derivable_example_keys"),
            F.coalesce("alias_candidate", F.lit("")).alias("alias_candidate"),
            F.coalesce("alias_count", F.lit(0)).alias("alias_count"),
            F.coalesce("alias_rows", F.lit(0)).alias("alias_rows"),
        )
    )


# Names and levels of the checks.
CHECKS = {
    "race_id_duplicate": "fail",
    "horse_id_missing": "fail",
    "horse_id_duplicate_in_race": "fail",
    "horse_number_duplicate_in_race": "fail",
    "finish_position_range": "fail",
    "starters_per_race_range": "fail",
    "race_date_out_of_target_period": "fail",
    "venue_empty": "fail",
    "odds_non_numeric": "warn",
    "popularity_non_numeric": "warn",
    "race_without_horse_data": "fail",
    "horse_without_pedigree": "warn",
    "required_column_missing_rate_over_0pct": "fail",
    "important_column_missing_over_10pct": "warn",
}


def _flag(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))


def consistency_checks(races: DataFrame, grains: DataFrame, missingness: DataFrame) -> DataFrame:
    """Fourteen checks: (name, level, failed_count, status, verdict).

    races has race_id, grains are the audit_grains of the rows (which hold the period), missingness is the
    column_missingness of the same grains. Races come from one list of (race, horse) and (race, number) pairs.
    """
    has_horse = F.col("horse") != ""
    venue = sum((F.col(f"venue__{k}") for k in _kinds("venue")), F.lit(0))
    per_row = grains.agg(
        F.coalesce(F.sum(F.when(~has_horse, F.col("n"))), F.lit(0)).alias("horse_id_missing"),
        F.coalesce(F.sum(venue), F.lit(0)).alias("venue_empty"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ROW_CHECKS],
    )
    dup_races = races.groupBy("race_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("race_id_duplicate")
    )
    values = F.array_compact(
        F.array(
            F.when(has_horse, F.struct(F.lit("horse").alias("kind"), F.col("horse").alias("value"))),
            F.when(F.col("number").isNotNull(), F.struct(F.lit("number").alias("kind"), F.col("number").alias("value"))),
        )
    )
    pairs = (
        grains.select("race_id", "n", F.explode(values).alias("v"))
        .groupBy("race_id", "v.kind", "v.value")
        .agg(F.sum("n").alias("n"))
    )
    horse = F.col("kind") == "horse"
    per_race = (
        pairs.groupBy("race_id")
        .agg(
            F.sum(F.when(horse, F.col("n") - 1)).alias("repeats"),
            F.count(F.when(horse, 1)).alias("starters"),
            F.max(F.when(~horse, F.col("n"))).alias("most"),
        )
        .agg(
            F.coalesce(F.sum("repeats"), F.lit(0)).alias("horse_id_duplicate_in_race"),
            _flag(F.col("most") > 1).alias("horse_number_duplicate_in_race"),
            _flag((F.col("starters") > 30)).alias("starters_per_race_range"),
        )
    )
    empty = races.join(grains.select("race_id"), "race_id", "left_anti").agg(
        F.count(F.lit(1)).alias("race_without_horse_data")
    )
    pedigree = (
        grains.filter(has_horse)
        .groupBy("horse")
        .agg(F.max("bred").alias("known"))
        .agg(_flag(F.col("known") == 0).alias("x"), F.count(F.lit(1)).alias("n"))
        .select(F.when(F.col("x") > 0.2 * F.col("n"), F.col("x")).otherwise(0).alias("horse_without_pedigree"))
    )
    columns = missingness.agg(
        _flag(F.col("required_level").startswith("required") & (F.col("true_missing_count") > 0)).alias(
            "required_column_missing_rate_over_0pct"
        ),
        _flag((F.col("required_level") == "important_warn") & (F.col("true_missing_rate") > 0.1)).alias(
            "important_column_missing_over_10pct"
        ),
    )
    wide = per_row
    for part in (dup_races, per_race, empty, pedigree, columns):
        wide = with_row(wide, part)
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(lev).alias("level"), F.col(n).cast("bigint").alias("failed_count"))
            for n, lev in CHECKS.items()
        ]
    )
    status = lambda x: F.when(x["failed_count"] == 0, F.lit("pass")).otherwise(x["level"])
    worst = F.transform("checks", status)
    verdict = (
        F.when(F.array_contains(worst, "fail"), "fail").when(F.array_contains(worst, "warn"), "warn").otherwise("pass")
    )
    return (
        wide.select(listed.alias("checks"))
        .withColumn("verdict", verdict)
        .select("verdict", F.explode("checks").alias("c"))
        .select("c.*", status(F.col("c")).alias("status"), "verdict")
    )


# Checks of first priority.
P0_CHECKS = ["race_without_horse_data", "horse_id_missing", "race_id_duplicate"]


def audit_reasons(missingness: DataFrame, checks: DataFrame, priority: Column) -> DataFrame:
    """What an audit found, one row per reason and column: count, severity, priority, example keys.

    priority is that of a truly missing field, over ``column``. An alias counts the keys it came from, not rows.
    """

    def found(reason: str, count: str, severity: Column, rank: Column, keys: str) -> Column:
        return F.when(
            F.col(count) > 0,
            F.struct(
                F.lit(reason).alias("reason"), F.col(count).cast("bigint").alias("count"), severity.alias("severity"),
                rank.alias("priority"), F.col(keys).alias("example_keys"),
            ),
        )

    each = F.array(
        found("true-missing", "true_missing_count", F.col("severity"), priority, "example_keys"),
        found("domain-allowed-missing", "domain_allowed_count", F.lit("info"), F.lit("Domain allowed"), "domain_example_keys"),
        found("derived-field-candidate", "derivable_count", F.lit("warn"), F.lit("Schema review"), "derivable_example_keys"),
        found("alias-candidate", "alias_count", F.lit("warn"), F.lit("Schema review"), "alias_candidate"),
    )
    gaps = missingness.select("column", "required_level", F.explode(F.array_compact(each)).alias("f")).select(
        "f.reason", "column", "required_level", "f.count", "f.severity", "f.priority", "f.example_keys"
    )
    failed = checks.filter((F.col("failed_count") > 0) & F.col("status").isin("fail", "warn")).select(
        F.concat(F.lit("consistency:"), "name").alias("reason"),
        F.lit("(check)").alias("column"),
        F.lit("consistency").alias("required_level"),
        F.col("failed_count").alias("count"),
        F.col("status").alias("severity"),
        F.when(F.col("name").isin(P0_CHECKS), "P0").otherwise("P1").alias("priority"),
        F.lit("").alias("example_keys"),
    )
    return gaps.unionByName(failed)


def fail_reasons(missingness: DataFrame, checks: DataFrame) -> DataFrame:
    """(reason, count) of what makes an audit fail: required fields that are truly missing, and failed checks."""
    fields = missingness.filter(
        F.col("required_level").isin("required", "required_if_result") & (F.col("true_missing_count") > 0)
    ).select(F.concat(F.lit("required:"), "column").alias("reason"), F.col("true_missing_count").alias("count"))
    return fields.unionByName(
        checks.filter(F.col("status") == "fail").select(
            F.concat(F.lit("check:"), "name").alias("reason"), F.col("failed_count").alias("count")
        )
    ).orderBy(F.desc("count"), "reason")
