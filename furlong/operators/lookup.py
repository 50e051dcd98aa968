"""Sorted reads: latest races, cards, bundles, top scores, samples, and one-per-key choices."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.joins import top_per_group
from furlong.operators.skew import with_row


def recent(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def race_card(df: DataFrame, fields: Sequence[str], race: str = "race_id", number: str = "runner_no", only=None) -> DataFrame:
    """Runners in card order, of one race or of all."""
    rows = df if only is None else df.filter(F.col(race) == only)
    return rows.select(race, number, *fields).orderBy(race, number, *fields)


def race_bundle(
    races: DataFrame, children: Mapping[str, tuple[DataFrame, Sequence[str]]], race: str, parts: int = 1
) -> DataFrame:
    """Race with each child table as a sorted array of structs, empty where there is none.

    One row for each race and part 0 .. parts - 1, at any size. Where a race may have more children
    than an array should hold, ask for more parts; children are dealt to them by a hash of their fields.
    """
    out = races.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    for name, (df, fields) in children.items():
        part = F.pmod(F.xxhash64(*fields), F.lit(parts)).cast("int").alias("part")
        grouped = df.groupBy(race, part).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(grouped, [race, "part"], "left").withColumn(
            name, F.coalesce(F.col(name), F.array().cast(grouped.schema[name].dataType))
        )
    return out


def score_topk(df: DataFrame, race: str, score: str, ties: Sequence[str], k: int, out: str = "position") -> DataFrame:
    return top_per_group(df, [race], [F.desc(score), *[F.col(t) for t in ties]], k, out)


def sample_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int, out: str = "sample_no") -> DataFrame:
    """First n rows of each group in a complete order."""
    return top_per_group(df, groups, [F.col(c) for c in order], n, out)


def split_bets(df: DataFrame, done: Column, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Pending and completed bets, each sorted; a bet of unknown state is pending."""
    completed = F.coalesce(done, F.lit(False))
    return df.filter(~completed).orderBy(*order), df.filter(completed).orderBy(*order)


def dedupe_priority(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by (priority, source order, values); combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


# ---- contract of a document table -------------------------------------------

# JSON types that satisfy a declared type.
COMPATIBLE = {"int": ["int"], "float": ["int", "float"], "str": ["str"], "bool": ["bool"]}


def json_kind(value: Column) -> Column:
    """Type of a variant value in the words of a contract."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "VOID", F.lit("null"))
        .when(t == "BIGINT", F.lit("int"))
        .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit("float"))
        .when(t == "STRING", F.lit("str"))
        .when(t == "BOOLEAN", F.lit("bool"))
        .otherwise(F.lit("nested"))
    )


def plain_name(c: Column) -> Column:
    """Field names agree without regard to punctuation and case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def contract_check(docs: DataFrame, data: str, expected: Mapping[str, str]) -> DataFrame:
    """Per field, declared or found: documents without it, of a wrong type, and null.

    (field, expected_type, present, missing, wrong_type, unknown, status)
    """
    spark = docs.sparkSession
    parsed = docs.select(F.try_parse_json(data).alias("_v"))
    total = docs.agg(F.count(F.lit(1)).alias("_total"))
    found = (
        parsed.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        .select(plain_name(F.col("key")).alias("field"), json_kind(F.col("value")).alias("kind"))
        .groupBy("field")
        .agg(
            F.count(F.lit(1)).alias("present"),
            *[
                F.sum((F.col("kind") == k).cast("int")).alias(f"_{k}")
                for k in ("int", "float", "str", "bool", "null")
            ],
        )
    )
    declared = functools.reduce(
        DataFrame.unionByName,
        [
            spark.range(1).select(F.lit(n).alias("_f"), F.lit(t).alias("expected_type"))
            for n, t in expected.items()
        ],
    ).select(plain_name(F.col("_f")).alias("field"), "expected_type")
    right = F.lit(0)
    for t, kinds in COMPATIBLE.items():
        right = F.when(
            F.col("expected_type") == t, sum((F.col(f"_{k}") for k in kinds[1:]), F.col(f"_{kinds[0]}"))
        ).otherwise(right)
    joined = with_row(found.join(declared, "field", "full_outer"), total)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    wrong = zero(F.col("present")) - zero(F.col("_null")) - zero(right)
    out = joined.select(
        "field",
        "expected_type",
        zero(F.col("present")).alias("present"),
        (F.col("_total") - zero(F.col("present"))).alias("missing"),
        F.when(F.col("expected_type").isNotNull(), wrong).alias("wrong_type"),
        zero(F.col("_null")).alias("unknown"),
    )
    status = (
        F.when(F.col("expected_type").isNull(), F.lit("extra"))
        .when(F.col("present") == 0, F.lit("missing"))
        .when(F.col("wrong_type") > 0, F.lit("type-mismatch"))
        .when((F.col("missing") > 0) | (F.col("unknown") > 0), F.lit("incomplete"))
        .otherwise(F.lit("ok"))
    )
    return out.withColumn("status", status)
