"""Checks that decide which races and rows may be used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions.text import int_or_null, number_or_null, version_key
from furlong.operators.skew import column_value_counts, quantiles, stored_ranges
from furlong.operators.stats import (
    CORE_FIELDS,
    IMPORTANT_FIELDS,
    RESULT_FIELDS,
    domain_allowed,
    is_missing,
)

NULL_SHARE_ERROR = 0.8


def race_gate(
    df: DataFrame,
    race: str = "race_id",
    distance: str = "distance",
    odds: str = "odds",
    popularity: str = "popularity",
    venue: str = "venue",
    name: str = "horse_name",
) -> DataFrame:
    """Issues per race: (race, issue_code, field, severity).

    Q1 no usable distance at all, Q2 odds missing, Q3 distance or venue differs inside
    the race, Q4 blank names, Q5 popularity missing.
    """

    def varies(c):
        return F.min(F.col(c).cast("string")) < F.max(F.col(c).cast("string"))

    n = F.count(F.lit(1))
    s = df.groupBy(race).agg(
        F.max(F.coalesce(F.col(distance) > 0, F.lit(False))).alias("any_distance"),
        ((n - F.count(odds)) / n).alias("odds_null"),
        varies(distance).alias("distance_varies"),
        varies(venue).alias("venue_varies"),
        F.max(is_missing(name)).alias("blank_name"),
        ((n - F.count(popularity)) / n).alias("pop_null"),
    )

    def issue(cond: Column, code: str, field: str, severity: Column):
        return F.when(
            cond,
            F.struct(F.lit(code).alias("issue_code"), F.lit(field).alias("field"), severity.alias("severity")),
        )

    error, warning = F.lit("ERROR"), F.lit("WARNING")
    issues = F.array(
        issue(~F.col("any_distance"), "Q1", "distance", error),
        issue(
            F.col("odds_null") > 0,
            "Q2",
            "odds",
            F.when(F.col("odds_null") >= NULL_SHARE_ERROR, error).otherwise(warning),
        ),
        issue(F.col("distance_varies"), "Q3", "distance", error),
        issue(F.col("venue_varies"), "Q3", "venue", error),
        issue(F.col("blank_name"), "Q4", "horse_name", warning),
        issue(F.col("pop_null") >= NULL_SHARE_ERROR, "Q5", "popularity", error),
    )
    return s.select(race, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i")).select(race, "i.*")


def filter_valid(df: DataFrame, race: str = "race_id", before_race: bool = False, **columns) -> DataFrame:
    """Rows of races without an error; before a race, missing odds and popularity are no error."""
    bad = race_gate(df, race, **columns).filter(F.col("severity") == "ERROR")
    if before_race:
        bad = bad.filter(~F.col("issue_code").isin("Q2", "Q5"))
    return df.join(bad.select(race).distinct(), race, "left_anti")


def psi_drift(
    train: DataFrame, infer: DataFrame, columns: Sequence[str], threshold: float = 0.2, bins: int = 10, least: int = 11
) -> DataFrame:
    """Drift of each column between two sets: missing shares, medians, population stability index.

    The bins are the quantiles of the training set. Both sets are reduced to counts per
    distinct value, stored in ranges, before anything is compared. A column with fewer than
    ``least`` known values in training, or none to compare, has no index (null) and no flag for it.
    """
    eps = F.lit(1e-8)
    both = train.select(F.lit("t").alias("_set"), *columns).unionByName(infer.select(F.lit("i").alias("_set"), *columns))
    counts = stored_ranges(column_value_counts(both, columns, also=["_set"]), ["_set", "column"])
    rows = both.agg(
        F.sum((F.col("_set") == "t").cast("bigint")).alias("_rows_t"),
        F.sum((F.col("_set") == "i").cast("bigint")).alias("_rows_i"),
    )
    probs = [i / bins for i in range(bins + 1)]
    both_q = quantiles(counts, [*probs, 0.5], ["_set", "column"])
    t_q = both_q.filter("_set = 't'")
    raw = F.slice("q", 1, bins + 1)
    edges = F.array_distinct(
        F.concat(F.array(raw[0] - eps), F.slice(raw, 2, bins - 1), F.array(F.element_at(raw, -1) + eps))
    )
    t_stats = t_q.select(
        "column", edges.alias("_edges"), F.element_at("q", -1).alias("train_median"), F.col("total").alias("_n_t")
    )
    i_stats = both_q.filter("_set = 'i'").select(
        "column", F.element_at("q", -1).alias("infer_median"), F.col("total").alias("_n_i")
    )
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    binned = (
        counts.join(F.broadcast(t_stats.select("column", "_edges")), "column")
        .filter((F.col("value") >= F.element_at("_edges", 1)) & (F.col("value") <= F.element_at("_edges", -1)))
        .withColumn("_bin", F.size(F.filter(inner, lambda e: e <= F.col("value"))))
        .groupBy("column", "_bin")
        .agg(
            F.sum(F.when(F.col("_set") == "t", F.col("n")).otherwise(0)).alias("_t"),
            F.sum(F.when(F.col("_set") == "i", F.col("n")).otherwise(0)).alias("_i"),
        )
    )
    every = t_stats.select("column", F.explode(F.sequence(F.lit(0), F.size("_edges") - 2)).alias("_bin"))
    filled = every.join(binned, ["column", "_bin"], "left").na.fill(0, ["_t", "_i"])
    total = Window.partitionBy("column")

    def share(c):
        s = F.col(c) / (F.sum(c).over(total) + eps)
        return F.when(s == 0, eps).otherwise(s)

    psi = (
        filled.select("column", share("_t").alias("e"), share("_i").alias("a"))
        .groupBy("column")
        .agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("_psi"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    base = rows.select("*", F.explode(names).alias("column"))
    t_miss = 1 - F.coalesce("_n_t", F.lit(0)) / F.col("_rows_t")
    i_miss = 1 - F.coalesce("_n_i", F.lit(0)) / F.col("_rows_i")
    usable = (F.coalesce("_n_t", F.lit(0)) >= least) & (F.coalesce("_n_i", F.lit(0)) > 0)
    value = F.when(usable, F.col("_psi"))
    return (
        base.join(t_stats, "column", "left")
        .join(i_stats, "column", "left")
        .join(psi, "column", "left")
        .select(
            F.col("column").alias("feature"),
            F.round(t_miss * 100, 1).alias("train_missing_pct"),
            F.round(i_miss * 100, 1).alias("infer_missing_pct"),
            F.round(F.abs(i_miss - t_miss) * 100, 1).alias("missing_drift"),
            F.round("train_median", 4).alias("train_median"),
            F.round("infer_median", 4).alias("infer_median"),
            F.round(value, 4).alias("psi"),
            ((F.abs(i_miss - t_miss) > 0.2) | F.coalesce(value >= threshold, F.lit(False))).cast("int").alias("drift_flag"),
        )
    )


# ---- quality of one row -----------------------------------------------------

CURRENT_PARSER = "2.0.0"
# Answers that mean the page is not the wanted one.
ERROR_STATUS = [403, 404, 429, 500, 503]


def row_quality(df: DataFrame, now: str, stale_days: int = 30, parser: str = CURRENT_PARSER) -> DataFrame:
    """Score, missing fields and stale flags of audit rows; ``now`` is given as a timestamp text."""
    has_result = ~is_missing("finish_position") | ~is_missing("result_time")

    def wanted(f):
        return has_result if f in RESULT_FIELDS else F.lit(True)

    fields = CORE_FIELDS + RESULT_FIELDS
    gap = {f: is_missing(f) & wanted(f) for f in fields}
    allowed = {f: gap[f] & domain_allowed(f) for f in RESULT_FIELDS}
    derived = gap["race_number"] & F.col("race_number_derived").isNotNull()
    true_gap = {f: gap[f] & ~allowed.get(f, F.lit(False)) for f in fields}
    true_gap["race_number"] = gap["race_number"] & ~derived

    def names(conds):
        listed = F.array(*[F.when(c, F.lit(f)) for f, c in conds.items()])
        return F.filter(listed, lambda x: x.isNotNull())

    invalid = (~is_missing("odds") & number_or_null(F.col("odds")).isNull()) | (
        ~is_missing("popularity") & number_or_null(F.col("popularity")).isNull()
    )
    fetched = F.try_to_timestamp("fetched_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    limit = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {max(1, stale_days)} DAYS")
    important = sum((is_missing(f).cast("int") for f in IMPORTANT_FIELDS), F.lit(0))
    error = (F.coalesce(F.col("is_error_page"), F.lit(0)) != 0) | F.coalesce(
        int_or_null(F.col("http_status")).isin(ERROR_STATUS), F.lit(False)
    )
    assessed = df.withColumns(
        {
            "missing_fields": names(true_gap),
            "domain_allowed_fields": names(allowed),
            "schema_review": derived,
            "important_missing": important,
            "invalid_value": invalid,
            "stale_parser": F.coalesce(
                version_key(F.col("parser_version")) < version_key(F.lit(parser)), F.lit(False)
            )
            & (F.coalesce("parser_version", F.lit("")) != ""),
            "stale_fetch": F.coalesce(fetched < limit, F.lit(False)),
            "no_page": F.coalesce(F.col("source_html_present"), F.lit(0)) == 0,
            "error_page": error,
        }
    )
    penalty = (
        F.when(F.size("missing_fields") > 0, 35.0).otherwise(0.0)
        + F.when(F.col("schema_review"), 3.0).otherwise(0.0)
        + F.least(F.lit(25.0), F.col("important_missing") * 3.0)
        + F.when(F.col("invalid_value"), 20.0).otherwise(0.0)
        + F.when(F.col("no_page"), 10.0).otherwise(0.0)
        + F.when(F.col("error_page"), 25.0).otherwise(0.0)
    )
    return assessed.withColumn("required_missing", F.size("missing_fields") > 0).withColumn(
        "score", F.greatest(F.lit(0.0), 100.0 - penalty)
    )


# The fields that identify the content of a runner row, sorted.
HASH_FIELDS = sorted(CORE_FIELDS + RESULT_FIELDS + ["odds", "popularity", "parser_version"])


def record_hash(fields: Sequence[str] = HASH_FIELDS) -> Column:
    """SHA-1 of a JSON object with the fields in sorted order, missing ones as null."""
    return F.sha1(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


# Refresh policies.
POLICIES = ["skip-existing", "reparse-cache", "repair-missing", "refresh-stale", "force-refresh", "dry-run"]


def refresh_action(policy: str) -> tuple[Column, Column]:
    """Action and reason for an assessed row under a policy; needs a boolean column ``duplicate``."""
    broken = F.col("required_missing") | F.col("invalid_value")
    rules: list[tuple[Column, str, str]] = [(F.col("duplicate"), "quarantine", "duplicate-existing-record")]
    stale = [
        (F.col("stale_parser"), "reparse-cache", "stale-parser-version"),
        (F.col("stale_fetch"), "refetch", "stale-fetched-at"),
    ]
    if policy == "skip-existing":
        last = ("skip", "policy-skip-existing")
    elif policy == "reparse-cache":
        rules += stale[:1]
        last = ("skip", "no-stale-parser")
    elif policy in ("repair-missing", "dry-run"):
        rules += [
            (broken, "repair", "required-missing-or-invalid"),
            (F.col("schema_review"), "schema-review", "schema-mismatch-or-derived-candidate"),
            *stale,
        ]
        last = ("skip", "healthy-existing")
    elif policy == "refresh-stale":
        rules += stale
        last = ("skip", "fresh-existing")
    elif policy == "force-refresh":
        last = ("refetch", "policy-force-refresh")
    else:
        last = ("skip", "policy-default")

    def ladder(i):
        out = F.lit(last[i - 1])
        for rule in reversed(rules):
            out = F.when(rule[0], F.lit(rule[i])).otherwise(out)
        return out

    return ladder(1), ladder(2)


def with_duplicate_flag(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark the keys that occur more than once and keep one row of each key.

    Which row stays is decided by the row's values, not by the order of rows.
    """
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), F.max(F.struct(*rest)).alias("_row"))
    return one.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns],
        (F.col("_copies") > 1).alias("duplicate"),
    )


def no_downgrade(old: Mapping[str, Column], new: Mapping[str, Column]) -> tuple[Column, Column]:
    """Whether a candidate may replace an existing row, and why.

    Both sides give hash, score, and the candidate required_missing, error_page, no_page.
    """
    refusals = [
        (old["hash"] == new["hash"], "record-hash-same"),
        (new["required_missing"], "candidate-required-missing"),
        (new["error_page"] | new["no_page"], "candidate-error-or-empty-html"),
        (new["score"] < old["score"], "candidate-quality-lower-than-existing"),
    ]
    reason = F.lit("candidate-quality-acceptable")
    for cond, text in reversed(refusals):
        reason = F.when(cond, F.lit(text)).otherwise(reason)
    action = F.when(reason == "candidate-quality-acceptable", "update-candidate").otherwise("no-downgrade-skip")
    return action, reason
