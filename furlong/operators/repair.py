"""What to repair, from where, and what it costs. Plans cover every key, not samples of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions.pages import page_valid
from furlong.operators import quality as Q
from furlong.operators.audit import alias_of
from furlong.operators.joins import top_per_group
from furlong.operators.lookup import dedupe_priority
from furlong.operators.skew import with_row
from furlong.operators.stats import CORE_FIELDS, IMPORTANT_FIELDS, RESULT_FIELDS, gap_kind, is_missing

SECONDS_PER_REQUEST = 1.2

# Priorities by field.
P0_FIELDS = ["race_id", "horse_id", "finish_position"]
P1_FIELDS = ["result_time", "race_date", "venue", "horse_name", "frame_number", "horse_number"]
# What the first-priority plan covers.
P0_SCOPE = ["finish_position", "race_id", "horse_id", "race_date", "venue", "horse_name", "frame_number", "horse_number"]
P0_CHECKS = ["race_without_horse_data", "horse_id_missing", "required_column_missing_rate_over_0pct"]
# Fields by the page that shows them.
HORSE_FIELDS = ["horse_name", "frame_number", "horse_number"]
PEDIGREE_FIELDS = ["sire", "dam", "broodmare_sire"]
NO_RUNNERS = "consistency:race_without_horse_data"
# Row limits of the writer per target table and race.
ROW_LIMITS = {"races": 1, "race_results": 30, "race_payouts": 100}
UNKNOWN_SIRE = "unknown_local"


def priority(field: Column) -> Column:
    return (
        F.when(field.isin(P0_FIELDS), "P0")
        .when(field.isin(P1_FIELDS), "P1")
        .when(field.isin(IMPORTANT_FIELDS), "P2")
        .otherwise("P0")
    )


def refresh_decisions(
    existing: DataFrame,
    candidates: DataFrame,
    policy: str,
    now: str,
    stale_days: int = 30,
    keys: Sequence[str] = ("race_id", "horse_id"),
) -> DataFrame:
    """One decision per existing key: what the policy says, overruled by a candidate of the same key.

    Both inputs are audit rows. Of several rows of a key one is judged, chosen by its assessed values, not by the
    order of rows. Rows are assessed before they meet, so only what a decision reads is shuffled, once for both sides.
    """
    keys = list(keys)
    seen = ["hash", "score", "required_missing", "error_page", "no_page"]
    told = ["missing_fields", "domain_allowed_fields", "schema_review", "invalid_value", "stale_parser", "stale_fetch"]
    old_fields = [*seen, *told, "parser_version", "fetched_at"]

    def assessed(df: DataFrame, fields: Sequence[str]) -> DataFrame:
        rows = Q.row_quality(df.withColumn("hash", F.unhex(Q.record_hash())), now, stale_days)
        return rows.select(*keys, F.struct(*fields).alias("_row"))

    old, new = assessed(existing, old_fields), assessed(candidates, seen)
    none = [F.lit(None).cast(df.schema["_row"].dataType) for df in (old, new)]
    both = old.select(*keys, F.col("_row").alias("_old"), none[1].alias("_new")).unionByName(
        new.select(*keys, none[0].alias("_old"), F.col("_row").alias("_new"))
    )
    met = both.groupBy(*keys).agg(F.count("_old").alias("_copies"), F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    one = met.filter(F.col("_copies") > 0).select(
        *keys, "_old.*", *[F.col(f"_new.{c}").alias(f"new_{c}") for c in seen], (F.col("_copies") > 1).alias("duplicate")
    )
    act, why = Q.refresh_action(policy)
    nd_act, nd_why = Q.no_downgrade(
        {c: F.col(c) for c in ("hash", "score")}, {c: F.col(f"new_{c}") for c in seen}
    )
    has_new = F.col("new_hash").isNotNull()
    refused = has_new & (nd_act == "no-downgrade-skip")
    taken = has_new & (nd_act == "update-candidate") & F.col("_act").isin("refetch", "repair", "reparse-cache")
    return (
        one.withColumns({"_act": act, "_why": why})
        .withColumns(
            {
                "action": F.when(refused, nd_act).when(taken, F.lit("update-candidate")).otherwise(F.col("_act")),
                "reason": F.when(refused, nd_why)
                .when(taken, F.lit("candidate-quality-acceptable"))
                .otherwise(F.col("_why")),
            }
        )
        .select(
            *keys,
            "action",
            "reason",
            "score",
            "missing_fields",
            "domain_allowed_fields",
            "schema_review",
            "invalid_value",
            "parser_version",
            "fetched_at",
        )
    )


def refresh_breakdown(decisions: DataFrame) -> DataFrame:
    """Counts by (action, reason, column, priority); a row to repair counts once per missing field."""
    row = F.array(F.lit("(row)"))
    repair = F.when(F.size("missing_fields") > 0, F.col("missing_fields")).otherwise(
        F.array(F.when(F.col("invalid_value"), F.lit("(invalid-value)")).otherwise(F.lit("(repair)")))
    )
    act = F.col("action")
    only_allowed = ~act.isin("repair", "schema-review") & (F.size("domain_allowed_fields") > 0)
    columns = (
        F.when(act == "repair", repair)
        .when(act == "schema-review", F.array(F.lit("race_number")))
        .when(only_allowed, F.col("domain_allowed_fields"))
        .otherwise(row)
    )
    rank = (
        F.when(F.col("action") == "repair", priority(F.col("column")))
        .when(F.col("action") == "schema-review", F.lit("Schema review"))
        .when(F.col("action") == "refetch", F.lit("P0"))
        .when(F.col("action") == "reparse-cache", F.lit("P1"))
        .otherwise(F.lit("Domain allowed"))
    )
    return (
        decisions.select(
            F.when(only_allowed, F.lit("no-action")).otherwise(act).alias("action"),
            F.when(only_allowed, F.lit("domain-allowed-missing")).otherwise(F.col("reason")).alias("reason"),
            F.explode(columns).alias("column"),
        )
        .withColumn("priority", rank)
        .groupBy("action", "reason", "column", "priority")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "action", "reason", "column")
    )


def refresh_totals(
    decisions: DataFrame, expected_races: DataFrame, policy: str, seconds: float = SECONDS_PER_REQUEST
) -> DataFrame:
    """One row: actions, priorities of repairs, missing races, requests and run time."""
    act = F.col("action")

    def n(cond):
        return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))

    ranks = F.transform("missing_fields", lambda f: priority(f))
    p0 = (act == "repair") & (
        F.array_contains(ranks, "P0") | ((F.size("missing_fields") == 0))
    )
    p1 = (act == "repair") & ~p0 & F.array_contains(ranks, "P1")
    counted = decisions.agg(
        F.count(F.lit(1)).alias("existing_count"),
        n(act == "skip").alias("skip_count"),
        n(act == "reparse-cache").alias("reparse_count"),
        n(act == "refetch").alias("_refetch"),
        n(act == "update-candidate").alias("update_candidate_count"),
        n(act == "repair").alias("repair_count"),
        n(p0).alias("repair_count_p0"),
        n(p1).alias("repair_count_p1"),
        n(
            (act == "quarantine")
            | F.col("reason").isin("candidate-required-missing", "candidate-error-or-empty-html")
        ).alias("quarantine_count"),
        n(act == "no-downgrade-skip").alias("no_downgrade_skip_count"),
        n(act == "schema-review").alias("schema_review_count"),
        F.coalesce(F.sum(F.size("domain_allowed_fields")), F.lit(0)).alias("domain_allowed_missing_count"),
    )
    absent = expected_races.join(decisions.select("race_id"), "race_id", "left_anti").agg(
        F.count(F.lit(1)).alias("missing_count")
    )
    refetch = F.col("_refetch") + (F.lit(0) if policy == "skip-existing" else F.col("missing_count"))
    requests = F.col("refetch_count") + F.greatest(
        F.lit(0), F.col("repair_count") - F.col("update_candidate_count")
    )
    return (
        with_row(counted, absent)
        .withColumn("refetch_count", refetch)
        .withColumn("estimated_http_request_count", requests)
        .withColumn("estimated_runtime", F.round(F.col("estimated_http_request_count") * F.lit(seconds), 1))
        .drop("_refetch")
    )


def gap_records(rows: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Every gap of every audit row: (race_id, horse_id, column, reason, priority).

    aliases names, for each field, the column with the key that supplied it; a value that came from
    another key is a record too (see audit.ALIAS_SOURCES).
    """
    fields = CORE_FIELDS + RESULT_FIELDS + IMPORTANT_FIELDS
    found = [F.struct(F.lit(f).alias("column"), gap_kind(f).alias("kind")) for f in fields]
    for f, source in (aliases or {}).items():
        found.append(F.struct(F.lit(f).alias("column"), F.when(alias_of(f, source).isNotNull(), "alias").alias("kind")))
    kinds = F.array(*found)
    reason = (
        F.when(F.col("g.kind") == "domain", "domain-allowed-missing")
        .when(F.col("g.kind") == "derivable", "derived-field-candidate")
        .when(F.col("g.kind") == "alias", "alias-candidate")
        .otherwise("true-missing")
    )
    rank = (
        F.when(F.col("g.kind") == "domain", F.lit("Domain allowed"))
        .when(F.col("g.kind").isin("derivable", "alias"), F.lit("Schema review"))
        .otherwise(priority(F.col("g.column")))
    )
    return rows.select(
        "race_id", "horse_id", F.explode(F.filter(kinds, lambda k: k["kind"].isNotNull())).alias("g")
    ).select("race_id", "horse_id", "g.column", reason.alias("reason"), rank.alias("priority"))


def in_p0_scope() -> Column:
    reason, column = F.col("reason"), F.col("column")
    check = F.regexp_extract(reason, "^consistency:(.*)$", 1)
    return (
        F.when(reason == "domain-allowed-missing", column == "margin")
        .when(F.col("priority") == "P0", F.lit(True))
        .when(reason == "true-missing", column.isin(P0_SCOPE))
        .when(check != "", check.isin(P0_CHECKS))
        .otherwise(reason.isin("derived-field-candidate", "alias-candidate") & (column == "race_number"))
    )


def repair_action() -> tuple[Column, Column]:
    """Action and hint of a gap record joined to its refresh decision (dec_action, cached)."""
    reason, column = F.col("reason"), F.col("column")
    true = reason == "true-missing"
    reparse = F.coalesce(F.col("dec_action") == "reparse-cache", F.lit(False))
    cached = reparse | F.coalesce(F.col("cached"), F.lit(False))
    check = reason.startswith("consistency:")
    rules = [
        (reason == "domain-allowed-missing", "no-action-domain-allowed", "domain-allowed"),
        (reason.isin("derived-field-candidate", "alias-candidate"), "schema-review", "schema/derived-candidate"),
        (reason == NO_RUNNERS, "refetch-required", "race-level-missing-horse-rows"),
        (check, "manual-review", "consistency-check"),
        (true & column.isin("race_date", "venue"), "repair-from-existing-metadata", "recoverable-from-race-metadata"),
        (true & (column == "race_number"), "schema-review", "prefer-derived-or-schema-mapping"),
        (true & column.isin("race_id", "horse_id"), "manual-review", "identifier-missing"),
        (true & column.isin(RESULT_FIELDS) & cached, "reparse-cache", "result-cache-reparse-priority"),
        (true & column.isin(RESULT_FIELDS), "refetch-required", "result-cache-missing-refetch"),
        (true & column.isin(HORSE_FIELDS) & reparse, "reparse-cache", "candidate-parser-reparse"),
        (true & column.isin(HORSE_FIELDS), "refetch-required", "horse-row-required-field-missing"),
        (F.col("dec_action") == "schema-review", "schema-review", "from-refresh-decision"),
        (reparse, "reparse-cache", "from-refresh-decision"),
        (F.col("dec_action") == "refetch", "refetch-required", "from-refresh-decision"),
    ]
    action, hint = F.lit("manual-review"), F.lit("unmapped-case")
    for cond, a, h in reversed(rules):
        cond = F.coalesce(cond, F.lit(False))
        action = F.when(cond, F.lit(a)).otherwise(action)
        hint = F.when(cond, F.lit(h)).otherwise(hint)
    return action, hint


def repair_records(gaps: DataFrame, decisions: DataFrame, target: Sequence[str] | None = None) -> DataFrame:
    """First-priority gaps with the action that closes them, for all keys."""
    scoped = gaps.filter(in_p0_scope())
    if target is not None:
        scoped = scoped.filter(F.col("column").isin(*target, "(check)"))
    dec = decisions.select(
        "race_id",
        "horse_id",
        F.col("action").alias("dec_action"),
        (
            (F.coalesce("parser_version", F.lit("")) != "") | (F.coalesce("fetched_at", F.lit("")) != "")
        ).alias("cached"),
    )
    action, hint = repair_action()
    return scoped.join(dec, ["race_id", "horse_id"], "left").withColumns({"action": action, "source_hint": hint})


def refetch_unit() -> Column:
    by_race = F.concat(F.lit("race:"), F.coalesce("race_id", F.lit("(unknown)")))
    return (
        F.when(F.col("reason") == NO_RUNNERS, by_race)
        .when(F.col("race_id").isNotNull() & ~is_missing("horse_id"), F.concat_ws(":", F.lit("row"), "race_id", "horse_id"))
        .when(F.col("race_id").isNotNull(), by_race)
        .otherwise(F.lit("row:(unknown)"))
    )


def repair_plan(records: DataFrame, seconds: float = SECONDS_PER_REQUEST) -> DataFrame:
    """Records and distinct fetches per (action, reason, column), and the time they take."""
    fetch = F.when(F.col("action") == "refetch-required", refetch_unit())
    return (
        records.groupBy("action", "reason", "column")
        .agg(F.count(F.lit(1)).alias("count"), F.count_distinct(fetch).alias("refetch_units"))
        .withColumn("estimated_runtime_seconds", F.round(F.col("refetch_units") * F.lit(seconds), 2))
    )


def repair_samples(records: DataFrame, n: int = 10) -> DataFrame:
    return top_per_group(
        records, ["reason", "action"], [F.col(c) for c in ("race_id", "horse_id", "column")], n, "sample_no"
    )


# Assumed quality of a row before a reparse.
def current_quality() -> Column:
    return (
        F.when(F.col("reason") == "domain-allowed-missing", 100.0)
        .when(F.col("reason") == "derived-field-candidate", 75.0)
        .when(F.col("reason") == NO_RUNNERS, 35.0)
        .when(F.col("action") == "repair-from-existing-metadata", 65.0)
        .when(F.col("action") == "reparse-cache", 55.0)
        .when(F.col("action") == "refetch-required", 45.0)
        .when(F.col("action") == "schema-review", 85.0)
        .otherwise(60.0)
    )


def reparse_preview(
    candidates: DataFrame,
    pages: DataFrame,
    key: str,
    html: str,
    fields: Mapping[str, Column],
    before: str = "before",
    field: str = "column",
) -> DataFrame:
    """What re-reading the cached page of each candidate would change.

    fields are expressions over the page; six points are lost per field not found.
    """
    ok = page_valid(F.col(html)) == 1
    lost = sum((c.isNull().cast("int") for c in fields.values()), F.lit(0)) * 6.0
    read = pages.select(
        key,
        F.when(ok, F.greatest(F.lit(0.0), 100.0 - lost)).otherwise(F.lit(0.0)).alias("reparsed_quality"),
        F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), c)]).alias("_f"),
    )
    after = F.try_element_at("_f", F.col(field))
    outcome = (
        F.when(F.col("reparsed_quality").isNull(), "cache-missing")
        .when(F.col("reparsed_quality") <= 0, "reparse-failed")
        .when(F.col("reparsed_quality") < F.col("current_quality"), "no-downgrade-skip")
        .when(F.col(before).eqNullSafe(F.col("after")), "no-change")
        .when(F.coalesce(~F.col("after").isin("", UNKNOWN_SIRE), F.lit(False)), "would-fix-from-cache")
        .otherwise("manual-review")
    )
    return (
        candidates.join(read, key, "left")
        .withColumns({"after": after, "current_quality": current_quality()})
        .withColumn("outcome", outcome)
        .drop("_f")
    )


def gap_cause() -> Column:
    """Likely cause of a gap record with its action, whether its page is cached and could be read."""
    cached = F.col("cache_available")
    parser = F.lit("likely_parser_or_mapper_issue")
    fetch = F.lit("likely_targeted_refetch_needed")
    return (
        F.when((F.col("action") == "schema-review") | (F.col("column") == "race_number"), "likely_schema_or_mapping_issue")
        .when(F.col("action") == "repair-from-existing-metadata", "likely_metadata_repair")
        .when(F.col("action") == "manual-review", "manual_review_required")
        .when(F.col("reason") == NO_RUNNERS, F.when(cached, parser).otherwise(fetch))
        .when(F.col("column").isin(RESULT_FIELDS), F.when(cached & F.col("parse_ok"), parser).otherwise(fetch))
        .when(F.col("column").isin(HORSE_FIELDS + PEDIGREE_FIELDS), F.when(cached, parser).otherwise(fetch))
        .when(F.col("reason").startswith("consistency:"), "manual_review_required")
        .otherwise(fetch)
    )


def refetch_candidates(
    rows: DataFrame,
    races: DataFrame,
    pedigree: DataFrame,
    cache: DataFrame,
    race_url: Column,
    horse_url: Column,
) -> DataFrame:
    """One page per URL to fetch again: (url, priority, column, reason).

    Missing result or runner fields and races without runners need the race page, horses
    with a gap in their pedigree the horse page; what the cache holds is left out.
    """
    wanted = {"finish_position": "P0", "horse_name": "P1", "frame_number": "P1", "horse_number": "P1"}
    gaps = F.array(
        *[
            F.when(is_missing(f), F.struct(F.lit(p).alias("priority"), F.lit(f).alias("column")))
            for f, p in wanted.items()
        ]
    )
    missing = (
        rows.filter(~is_missing("race_id"))
        .select("race_id", F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("g"))
        .select(race_url.alias("url"), "g.priority", "g.column", F.lit("true-missing").alias("reason"))
    )
    empty = races.join(rows.select("race_id"), "race_id", "left_anti").select(
        race_url.alias("url"),
        F.lit("P0").alias("priority"),
        F.lit("(check)").alias("column"),
        F.lit(NO_RUNNERS).alias("reason"),
    )
    unknown = F.lit(False)
    for f in PEDIGREE_FIELDS:
        unknown = unknown | is_missing(f)
    lineage = pedigree.filter(unknown & ~is_missing("horse_id")).select(
        horse_url.alias("url"),
        F.lit("P1").alias("priority"),
        F.lit("sire").alias("column"),
        F.lit("true-missing").alias("reason"),
    )
    found = missing.unionByName(empty).unionByName(lineage).join(cache.select("url"), "url", "left_anti")
    return dedupe_priority(found, ["url"], ["priority", "column"])


def fetch_estimate(urls: DataFrame, cache: DataFrame, resumed: DataFrame, url: str = "url") -> DataFrame:
    """One row: distinct URLs, what is cached, what an earlier run finished, what remains."""
    one = urls.groupBy(url).agg(F.count(F.lit(1)).alias("_n"))
    seen = one.join(cache.select(url).distinct().withColumn("_c", F.lit(1)), url, "left").join(
        resumed.select(url).distinct().withColumn("_r", F.lit(1)), url, "left"
    )
    return seen.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_input_urls"),
        F.count(F.lit(1)).alias("unique_urls"),
        F.count("_c").alias("cache_hits"),
        F.count("_r").alias("resume_hits"),
    ).withColumn(
        "estimated_network_requests",
        F.greatest(F.lit(0).cast("bigint"), F.col("unique_urls") - F.col("cache_hits") - F.col("resume_hits")),
    )


def incomplete_races(races: DataFrame, rows: DataFrame, race: str = "race_id", flag: str = "_invalid_distance") -> DataFrame:
    """Races without a usable distance, or in which no runner has a trainer or a body weight."""
    bare = rows.groupBy(race).agg(
        F.max((F.col("trainer").isNotNull() | F.col("horse_weight").isNotNull())).alias("_any")
    )
    bad = races.filter(F.coalesce(F.col(flag), F.lit(False)) | (F.col("distance") == 0)).select(race).distinct()
    return (
        bare.join(bad.withColumn("_bad", F.lit(True)), race, "left")
        .filter(F.col("_bad") | ~F.col("_any"))
        .select(race, F.when(F.col("_bad"), "distance").otherwise("runners").alias("cause"))
    )


def unknown_pedigree(rows: DataFrame, horse: str, sire: str, prefix: str) -> DataFrame:
    """Horses of the id prefix whose sire is blank or a placeholder in some row."""
    blank = F.coalesce(F.trim(sire), F.lit("")).isin("", UNKNOWN_SIRE)
    return rows.filter(F.col(horse).startswith(prefix) & blank).select(horse).distinct()


def propagate_sire(rows: DataFrame, found: DataFrame, horse: str, sire: str) -> DataFrame:
    """The sire found for a horse on all its rows that lack one."""
    value = F.when(~F.coalesce(F.trim(sire), F.lit("")).isin("", UNKNOWN_SIRE), F.col(sire))
    one = found.groupBy(horse).agg(F.min(sire).alias("_found"))
    return rows.join(one, horse, "left").withColumn(sire, F.coalesce(value, F.col("_found"))).drop("_found")


def done_dates(days: DataFrame, now: Column, min_races: int = 6, recent_days: int = 14) -> DataFrame:
    """Days that need no further look: enough races or none held, and not recent."""
    full = (F.col("race_count") >= min_races) | F.coalesce(F.col("no_race"), F.lit(False))
    return days.filter(full & (F.col("day") < F.date_sub(now, recent_days)))


def open_dates(calendar: DataFrame, done: DataFrame) -> DataFrame:
    return calendar.join(done.select("day"), "day", "left_anti")


def writer_projection(
    races: DataFrame, runners: DataFrame, payouts: DataFrame, user: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three target tables with their types and defaults; inputs are text documents."""

    def text(c):
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    def whole(c, source=None):
        return F.coalesce(F.trim(source or c).try_cast("int"), F.lit(0)).alias(c)

    def real(c):
        return F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0)).alias(c)

    uid = F.lit(user).alias("user_id")
    sex_age = F.coalesce(F.col("sex_age"), F.lit(""))
    r = races.select(
        "race_id", text("race_name"), text("venue"), whole("distance"), text("track_type"), text("weather"),
        text("field_condition"), uid,
    )
    e = runners.select(
        "race_id", whole("finish_position"), whole("bracket_number"), whole("horse_number"), text("horse_name"),
        F.substring(sex_age, 1, 1).alias("sex"),
        F.coalesce(F.substring(sex_age, 2, 99).try_cast("int"), F.lit(0)).alias("age"),
        real("jockey_weight"), text("jockey_name"), text("finish_time"), real("odds"), whole("popularity"), uid,
    )
    p = payouts.select(
        "race_id", text("bet_type"), text("combination"),
        F.coalesce(F.regexp_replace("payout", "[^0-9]", "").try_cast("int"), F.lit(0)).alias("payout"), uid,
    )
    return r, e, p


def writer_limits(tables: Mapping[str, DataFrame], limits: Mapping[str, int] = ROW_LIMITS) -> DataFrame:
    """Per target table: rows, races, and races with more rows than the writer takes."""
    out = None
    for name, df in tables.items():
        one = (
            df.groupBy("race_id")
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
                F.count(F.lit(1)).alias("races"),
                F.coalesce(F.sum((F.col("n") > limits[name]).cast("bigint")), F.lit(0)).alias("over_limit"),
            )
            .select(F.lit(name).alias("target_table"), F.lit(limits[name]).alias("row_limit"), "*")
        )
        out = one if out is None else out.unionByName(one)
    return out
