"""Data quality and repair planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.functions.text import normalise_url
from furlong.operators import audit as A
from furlong.operators import quality as Q
from furlong.operators import repair as P
from furlong.operators import stats as S
from furlong.session import shared_dir
from furlong.verify.base import audit_grains, audit_rows, entries, query, r, races, runners, table, with_audit, with_runners
from furlong.verify.sources import _NORM
from furlong.verify.stats import _FIELD_SQL, GAPS_SQL, MISSINGNESS_SQL, allowed_sql

ID = ["race_id", "runner_no", "horse_id", "jockey_id"]
ID_SQL = "race_id, runner_no, horse_id, jockey_id"
NOW = "2000-06-01 00:00:00"

_GATED_SQL = """, g AS (SELECT *, CASE WHEN trainer_id % 10 = 0 THEN 0 WHEN trainer_id % 10 = 1 AND runner_no = 1 THEN 99 ELSE 1600 END AS dist,
   CASE WHEN surface <> 'N' THEN odds END AS o, CASE WHEN surface = 'N' THEN runner_no END AS pop,
   CASE WHEN runner_no = 6 AND trainer_id % 7 = 0 THEN ' ' ELSE horse_name END AS nm,
   CASE WHEN runner_no = 5 AND trainer_id % 9 = 0 THEN 'elsewhere' ELSE venue END AS v FROM runners),
 a AS (SELECT race_id, bool_or(dist > 0) AS d, 1 - count(o) / CAST(count(*) AS DOUBLE) AS on_, count(DISTINCT dist) AS nd, count(DISTINCT v) AS nv,
   bool_or(trim(nm) = '') AS bl, 1 - count(pop) / CAST(count(*) AS DOUBLE) AS pn FROM g GROUP BY 1),
 i AS (SELECT race_id, 'Q1' AS issue_code, 'distance' AS field, 'ERROR' AS severity FROM a WHERE NOT d
   UNION ALL SELECT race_id, 'Q2', 'odds', CASE WHEN on_ >= 0.8 THEN 'ERROR' ELSE 'WARNING' END FROM a WHERE on_ > 0
   UNION ALL SELECT race_id, 'Q3', 'distance', 'ERROR' FROM a WHERE nd > 1
   UNION ALL SELECT race_id, 'Q3', 'venue', 'ERROR' FROM a WHERE nv > 1
   UNION ALL SELECT race_id, 'Q4', 'horse_name', 'WARNING' FROM a WHERE bl
   UNION ALL SELECT race_id, 'Q5', 'popularity', 'ERROR' FROM a WHERE pn >= 0.8)"""


def _gated(spark, sf):
    t, no = F.col("trainer_id"), F.col("runner_no")
    return runners(spark, sf).withColumns(
        {
            "distance": F.when(t % 10 == 0, 0).when((t % 10 == 1) & (no == 1), 99).otherwise(1600),
            "odds": F.when(F.col("surface") != "N", F.col("odds")),
            "popularity": F.when(F.col("surface") == "N", no),
            "horse_name": F.when((no == 6) & (t % 7 == 0), F.lit(" ")).otherwise(F.col("horse_name")),
            "venue": F.when((no == 5) & (t % 9 == 0), F.lit("elsewhere")).otherwise(F.col("venue")),
        }
    )


@query("race_gate", with_runners(f"{_GATED_SQL} SELECT * FROM i"))
def race_gate(spark, sf):
    return Q.race_gate(_gated(spark, sf))


@query(
    "filter_valid",
    with_runners(
        f"""{_GATED_SQL} SELECT 'after' AS stage, {ID_SQL} FROM runners WHERE race_id NOT IN (SELECT race_id FROM i WHERE severity = 'ERROR')
        UNION ALL SELECT 'before', {ID_SQL} FROM runners WHERE race_id NOT IN (SELECT race_id FROM i WHERE severity = 'ERROR' AND issue_code NOT IN ('Q2', 'Q5'))"""
    ),
)
def filter_valid(spark, sf):
    df = _gated(spark, sf)
    after = Q.filter_valid(df).select(F.lit("after").alias("stage"), *ID)
    return after.unionByName(Q.filter_valid(df, before_race=True).select(F.lit("before").alias("stage"), *ID))


_PSI_COLS = {"odds": "odds", "qty": "qty", "distance": "CAST(distance AS DOUBLE)", "finish": "CAST(finish AS DOUBLE)", "price": "CASE WHEN s = 't' OR runner_no > 2 THEN price * CASE WHEN s = 't' THEN 1 ELSE 1.4 END END"}


def _psi_sql():
    long = " UNION ALL ".join(f"SELECT '{c}' AS f, s, {e} AS x FROM both_" for c, e in _PSI_COLS.items())
    return with_runners(
        f""", both_ AS (SELECT *, CASE WHEN race_date < DATE '1998-01-01' THEN 't' ELSE 'i' END AS s FROM runners),
        long AS ({long}),
        m AS (SELECT f, count(*) FILTER (s = 't') AS rt, count(*) FILTER (s = 'i') AS ri, count(x) FILTER (s = 't') AS nt, count(x) FILTER (s = 'i') AS ni,
          quantile_cont(x, 0.5) FILTER (s = 't') AS mt, quantile_cont(x, 0.5) FILTER (s = 'i') AS mi,
          quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (s = 't') AS q FROM long GROUP BY f),
        e AS (SELECT f, list_sort(list_distinct(list_concat([q[1] - 1e-8], q[2:10], [q[11] + 1e-8]))) AS e FROM m),
        b AS (SELECT f, unnest(range(1, len(e))) AS i, e FROM e),
        c AS (SELECT b.f, b.i, count(x) FILTER (s = 't') AS t, count(x) FILTER (s = 'i') AS a FROM b LEFT JOIN long ON long.f = b.f AND x >= e[i] AND (x < e[i + 1] OR (i = len(e) - 1 AND x <= e[i + 1])) GROUP BY 1, 2),
        p AS (SELECT f, CASE WHEN t = 0 THEN 1e-8 ELSE t / (sum(t) OVER (PARTITION BY f) + 1e-8) END AS t, CASE WHEN a = 0 THEN 1e-8 ELSE a / (sum(a) OVER (PARTITION BY f) + 1e-8) END AS a FROM c),
        s AS (SELECT f, sum((a - t) * ln(a / t)) AS psi FROM p GROUP BY f)
        SELECT m.f AS feature, round((1 - nt / CAST(rt AS DOUBLE)) * 100, 1) + 0.0 AS train_missing_pct, round((1 - ni / CAST(ri AS DOUBLE)) * 100, 1) + 0.0 AS infer_missing_pct,
          round(abs(ni / CAST(ri AS DOUBLE) - nt / CAST(rt AS DOUBLE)) * 100, 1) AS missing_drift, round(mt, 4) AS train_median, round(mi, 4) AS infer_median,
          round(psi, 4) AS psi, CASE WHEN abs(ni / CAST(ri AS DOUBLE) - nt / CAST(rt AS DOUBLE)) > 0.2 OR psi >= 0.2 THEN 1 ELSE 0 END AS drift_flag
        FROM m JOIN s ON m.f = s.f"""
    )


@query("psi_drift", _psi_sql())
def psi_drift(spark, sf):
    df = runners(spark, sf)
    before = F.col("race_date") < F.lit("1998-01-01").cast("date")
    train = df.filter(before)
    infer = df.filter(~before).withColumn("price", F.when(F.col("runner_no") > 2, F.col("price") * 1.4))
    return Q.psi_drift(train, infer, list(_PSI_COLS))


CHECKS_SQL = f"""h AS (SELECT race_id, trim(horse_id) AS h, count(*) AS n FROM audit WHERE trim(horse_id) <> '' GROUP BY 1, 2),
  x(name, level, failed_count) AS (
    SELECT 'race_id_duplicate', 'fail', (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)
    UNION ALL SELECT 'horse_id_missing', 'fail', (SELECT count(*) FROM audit WHERE trim(horse_id) = '')
    UNION ALL SELECT 'horse_id_duplicate_in_race', 'fail', (SELECT CAST(sum(n - 1) AS BIGINT) FROM h)
    UNION ALL SELECT 'horse_number_duplicate_in_race', 'fail', (SELECT count(DISTINCT race_id) FROM (SELECT race_id, horse_number FROM audit GROUP BY 1, 2 HAVING count(*) > 1))
    UNION ALL SELECT 'finish_position_range', 'fail', (SELECT count(*) FROM audit WHERE TRY_CAST(finish_position AS INTEGER) NOT BETWEEN 1 AND 30)
    UNION ALL SELECT 'starters_per_race_range', 'fail', (SELECT count(*) FROM (SELECT race_id, count(*) AS n FROM h GROUP BY 1) WHERE n > 30)
    UNION ALL SELECT 'race_date_out_of_target_period', 'fail', (SELECT count(*) FROM audit WHERE race_date NOT BETWEEN '19950101' AND '19991231')
    UNION ALL SELECT 'venue_empty', 'fail', (SELECT count(*) FROM audit WHERE trim(venue) = '')
    UNION ALL SELECT 'odds_non_numeric', 'warn', (SELECT count(*) FROM audit WHERE odds = 'x')
    UNION ALL SELECT 'popularity_non_numeric', 'warn', (SELECT count(*) FROM audit WHERE popularity = '?')
    UNION ALL SELECT 'race_without_horse_data', 'fail', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
    UNION ALL SELECT 'horse_without_pedigree', 'warn', (SELECT CASE WHEN count(*) FILTER (NOT k) > 0.2 * count(*) THEN count(*) FILTER (NOT k) ELSE 0 END FROM (SELECT trim(horse_id) AS h, bool_or(sire IS NOT NULL) AS k FROM audit WHERE trim(horse_id) <> '' GROUP BY 1))
    UNION ALL SELECT 'required_column_missing_rate_over_0pct', 'fail', (SELECT count(DISTINCT col) FROM gaps WHERE kind = 'true' AND lev LIKE 'required%')
    UNION ALL SELECT 'important_column_missing_over_10pct', 'warn', (SELECT count(*) FROM (SELECT col FROM gaps WHERE lev = 'important_warn' GROUP BY 1 HAVING count(*) FILTER (kind = 'true') > 0.1 * count(*)))),
  chk AS (SELECT *, CASE WHEN failed_count = 0 THEN 'pass' ELSE level END AS status,
    (SELECT CASE WHEN bool_or(failed_count > 0 AND level = 'fail') THEN 'fail' WHEN bool_or(failed_count > 0) THEN 'warn' ELSE 'pass' END FROM x) AS verdict FROM x)"""


def _audited(spark, sf):
    grains = audit_grains(spark, sf)
    missing = A.column_missingness(grains)
    master = races(spark, sf).select(F.col("race_id").cast("string").alias("race_id"))
    return missing, A.consistency_checks(master, grains, missing)


@query("consistency_checks", with_audit(f", {GAPS_SQL}, {CHECKS_SQL} SELECT * FROM chk"))
def consistency_checks(spark, sf):
    return _audited(spark, sf)[1]


@query(
    "audit_reasons",
    with_audit(
        f""", {MISSINGNESS_SQL}, {CHECKS_SQL}
        SELECT 'true-missing' AS reason, "column", required_level, true_missing_count AS count, severity, CASE WHEN "column" IN ('race_id', 'horse_id', 'finish_position') THEN 'P0'
          WHEN "column" IN ('result_time', 'race_date', 'venue', 'horse_name', 'frame_number', 'horse_number') THEN 'P1' WHEN required_level = 'important_warn' THEN 'P2' ELSE 'P0' END AS priority, example_keys FROM mis WHERE true_missing_count > 0
        UNION ALL SELECT 'domain-allowed-missing', "column", required_level, domain_allowed_count, 'info', 'Domain allowed', domain_example_keys FROM mis WHERE domain_allowed_count > 0
        UNION ALL SELECT 'derived-field-candidate', "column", required_level, derivable_count, 'warn', 'Schema review', derivable_example_keys FROM mis WHERE derivable_count > 0
        UNION ALL SELECT 'alias-candidate', "column", required_level, alias_count, 'warn', 'Schema review', alias_candidate FROM mis WHERE alias_count > 0
        UNION ALL SELECT 'consistency:' || name, '(check)', 'consistency', failed_count, status, CASE WHEN name IN ('race_without_horse_data', 'horse_id_missing', 'race_id_duplicate') THEN 'P0' ELSE 'P1' END, '' FROM chk WHERE failed_count > 0"""
    ),
)
def audit_reasons(spark, sf):
    return A.audit_reasons(*_audited(spark, sf), P.priority(F.col("column")))


@query(
    "fail_reasons",
    with_audit(
        f""", {MISSINGNESS_SQL}, {CHECKS_SQL} SELECT 'required:' || "column" AS reason, true_missing_count AS count FROM mis WHERE required_level LIKE 'required%' AND true_missing_count > 0
        UNION ALL SELECT 'check:' || name, failed_count FROM chk WHERE status = 'fail'"""
    ),
)
def fail_reasons(spark, sf):
    return A.fail_reasons(*_audited(spark, sf))


# ---- one row ----------------------------------------------------------------

_HAS = f"(NOT {_FIELD_SQL['finish_position']} OR NOT {_FIELD_SQL['result_time']})"


def _true_gap(f):
    cond = _FIELD_SQL[f]
    if f in S.RESULT_FIELDS:
        cond += f" AND {_HAS} AND NOT {allowed_sql(f)}"
    if f == "race_number":
        cond += " AND race_number_derived IS NULL"
    return f"CASE WHEN {cond} THEN '{f}' END"


_FIELDS = S.CORE_FIELDS + S.RESULT_FIELDS
QUALITY_SQL = f"""q AS (SELECT *, list_filter([{", ".join(_true_gap(f) for f in _FIELDS)}], lambda v: v IS NOT NULL) AS missing,
   list_filter([{", ".join(f"CASE WHEN {_FIELD_SQL[f]} AND {_HAS} AND {allowed_sql(f)} THEN '{f}' END" for f in S.RESULT_FIELDS)}], lambda v: v IS NOT NULL) AS allowed,
   {_FIELD_SQL["race_number"]} AND race_number_derived IS NOT NULL AS review,
   {" + ".join(f"CASE WHEN {_FIELD_SQL[f]} THEN 1 ELSE 0 END" for f in S.IMPORTANT_FIELDS)} AS important,
   coalesce(odds = 'x', false) OR coalesce(popularity = '?', false) AS invalid, coalesce(parser_version = '1.9.0', false) AS old_parser,
   fetched_at < '2000-05-02 00:00:00' AS old_fetch, source_html_present = 0 AS no_page, http_status = '404' AS err FROM audit),
 scored AS (SELECT *, greatest(0.0::DOUBLE, 100.0::DOUBLE - CASE WHEN len(missing) > 0 THEN 35 ELSE 0 END - CASE WHEN review THEN 3 ELSE 0 END - least(25.0::DOUBLE, important * 3.0::DOUBLE)
   - CASE WHEN invalid THEN 20 ELSE 0 END - CASE WHEN no_page THEN 10 ELSE 0 END - CASE WHEN err THEN 25 ELSE 0 END) AS score FROM q)"""


@query(
    "row_quality",
    with_audit(
        f""", {QUALITY_SQL} SELECT race_id, horse_id, horse_number, array_to_string(missing, ',') AS missing_fields, score,
        CAST(old_parser AS INTEGER) AS stale_parser, CAST(old_fetch AS INTEGER) AS stale_fetch, CAST(review AS INTEGER) AS schema_review FROM scored"""
    ),
)
def row_quality(spark, sf):
    out = Q.row_quality(audit_rows(spark, sf), NOW)
    return out.select(
        "race_id",
        "horse_id",
        "horse_number",
        F.array_join("missing_fields", ",").alias("missing_fields"),
        "score",
        *[F.col(c).cast("int").alias(c) for c in ("stale_parser", "stale_fetch", "schema_review")],
    )


HASH_SQL = (
    "sha1('{' || "
    + " || ',' || ".join(f"""'"{f}":' || coalesce('"' || replace({f}, '/', '/') || '"', 'null')""" for f in Q.HASH_FIELDS)
    + " || '}')"
)


@query("record_hash", with_audit(f"SELECT race_id, horse_id, horse_number, {HASH_SQL} AS record_hash FROM audit"))
def record_hash(spark, sf):
    return audit_rows(spark, sf).select("race_id", "horse_id", "horse_number", Q.record_hash().alias("record_hash"))


@query("duplicate_keys", with_audit("SELECT race_id, horse_id, count(*) AS copies FROM audit GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_keys(spark, sf):
    return Q.duplicate_keys(audit_rows(spark, sf), ["race_id", "horse_id"])


_STALE = "WHEN old_parser THEN 'reparse-cache' WHEN old_fetch THEN 'refetch'"
_ACTION_SQL = {
    "skip-existing": "'skip'",
    "reparse-cache": "CASE WHEN old_parser THEN 'reparse-cache' ELSE 'skip' END",
    "repair-missing": f"CASE WHEN len(missing) > 0 OR invalid THEN 'repair' WHEN review THEN 'schema-review' {_STALE} ELSE 'skip' END",
    "refresh-stale": f"CASE {_STALE} ELSE 'skip' END",
    "force-refresh": "'refetch'",
}
_ACTION_SQL["dry-run"] = _ACTION_SQL["repair-missing"]


@query(
    "refresh_action",
    with_audit(
        f""", {QUALITY_SQL}, d AS (SELECT *, count(*) OVER (PARTITION BY race_id, horse_id) > 1 AS dup FROM scored) """
        + " UNION ALL ".join(
            f"SELECT '{p}' AS policy, CASE WHEN dup THEN 'quarantine' ELSE {sql} END AS action, count(*) AS n FROM d GROUP BY 2"
            for p, sql in _ACTION_SQL.items()
        )
    ),
)
def refresh_action(spark, sf):
    rows = audit_rows(spark, sf)
    dup = Q.duplicate_keys(rows, ["race_id", "horse_id"]).withColumn("duplicate", F.lit(True)).drop("copies")
    assessed = Q.row_quality(rows, NOW).join(dup, ["race_id", "horse_id"], "left").na.fill({"duplicate": False})
    actions = F.array(
        *[F.struct(F.lit(p).alias("policy"), Q.refresh_action(p)[0].alias("action")) for p in Q.POLICIES]
    )
    return (
        assessed.select(F.explode(actions).alias("a")).groupBy("a.policy", "a.action").agg(F.count(F.lit(1)).alias("n"))
    )




def _written(df, name):
    """The rows, written to the shared folder: what made them runs once, and Spark knows their size."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _two_sides(spark, sf, rows=None):
    keys = ["race_id", "horse_id"]
    rows = _written(audit_rows(spark, sf), "audit") if rows is None else rows
    one = rows.join(_written(Q.duplicate_keys(rows, keys), "copies"), keys, "left_anti")
    cand = one.filter("tax > 0.02").withColumn("odds", F.when(F.col("qty") == 30, F.lit("9.9")).otherwise(F.col("odds")))
    return one, cand


# Candidates differ from existing rows only where odds are not a number (quantity 30).
TWO_SIDES_SQL = f""", {QUALITY_SQL}, uniq AS (SELECT *, count(*) OVER (PARTITION BY race_id, horse_id) AS copies FROM scored),
  dec AS (SELECT *, tax > 0.02 AS has_new, qty = 30 AS fixed,
    CASE WHEN len(missing) > 0 OR invalid THEN 'repair' WHEN review THEN 'schema-review' {_STALE} ELSE 'skip' END AS act FROM uniq WHERE copies = 1),
  fin AS (SELECT *, CASE WHEN NOT has_new THEN act WHEN NOT fixed THEN 'no-downgrade-skip' WHEN len(missing) > 0 OR err OR no_page THEN 'no-downgrade-skip'
      WHEN act IN ('refetch', 'repair', 'reparse-cache') THEN 'update-candidate' ELSE act END AS action,
    CASE WHEN has_new AND NOT fixed THEN 'record-hash-same' WHEN has_new AND len(missing) > 0 THEN 'candidate-required-missing' WHEN has_new AND (err OR no_page) THEN 'candidate-error-or-empty-html'
      WHEN has_new AND act IN ('refetch', 'repair', 'reparse-cache') THEN 'candidate-quality-acceptable'
      WHEN len(missing) > 0 OR invalid THEN 'required-missing-or-invalid' WHEN review THEN 'schema-mismatch-or-derived-candidate' WHEN old_parser THEN 'stale-parser-version'
      WHEN old_fetch THEN 'stale-fetched-at' ELSE 'healthy-existing' END AS reason FROM dec)"""


@query(
    "no_downgrade",
    with_audit(f"{TWO_SIDES_SQL} SELECT race_id, horse_id, action, reason, score FROM fin"),
)
def no_downgrade(spark, sf):
    old, new = _two_sides(spark, sf)
    out = P.refresh_decisions(old, new, "repair-missing", NOW)
    return out.select("race_id", "horse_id", "action", "reason", "score")


@query(
    "refresh_plan",
    with_audit(
        f"""{TWO_SIDES_SQL}, ranks AS (SELECT *, list_has_any(missing, ['race_id', 'horse_id', 'finish_position', 'race_number', 'margin']) OR len(missing) = 0 AS p0 FROM fin),
        n AS (SELECT count(*) AS existing_count, count(*) FILTER (action = 'skip') AS skip_count, count(*) FILTER (action = 'reparse-cache') AS reparse_count,
          count(*) FILTER (action = 'refetch') AS rf, count(*) FILTER (action = 'update-candidate') AS update_candidate_count, count(*) FILTER (action = 'repair') AS repair_count,
          count(*) FILTER (action = 'repair' AND p0) AS repair_count_p0, count(*) FILTER (action = 'repair' AND NOT p0) AS repair_count_p1,
          count(*) FILTER (reason IN ('candidate-required-missing', 'candidate-error-or-empty-html')) AS quarantine_count,
          count(*) FILTER (action = 'no-downgrade-skip') AS no_downgrade_skip_count, count(*) FILTER (action = 'schema-review') AS schema_review_count,
          CAST(sum(len(allowed)) AS BIGINT) AS domain_allowed_missing_count FROM ranks),
        a AS (SELECT count(*) AS missing_count FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT race_id FROM fin))
        SELECT n.* EXCLUDE (rf), missing_count, rf + missing_count AS refetch_count, rf + missing_count + greatest(0, repair_count - update_candidate_count) AS estimated_http_request_count,
          round((rf + missing_count + greatest(0, repair_count - update_candidate_count)) * 1.2::DOUBLE, 1) AS estimated_runtime FROM n, a"""
    ),
)
def refresh_plan(spark, sf):
    old, new = _two_sides(spark, sf)
    decisions = _written(P.refresh_decisions(old, new, "repair-missing", NOW), "decisions")
    expected = races(spark, sf).select(F.col("race_id").cast("string").alias("race_id"))
    return P.refresh_totals(decisions, expected, "repair-missing")


_RANK_SQL = """CASE WHEN {c} IN ('race_id', 'horse_id', 'finish_position') THEN 'P0' WHEN {c} IN ('result_time', 'race_date', 'venue', 'horse_name', 'frame_number', 'horse_number') THEN 'P1'
  WHEN {c} IN ('odds', 'popularity', 'horse_weight', 'jockey', 'trainer', 'sire', 'dam', 'broodmare_sire') THEN 'P2' ELSE 'P0' END"""


@query(
    "refresh_breakdown",
    with_audit(
        f"""{TWO_SIDES_SQL}, x AS (SELECT CASE WHEN action NOT IN ('repair', 'schema-review') AND len(allowed) > 0 THEN 'no-action' ELSE action END AS action,
          CASE WHEN action NOT IN ('repair', 'schema-review') AND len(allowed) > 0 THEN 'domain-allowed-missing' ELSE reason END AS reason, action AS orig,
          unnest(CASE WHEN action = 'repair' THEN CASE WHEN len(missing) > 0 THEN missing ELSE ['(invalid-value)'] END WHEN action = 'schema-review' THEN ['race_number']
            WHEN len(allowed) > 0 THEN allowed ELSE ['(row)'] END) AS col FROM fin)
        SELECT action, reason, col AS "column", CASE WHEN action = 'repair' THEN {_RANK_SQL.format(c="col")} WHEN action = 'schema-review' THEN 'Schema review'
          WHEN action = 'refetch' THEN 'P0' WHEN action = 'reparse-cache' THEN 'P1' ELSE 'Domain allowed' END AS priority, count(*) AS count FROM x GROUP BY ALL"""
    ),
)
def refresh_breakdown(spark, sf):
    old, new = _two_sides(spark, sf)
    return P.refresh_breakdown(P.refresh_decisions(old, new, "repair-missing", NOW))


REPAIR_SQL = f"""{TWO_SIDES_SQL}, {GAPS_SQL.replace("race_id || ':' || trim(horse_id) AS key", "race_id, horse_id")},
  rec AS (SELECT g.race_id, g.horse_id, col, CASE kind WHEN 'domain' THEN 'domain-allowed-missing' WHEN 'derivable' THEN 'derived-field-candidate' ELSE 'true-missing' END AS reason,
    CASE kind WHEN 'domain' THEN 'Domain allowed' WHEN 'derivable' THEN 'Schema review' ELSE {_RANK_SQL.format(c="col")} END AS priority, d.action AS da,
    coalesce(d.parser_version, '') <> '' OR coalesce(d.fetched_at, '') <> '' AS cached, d.race_id IS NOT NULL AS known
    FROM gaps g LEFT JOIN fin d ON g.race_id = d.race_id AND g.horse_id = d.horse_id WHERE kind IS NOT NULL),
  sc AS (SELECT * FROM rec WHERE CASE WHEN reason = 'domain-allowed-missing' THEN col = 'margin' WHEN priority = 'P0' THEN true
    WHEN reason = 'true-missing' THEN col IN ('finish_position', 'race_id', 'horse_id', 'race_date', 'venue', 'horse_name', 'frame_number', 'horse_number')
    ELSE col = 'race_number' END),
  act AS (SELECT *, CASE WHEN reason = 'domain-allowed-missing' THEN 'no-action-domain-allowed' WHEN reason = 'derived-field-candidate' THEN 'schema-review'
    WHEN col IN ('race_date', 'venue') THEN 'repair-from-existing-metadata' WHEN col = 'race_number' THEN 'schema-review' WHEN col IN ('race_id', 'horse_id') THEN 'manual-review'
    WHEN col IN ('finish_position', 'result_time', 'margin') THEN CASE WHEN coalesce(da = 'reparse-cache', false) OR (known AND cached) THEN 'reparse-cache' ELSE 'refetch-required' END
    WHEN col IN ('horse_name', 'frame_number', 'horse_number') THEN CASE WHEN coalesce(da = 'reparse-cache', false) THEN 'reparse-cache' ELSE 'refetch-required' END
    WHEN da = 'schema-review' THEN 'schema-review' WHEN da = 'reparse-cache' THEN 'reparse-cache' WHEN da = 'refetch' THEN 'refetch-required' ELSE 'manual-review' END AS action FROM sc)"""


def _repairs(spark, sf, aliases=None):
    rows = _written(audit_rows(spark, sf), "audit")
    old, new = _two_sides(spark, sf, rows)
    decisions = P.refresh_decisions(old, new, "repair-missing", NOW)
    return P.repair_records(P.gap_records(rows, aliases), decisions)


@query(
    "repair_plan",
    with_audit(
        f"""{REPAIR_SQL} SELECT action, reason, col AS "column", count(*) AS count,
        count(DISTINCT CASE WHEN action = 'refetch-required' THEN CASE WHEN trim(coalesce(horse_id, '')) <> '' THEN 'row:' || race_id || ':' || horse_id ELSE 'race:' || race_id END END) AS refetch_units,
        round(count(DISTINCT CASE WHEN action = 'refetch-required' THEN CASE WHEN trim(coalesce(horse_id, '')) <> '' THEN 'row:' || race_id || ':' || horse_id ELSE 'race:' || race_id END END) * 1.2::DOUBLE, 2) AS estimated_runtime_seconds
        FROM act GROUP BY 1, 2, 3"""
    ),
)
def repair_plan(spark, sf):
    return P.repair_plan(_repairs(spark, sf))


@query(
    "repair_plan_aliases",
    with_audit(
        f"""{REPAIR_SQL}, al AS (SELECT race_id FROM audit WHERE NOT {_FIELD_SQL["race_number"]} AND coalesce(race_number_source, '') NOT IN ('', 'race_number'))
        SELECT action, reason, col AS "column", count(*) AS count FROM act GROUP BY 1, 2, 3
        UNION ALL SELECT 'schema-review', 'alias-candidate', 'race_number', count(*) FROM al"""
    ),
)
def repair_plan_aliases(spark, sf):
    return P.repair_plan(_repairs(spark, sf, A.ALIAS_SOURCES)).select("action", "reason", "column", "count")


@query(
    "repair_samples",
    with_audit(
        f"""{REPAIR_SQL} SELECT reason, action, CAST(sample_no AS INTEGER) AS sample_no, race_id, horse_id, col AS "column" FROM (SELECT *, row_number() OVER (PARTITION BY reason, action ORDER BY race_id, horse_id, col) AS sample_no FROM act) WHERE sample_no <= 10"""
    ),
)
def repair_samples(spark, sf):
    out = P.repair_samples(_repairs(spark, sf))
    return out.select("reason", "action", "sample_no", "race_id", "horse_id", "column")


_PREVIEW_SQL = r"""WITH p AS (SELECT page_id, nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), '') AS horse_name,
    nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS venue, nullif(regexp_extract(html, '<a href="/([^"]*)"', 1), '') AS sire,
    length(trim(html)) >= 80 AND NOT regexp_matches(lower(html), 'forbidden|access denied|cloudflare') AS ok FROM pages),
  c AS (SELECT o_orderkey AS page_id, ['horse_name', 'venue', 'sire'][o_orderkey % 3 + 1] AS col, CASE WHEN o_custkey % 4 = 0 THEN 'en' END AS before,
    CASE o_custkey % 3 WHEN 0 THEN 'reparse-cache' WHEN 1 THEN 'refetch-required' ELSE 'schema-review' END AS action FROM orders),
  j AS (SELECT c.*, p.ok, p.page_id AS hit, CASE WHEN ok THEN 100.0 - 6.0 * ((horse_name IS NULL)::INT + (venue IS NULL)::INT + (sire IS NULL)::INT) ELSE 0.0 END AS q,
    CASE col WHEN 'horse_name' THEN horse_name WHEN 'venue' THEN venue ELSE sire END AS after,
    CASE action WHEN 'reparse-cache' THEN 55.0 WHEN 'refetch-required' THEN 45.0 ELSE 85.0 END AS cur FROM c LEFT JOIN p ON c.page_id = p.page_id)
  SELECT page_id, col AS "column", before, after, CASE WHEN hit IS NULL THEN 'cache-missing' WHEN q <= 0 THEN 'reparse-failed' WHEN q < cur THEN 'no-downgrade-skip'
    WHEN before IS NOT DISTINCT FROM after THEN 'no-change' WHEN after IS NOT NULL AND after <> '' THEN 'would-fix-from-cache' ELSE 'manual-review' END AS outcome FROM j"""


@query("reparse_preview", _PREVIEW_SQL)
def reparse_preview(spark, sf):
    def found(pattern):
        return F.nullif(F.trim(F.regexp_extract("html", pattern, 1)), F.lit(""))

    fields = {
        "horse_name": found(r"<h1[^>]*>([^<]*)</h1>"),
        "venue": found(r'lang="([a-z]+)"'),
        "sire": found(r'<a href="/([^"]*)"'),
    }
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    candidates = table(spark, sf, "orders").select(
        k.alias("page_id"),
        F.get(F.array(*[F.lit(n) for n in fields]), (k % 3).cast("int")).alias("column"),
        F.when(c % 4 == 0, F.lit("en")).alias("before"),
        F.lit("true-missing").alias("reason"),
        F.when(c % 3 == 0, "reparse-cache").when(c % 3 == 1, "refetch-required").otherwise("schema-review").alias("action"),
    )
    out = P.reparse_preview(candidates, table(spark, sf, "pages"), "page_id", "html", fields)
    return out.select("page_id", "column", "before", "after", "outcome")


@query(
    "gap_diagnosis",
    with_audit(
        f"""{REPAIR_SQL}, z AS (SELECT *, race_id IN (SELECT CAST(page_id AS VARCHAR) FROM pages) AS hit FROM act)
        SELECT cause, action, col AS "column", count(*) AS n FROM (SELECT *, CASE WHEN action = 'schema-review' OR col = 'race_number' THEN 'likely_schema_or_mapping_issue'
          WHEN action = 'repair-from-existing-metadata' THEN 'likely_metadata_repair' WHEN action = 'manual-review' THEN 'manual_review_required'
          WHEN col IN ('finish_position', 'result_time', 'margin') THEN CASE WHEN hit AND TRY_CAST(race_id AS INTEGER) % 2 = 0 THEN 'likely_parser_or_mapper_issue' ELSE 'likely_targeted_refetch_needed' END
          WHEN hit THEN 'likely_parser_or_mapper_issue' ELSE 'likely_targeted_refetch_needed' END AS cause FROM z) GROUP BY ALL"""
    ),
)
def gap_diagnosis(spark, sf):
    cache = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("race_id"))
    there = cache.distinct().withColumn("cache_available", F.lit(True))
    rec = _repairs(spark, sf).join(there, "race_id", "left").na.fill({"cache_available": False})
    rec = rec.withColumn("parse_ok", F.col("race_id").cast("int") % 2 == 0)
    return rec.withColumn("cause", P.gap_cause()).groupBy("cause", "action", "column").agg(F.count(F.lit(1)).alias("n"))


_BASE_URL = "https://example.org"


@query(
    "refetch_candidates",
    with_audit(
        f""", c AS (SELECT 'https://example.org/race/' || race_id AS url, 'P0' AS priority, 'finish_position' AS col, 'true-missing' AS reason FROM audit WHERE {_FIELD_SQL["finish_position"]}
          UNION ALL SELECT 'https://example.org/race/' || race_id, 'P1', 'horse_name', 'true-missing' FROM audit WHERE {_FIELD_SQL["horse_name"]}
          UNION ALL SELECT 'https://example.org/race/' || race_id, 'P1', 'frame_number', 'true-missing' FROM audit WHERE {_FIELD_SQL["frame_number"]}
          UNION ALL SELECT 'https://example.org/race/' || race_id, 'P1', 'horse_number', 'true-missing' FROM audit WHERE {_FIELD_SQL["horse_number"]}
          UNION ALL SELECT 'https://example.org/race/' || o_orderkey, 'P0', '(check)', 'consistency:race_without_horse_data' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
          UNION ALL SELECT 'https://example.org/horse/' || horse_id, 'P1', 'sire', 'true-missing' FROM audit WHERE NOT {_FIELD_SQL["horse_id"]} AND ({_FIELD_SQL["sire"]} OR {_FIELD_SQL["dam"]} OR {_FIELD_SQL["broodmare_sire"]}))
        SELECT url, priority, col AS "column", reason FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority, col, reason) AS rn FROM c
          WHERE url NOT IN (SELECT 'https://example.org/race/' || page_id FROM pages)) WHERE rn = 1"""
    ),
)
def refetch_candidates(spark, sf):
    rows = audit_rows(spark, sf)
    master = races(spark, sf).select(F.col("race_id").cast("string").alias("race_id"))
    cache = table(spark, sf, "pages").select(F.concat(F.lit(f"{_BASE_URL}/race/"), "page_id").alias("url"))
    return P.refetch_candidates(
        rows, master, rows, cache, F.concat(F.lit(f"{_BASE_URL}/race/"), "race_id"), F.concat(F.lit(f"{_BASE_URL}/horse/"), "horse_id")
    )


@query(
    "fetch_estimate",
    f"""WITH n AS (SELECT page_id, {_NORM} AS u FROM pages), u AS (SELECT DISTINCT u FROM n), c AS (SELECT DISTINCT u FROM n WHERE page_id % 3 = 0), d AS (SELECT DISTINCT u FROM n WHERE page_id % 3 = 1)
    SELECT (SELECT count(*) FROM n) AS total_input_urls, (SELECT count(*) FROM u) AS unique_urls, (SELECT count(*) FROM c) AS cache_hits, (SELECT count(*) FROM d) AS resume_hits,
      greatest(0, (SELECT count(*) FROM u) - (SELECT count(*) FROM c) - (SELECT count(*) FROM d)) AS estimated_network_requests""",
)
def fetch_estimate(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", normalise_url(F.col("url")).alias("url"))
    return P.fetch_estimate(urls, urls.filter("page_id % 3 = 0"), urls.filter("page_id % 3 = 1"))


@query(
    "incomplete_races",
    with_runners(
        """SELECT race_id, CASE WHEN max(trainer_id) % 10 = 0 THEN 'distance' ELSE 'runners' END AS cause FROM runners GROUP BY race_id
        HAVING max(trainer_id) % 10 = 0 OR NOT bool_or(runner_no > 2 OR surface = 'A')"""
    ),
)
def incomplete_races(spark, sf):
    master = races(spark, sf).select(
        "race_id", (F.col("trainer_id") % 20 == 0).alias("_invalid_distance"), F.when(F.col("trainer_id") % 20 == 10, 0).otherwise(1600).alias("distance")
    )
    rows = runners(spark, sf).select(
        "race_id",
        F.when(F.col("runner_no") > 2, F.col("trainer_id")).alias("trainer"),
        F.when(F.col("surface") == "A", F.lit(480)).alias("horse_weight"),
    )
    return P.incomplete_races(master, rows)


@query(
    "unknown_pedigree",
    with_runners(
        """, x AS (SELECT race_id, runner_no, CASE WHEN horse_id % 3 = 0 THEN 'B' ELSE 'A' END || horse_id AS h, CASE WHEN runner_no = 1 THEN ' ' WHEN runner_no = 2 THEN 'unknown_local' ELSE sire END AS s, sire FROM runners),
        u AS (SELECT DISTINCT h FROM x WHERE h LIKE 'B%' AND trim(s) IN ('', 'unknown_local')),
        f AS (SELECT h, min(sire) AS found FROM x WHERE h IN (SELECT h FROM u) GROUP BY h)
        SELECT race_id, runner_no, x.h AS horse_id, coalesce(CASE WHEN trim(s) NOT IN ('', 'unknown_local') THEN s END, found) AS sire FROM x LEFT JOIN f ON x.h = f.h"""
    ),
)
def unknown_pedigree(spark, sf):
    horse = F.concat(F.when(F.col("horse_id") % 3 == 0, F.lit("B")).otherwise(F.lit("A")), "horse_id")
    rows = runners(spark, sf).select(
        "race_id",
        "runner_no",
        horse.alias("horse_id"),
        F.when(F.col("runner_no") == 1, F.lit(" ")).when(F.col("runner_no") == 2, F.lit(P.UNKNOWN_SIRE)).otherwise(F.col("sire")).alias("sire"),
        F.col("sire").alias("true_sire"),
    )
    wanted = P.unknown_pedigree(rows, "horse_id", "sire", "B")
    found = rows.join(wanted, "horse_id", "left_semi").select("horse_id", F.col("true_sire").alias("sire"))
    return P.propagate_sire(rows.drop("true_sire"), found, "horse_id", "sire")


@query(
    "done_dates",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
      done AS (SELECT day FROM d WHERE (n >= 6 OR n % 5 = 0) AND day < DATE '2000-06-01' - INTERVAL 14 DAY)
    SELECT strftime(day, '%Y%m%d') AS day, CASE WHEN day IN (SELECT day FROM done) THEN 'done' ELSE 'open' END AS state FROM d""",
)
def done_dates(spark, sf):
    days = races(spark, sf).groupBy(F.col("race_date").alias("day")).agg(F.count(F.lit(1)).alias("race_count"))
    days = days.withColumn("no_race", F.col("race_count") % 5 == 0)
    done = P.done_dates(days, F.lit("2000-06-01").cast("date"))
    left = P.open_dates(days, done)
    both = done.select("day", F.lit("done").alias("state")).unionByName(left.select("day", F.lit("open").alias("state")))
    return both.select(F.date_format("day", "yyyyMMdd").alias("day"), "state")


@query(
    "writer_projection",
    with_runners(
        """, e AS (SELECT race_id, count(*) AS n FROM entries GROUP BY 1), p AS (SELECT race_id, count(*) AS n FROM entries WHERE finish = 1 GROUP BY 1)
        SELECT 'races' AS target_table, 1 AS row_limit, count(*) AS records, count(DISTINCT o_orderkey) AS races, 0::BIGINT AS over_limit, CAST(sum(o_orderkey % 5) AS DOUBLE) AS checksum FROM orders
        UNION ALL SELECT 'race_results', 3, (SELECT count(*) FROM entries), (SELECT count(*) FROM e), (SELECT count(*) FROM e WHERE n > 3),
          (SELECT CAST(sum(coalesce(finish, 0) + runner_no + CASE WHEN runner_no <> 3 THEN CAST(qty AS INTEGER) ELSE 0 END) AS DOUBLE) FROM entries)
        UNION ALL SELECT 'race_payouts', 100, (SELECT CAST(sum(n) AS BIGINT) FROM p), (SELECT count(*) FROM p), 0, (SELECT CAST(sum(CAST(qty AS INTEGER) * 1000 + 20) AS DOUBLE) FROM entries WHERE finish = 1)"""
    ),
)
def writer_projection(spark, sf):
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    r_docs = races(spark, sf).select(
        "race_id", none.alias("race_name"), "venue", (F.col("race_id") % 5).cast("string").alias("distance"),
        F.lit("芝").alias("track_type"), none.alias("weather"), none.alias("field_condition"),
    )
    e = entries(spark, sf)
    q = F.col("qty").cast("int").cast("string")
    e_docs = e.select(
        "race_id", F.coalesce(text("finish"), F.lit("取消")).alias("finish_position"), text("runner_no").alias("bracket_number"),
        text("runner_no").alias("horse_number"), text("horse_id").alias("horse_name"), F.concat("surface", q).alias("sex_age"),
        F.lit("57.0").alias("jockey_weight"), text("jockey_id").alias("jockey_name"), none.alias("finish_time"),
        F.when(F.col("runner_no") != 3, q).otherwise(F.lit("---")).alias("odds"), F.lit("").alias("popularity"),
    )
    p_docs = e.filter("finish = 1").select(
        "race_id", F.lit("単勝").alias("bet_type"), text("runner_no").alias("combination"), F.concat(q, F.lit(",020円")).alias("payout")
    )
    races_t, results_t, payouts_t = P.writer_projection(r_docs, e_docs, p_docs, "u1")
    limits = P.writer_limits({"races": races_t, "race_results": results_t, "race_payouts": payouts_t}, {**P.ROW_LIMITS, "race_results": 3})
    sums = (
        races_t.agg(F.sum("distance").alias("s")).select(F.lit("races").alias("target_table"), "s")
        .unionByName(results_t.agg(F.sum(F.col("finish_position") + F.col("horse_number") + F.col("odds").cast("int")).alias("s")).select(F.lit("race_results").alias("target_table"), "s"))
        .unionByName(payouts_t.agg(F.sum("payout").alias("s")).select(F.lit("race_payouts").alias("target_table"), "s"))
    )
    return limits.join(sums, "target_table").withColumn("checksum", F.col("s").cast("double")).drop("s")
