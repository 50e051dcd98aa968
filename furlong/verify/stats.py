"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.functions.racing import distance_band, month_season
from furlong.operators import audit as A
from furlong.operators import stats as S
from furlong.verify.base import audit_grains, audit_rows, entries, query, r, races, runners, table, with_audit, with_entries, with_runners

ID = ["race_id", "runner_no", "horse_id", "jockey_id"]
ID_SQL = "race_id, runner_no, horse_id, jockey_id"


@query(
    "bet_stats",
    """WITH b AS (SELECT event_type AS bet_type, CASE WHEN month(ts) IN (12, 1, 2) THEN '冬' WHEN month(ts) < 6 THEN '春' WHEN month(ts) < 9 THEN '夏' ELSE '秋' END AS season,
        CAST(round(value * 100) AS BIGINT) AS cost, CASE WHEN user_id % 4 = 0 THEN CAST(round(value * 100) AS BIGINT) * 3 ELSE 0 END AS ret, CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS hit FROM events),
      g AS (SELECT CASE WHEN grouping(bet_type) = 0 THEN 'bet_type' WHEN grouping(season) = 0 THEN 'season' ELSE 'all' END AS dimension, coalesce(bet_type, season) AS value,
        count(*) AS count, CAST(sum(cost) AS BIGINT) AS total_cost, CAST(sum(ret) AS BIGINT) AS total_return, CAST(sum(hit) AS BIGINT) AS hit_count
        FROM b GROUP BY GROUPING SETS ((bet_type), (season), ()))
    SELECT *, CASE WHEN total_cost > 0 THEN round(total_return / CAST(total_cost AS DOUBLE) * 100, 1) ELSE 0.0 END AS recovery_rate,
      round(hit_count / CAST(count AS DOUBLE) * 100, 1) AS hit_rate FROM g""",
)
def bet_stats(spark, sf):
    cents = F.round(F.col("value") * 100).cast("bigint")
    hit = F.col("user_id") % 4 == 0
    bets = table(spark, sf, "events").select(
        F.col("event_type").alias("bet_type"),
        month_season(F.col("ts")).alias("season"),
        cents.alias("total_cost"),
        F.when(hit, cents * 3).otherwise(F.lit(0)).alias("actual_return"),
        hit.cast("int").alias("is_hit"),
    )
    return S.bet_stats(bets)


@query(
    "table_stats",
    """SELECT count(*) AS n_rows, count(DISTINCT json_extract_string(props, '$.k')) AS n_keys, max(json_extract_string(props, '$.k')) AS latest FROM events""",
)
def table_stats(spark, sf):
    return S.table_stats(table(spark, sf, "events"), "props", "k", "k")


@query(
    "field_size",
    with_entries(
        f"""SELECT {ID_SQL}, CAST(coalesce(CASE WHEN runner_no = 2 THEN 18 END, count(*) OVER (PARTITION BY race_id)) AS BIGINT) AS field_size FROM entries"""
    ),
)
def field_size(spark, sf):
    df = entries(spark, sf).withColumn("declared", F.when(F.col("runner_no") == 2, F.lit(18).cast("bigint")))
    return S.field_size(df, "race_id", "declared").select(*ID, "field_size")


@query(
    "payout_pivot",
    """SELECT l_orderkey AS race_id, min(CASE WHEN l_returnflag = 'A' AND p > 0 THEN p END) AS win_min, min(CASE WHEN l_returnflag = 'N' AND p > 0 THEN p END) AS place_min,
      max(CASE WHEN l_returnflag = 'N' AND p > 0 THEN p END) AS place_max, min(CASE WHEN l_returnflag = 'R' AND p > 0 THEN p END) AS trifecta_min
    FROM (SELECT *, CASE WHEN l_quantity > 5 THEN l_extendedprice ELSE 0 END AS p FROM lineitem) GROUP BY 1""",
)
def payout_pivot(spark, sf):
    df = entries(spark, sf).select("race_id", "surface", F.when(F.col("qty") > 5, F.col("price")).otherwise(0.0).alias("payout"))
    columns = {
        "win_min": ("A", "min"),
        "place_min": ("N", "min"),
        "place_max": ("N", "max"),
        "trifecta_min": ("R", "min"),
    }
    return S.payout_pivot(df, "race_id", "surface", "payout", columns)


_GATE_SQL = """, g AS (SELECT *, CASE WHEN distance <= 1200 THEN 'sprint' WHEN distance <= 1600 THEN 'mile' WHEN distance <= 2200 THEN 'middle' ELSE 'long' END AS band,
  CASE WHEN runner_no <= 3 THEN 1 ELSE 0 END AS inner_gate FROM runners)"""


def _gates(spark, sf):
    return (
        runners(spark, sf)
        .withColumn("band", distance_band(F.col("distance")))
        .withColumn("inner_gate", (F.col("runner_no") <= 3).cast("int"))
    )


@query(
    "gate_bias",
    with_runners(
        f"""{_GATE_SQL}
        SELECT {ID_SQL}, CASE WHEN count(*) OVER w >= 10 THEN round(sum(CASE WHEN finish = 1 THEN 1.0 ELSE 0 END) OVER w / count(*) OVER w, 6) ELSE 0.5 END AS gate_win_rate
        FROM g WINDOW w AS (PARTITION BY venue, band, surface, inner_gate)"""
    ),
)
def gate_bias(spark, sf):
    out = S.gate_bias(_gates(spark, sf), ["venue", "band", "surface", "inner_gate"])
    return out.select(*ID, r("gate_win_rate"))


@query(
    "gate_bias_as_of",
    with_runners(
        f"""{_GATE_SQL}, t AS (SELECT venue, band, surface, inner_gate, race_date, race_id, sum(CASE WHEN finish = 1 THEN 1.0 ELSE 0 END) AS w, count(*) AS n FROM g GROUP BY ALL),
        p AS (SELECT * EXCLUDE (w, n), sum(w) OVER k AS w, sum(n) OVER k AS n FROM t WINDOW k AS (PARTITION BY venue, band, surface, inner_gate
          ORDER BY race_date, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT g.race_id, runner_no, horse_id, jockey_id, CASE WHEN n >= 10 THEN round(w / n, 6) ELSE 0.5 END AS gate_win_rate
        FROM g JOIN p USING (venue, band, surface, inner_gate, race_id)"""
    ),
)
def gate_bias_as_of(spark, sf):
    out = S.gate_bias(_gates(spark, sf), ["venue", "band", "surface", "inner_gate"], as_of=True)
    return out.select(*ID, r("gate_win_rate"))


@query(
    "prediction_stats",
    with_entries(
        """, p AS (SELECT race_id, count(f) > 0 AS decided, max(CASE WHEN runner_no = 1 AND f = 1 THEN 1 ELSE 0 END) AS won,
          max(CASE WHEN runner_no = 1 AND f BETWEEN 1 AND 3 THEN 1 ELSE 0 END) AS placed, max(CASE WHEN runner_no = 1 AND f = 1 THEN o END) AS paid,
          max(CASE WHEN runner_no = 1 THEN discount * o END) AS ev FROM (SELECT *, CASE WHEN surface <> 'N' THEN finish END AS f, CAST(qty AS INTEGER) + 1.0::DOUBLE AS o FROM entries) GROUP BY 1)
        SELECT count(*) AS races, count(*) FILTER (decided) AS decided, round(100.0::DOUBLE * sum(won) FILTER (decided) / count(*) FILTER (decided), 1) AS top1_win_rate,
          round(100.0::DOUBLE * sum(placed) FILTER (decided) / count(*) FILTER (decided), 1) AS top1_in3_rate,
          round(100.0::DOUBLE * coalesce(sum(paid) FILTER (decided), 0) / count(*) FILTER (decided), 1) AS roi, round(avg(ev), 3) AS average_ev,
          round(100.0::DOUBLE * count(*) FILTER (ev >= 1) / count(ev), 1) AS positive_ev_rate FROM p"""
    ),
)
def prediction_stats(spark, sf):
    df = (
        entries(spark, sf)
        .withColumn("f", F.when(F.col("surface") != "N", F.col("finish")))
        .withColumn("o", F.col("qty").cast("int") + 1.0)
    )
    return S.prediction_stats(df, "race_id", "runner_no", "f", "o", "discount")


@query(
    "backtest_roi",
    with_entries(
        """, k AS (SELECT *, rank() OVER (PARTITION BY race_id ORDER BY price DESC) AS rk, CASE WHEN runner_no <> 4 THEN discount END AS p FROM entries),
        a AS (SELECT count(*) AS races, round(avg(m), 6) AS winner_in_top3 FROM (SELECT race_id, max(CASE WHEN finish = 1 AND rk <= 3 THEN 1.0 ELSE 0 END) AS m FROM k GROUP BY 1))
        SELECT count(*) AS picks, round(avg(CASE WHEN finish = 1 THEN 1.0 ELSE 0 END), 6) AS top1_win, round(avg(CASE WHEN finish <= 3 THEN 1.0 ELSE 0 END), 6) AS top1_show,
          round(sum(CASE WHEN finish = 1 THEN 100 / greatest(coalesce(p, 0.1), 0.02) ELSE 0 END) / (count(*) * 100), 6) AS roi, max(races) AS races, max(winner_in_top3) AS winner_in_top3
        FROM k, a WHERE rk = 1"""
    ),
)
def backtest_roi(spark, sf):
    df = entries(spark, sf).withColumn("p", F.when(F.col("runner_no") != 4, F.col("discount")))
    return S.backtest_roi(df, "race_id", "price", "finish", "p")


@query(
    "hit_roi",
    with_entries(
        """SELECT count(*) AS n, round(avg(h), 6) AS hit_rate, round(avg(q), 6) AS mean_roi FROM (SELECT CASE WHEN finish IS NOT NULL THEN CASE WHEN finish = 1 THEN 1.0 ELSE 0 END END AS h,
        CASE WHEN runner_no <> 3 THEN qty END AS q FROM entries) WHERE h IS NOT NULL AND q IS NOT NULL"""
    ),
)
def hit_roi(spark, sf):
    df = entries(spark, sf).select(
        F.coalesce((F.col("finish") == 1).cast("int").cast("string"), F.lit("-")).alias("hit"),
        F.when(F.col("runner_no") == 3, F.lit("n/a")).otherwise(F.col("qty").cast("string")).alias("roi"),
    )
    return S.hit_roi(df, "hit", "roi")


@query(
    "date_coverage",
    """SELECT min(substr(d, 1, 6)) FILTER (o_orderkey % 5 <> 0) AS first_month, max(substr(d, 1, 6)) FILTER (o_orderkey % 5 <> 0) AS last_month,
      min(d) FILTER (o_orderkey % 5 > 1) AS first_day, max(d) FILTER (o_orderkey % 5 > 1) AS last_day
    FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d FROM orders)""",
)
def date_coverage(spark, sf):
    k, day = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyyMMdd")
    text = F.when(k == 0, F.lit("20xx0101")).when(k == 1, F.date_format("o_orderdate", "yyyyMM")).otherwise(day)
    return S.date_coverage(table(spark, sf, "orders").select(text.alias("day")), "day")


# How much each audited field is needed, written out here so that the SQL does not follow the operator.
LEVELS = {
    "race_id": "required",
    "race_date": "required",
    "venue": "required",
    "race_number": "required",
    "horse_id": "required",
    "horse_name": "required",
    "frame_number": "required",
    "horse_number": "required",
    "finish_position": "required_if_result",
    "result_time": "required_if_result",
    "margin": "required_if_result",
    "odds": "important_warn",
    "popularity": "important_warn",
    "horse_weight": "important_warn",
    "jockey": "important_warn",
    "trainer": "important_warn",
    "sire": "important_warn",
    "dam": "important_warn",
    "broodmare_sire": "important_warn",
}
REQUIRED = [f for f, level in LEVELS.items() if level != "important_warn"]
_FIELD_SQL = {f: f"({f} IS NULL OR trim({f}) = '')" for f in LEVELS}
_PLACED = "regexp_matches(trim(coalesce(finish_position, '')), '^[0-9]+$')"


def allowed_sql(f):
    return {
        "margin": f"(trim(coalesce(finish_position, '')) = '1' OR NOT {_PLACED})",
        "result_time": f"(NOT {_PLACED})",
        "finish_position": "(source_page_type = 'entry')",
    }.get(f, "false")


def kind_sql(f):
    derivable = "race_number_derived IS NOT NULL" if f == "race_number" else "false"
    return (
        f"CASE WHEN {_FIELD_SQL[f]} THEN CASE WHEN {allowed_sql(f)} THEN 'domain' WHEN {derivable} THEN 'derivable' "
        "ELSE 'true' END END"
    )


GAPS_SQL = "gaps AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS col, '{LEVELS[f]}' AS lev, {kind_sql(f)} AS kind, race_id || ':' || trim(horse_id) AS key FROM audit"
    for f in _FIELD_SQL
) + ")"


MISSINGNESS_SQL = f"""{GAPS_SQL}, al AS (SELECT 'race_number' AS col, race_number_source AS source, count(*) AS n FROM audit
    WHERE NOT {_FIELD_SQL["race_number"]} AND race_number_source NOT IN ('', 'race_number') GROUP BY 2),
  an AS (SELECT col, string_agg(source, ',' ORDER BY source) AS names, count(*) AS n_names, CAST(sum(n) AS BIGINT) AS n_rows FROM al GROUP BY 1),
  m AS (SELECT col, lev, count(*) AS total, count(kind) AS miss, count(*) FILTER (kind = 'domain') AS dom,
    count(*) FILTER (kind = 'derivable') AS der, count(*) FILTER (kind = 'true') AS tru FROM gaps GROUP BY 1, 2),
  ex AS (SELECT col, string_agg(key, ',' ORDER BY key) FILTER (kind = 'true') AS keys, string_agg(key, ',' ORDER BY key) FILTER (kind = 'domain') AS dkeys,
    string_agg(key, ',' ORDER BY key) FILTER (kind = 'derivable') AS vkeys FROM (SELECT col, kind, key, row_number() OVER (PARTITION BY col, kind ORDER BY key) AS rn
    FROM (SELECT DISTINCT col, kind, key FROM gaps WHERE kind IS NOT NULL)) WHERE rn <= 5 GROUP BY col),
  mis AS (SELECT m.col AS "column", lev AS required_level, total AS total_count, miss AS missing_count, dom AS domain_allowed_count, der AS derivable_count, tru AS true_missing_count,
    round(miss / CAST(total AS DOUBLE), 6) AS missing_rate, round(tru / CAST(total AS DOUBLE), 6) AS true_missing_rate,
    CASE WHEN lev = 'important_warn' THEN CASE WHEN tru > 0.1 * total THEN 'warn' ELSE 'pass' END WHEN tru > 0 THEN 'fail' WHEN miss > 0 THEN 'warn' ELSE 'pass' END AS severity,
    coalesce(keys, '') AS example_keys, coalesce(dkeys, '') AS domain_example_keys, coalesce(vkeys, '') AS derivable_example_keys,
    coalesce(names, '') AS alias_candidate, coalesce(n_names, 0) AS alias_count, coalesce(n_rows, 0) AS alias_rows
    FROM m LEFT JOIN ex ON m.col = ex.col LEFT JOIN an ON m.col = an.col)"""


@query("column_missingness", with_audit(f", {MISSINGNESS_SQL} SELECT * FROM mis"))
def column_missingness(spark, sf):
    return A.column_missingness(audit_grains(spark, sf))


@query(
    "alias_candidates",
    with_audit(
        f""" SELECT 'race_number' AS "column", race_number_source AS source, count(*) AS n_rows FROM audit
        WHERE NOT {_FIELD_SQL["race_number"]} AND coalesce(race_number_source, '') NOT IN ('', 'race_number') GROUP BY 2"""
    ),
)
def alias_candidates(spark, sf):
    return A.alias_candidates(audit_grains(spark, sf)).withColumnRenamed("rows", "n_rows")


@query(
    "group_missingness",
    with_audit(
        ", m AS (SELECT *, CASE WHEN "
        + " OR ".join(_FIELD_SQL[f] for f in REQUIRED)
        + " THEN 1 ELSE 0 END AS gap FROM audit) "
        + " UNION ALL ".join(
            f"SELECT '{k}' AS group_key, coalesce({k}, '') AS group_value, count(*) AS n_rows, CAST(sum(gap) AS BIGINT) AS n_missing, "
            f"round(sum(gap) / CAST(count(*) AS DOUBLE), 6) AS missing_rate FROM m GROUP BY 2"
            for k in S.GROUP_KEYS
        )
    ),
)
def group_missingness(spark, sf):
    return S.group_missingness(audit_rows(spark, sf))


@query(
    "reason_breakdown",
    """WITH g AS (SELECT CASE WHEN event_type = 'error' THEN 'refetch' ELSE 'skip' END AS action, event_type AS reason,
      CASE WHEN user_id % 3 = 0 THEN 'P0' WHEN user_id % 3 = 1 THEN 'P1' ELSE 'P2' END AS priority, count(*) AS count FROM events GROUP BY ALL)
    SELECT *, CAST(sum(count) OVER (PARTITION BY priority) AS BIGINT) AS priority_total FROM g""",
)
def reason_breakdown(spark, sf):
    u = F.col("user_id") % 3
    df = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.lit("refetch")).otherwise(F.lit("skip")).alias("action"),
        F.col("event_type").alias("reason"),
        F.when(u == 0, F.lit("P0")).when(u == 1, F.lit("P1")).otherwise(F.lit("P2")).alias("priority"),
    )
    return S.reason_breakdown(df, ["action", "reason", "priority"])


@query(
    "overview_counts",
    """WITH f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
      h AS (SELECT l_partkey, max(CASE WHEN l_discount > 0.09 THEN l_returnflag END) AS s FROM lineitem GROUP BY 1)
    SELECT (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders) AS days, (SELECT count(DISTINCT o_orderkey) FROM orders) AS races,
      (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS races_without_runners,
      (SELECT count(*) FROM h) AS horses, (SELECT count(*) FROM h WHERE s IS NULL) AS horses_without_pedigree,
      (SELECT min(n) FROM f) AS min_field, (SELECT max(n) FROM f) AS max_field, (SELECT round(avg(n), 6) FROM f) AS avg_field""",
)
def overview_counts(spark, sf):
    rows = entries(spark, sf).select(
        "race_id", "horse_id", F.when(F.col("discount") > 0.09, F.col("surface")).alias("sire")
    )
    return S.overview(races(spark, sf), rows, "race_id", "race_date", "horse_id", "sire")
