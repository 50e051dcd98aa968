"""Sorted reads, samples, one-per-key choices and the document contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.operators import lookup as L
from furlong.verify.base import TIE, entries, query, r, races, table, with_entries

ID = ["race_id", "runner_no", "horse_id", "jockey_id"]
ID_SQL = "race_id, runner_no, horse_id, jockey_id"
TIE_SQL = "runner_no, horse_id, jockey_id, price, qty, discount, tax"


@query(
    "recent_races",
    "SELECT o_orderkey AS race_id, o_orderpriority AS venue, o_totalprice AS prize FROM orders ORDER BY o_orderkey DESC LIMIT 50",
)
def recent_races(spark, sf):
    return L.recent(races(spark, sf), ["race_id"], 50).select("race_id", "venue", "prize")


@query("race_card", with_entries(f"SELECT {ID_SQL}, odds, finish FROM entries"))
def race_card(spark, sf):
    return L.race_card(entries(spark, sf), ["horse_id", "jockey_id", "odds", "finish"])


@query("race_card_lookup", with_entries(f"SELECT {ID_SQL}, odds, finish FROM entries WHERE race_id = (SELECT max(l_orderkey) FROM lineitem)"))
def race_card_lookup(spark, sf):
    """The card of the last race: a lookup by key, which the scan gets as a pushed filter."""
    rows = entries(spark, sf)
    last = rows.agg(F.max("race_id")).first()[0]
    return L.race_card(rows, ["horse_id", "jockey_id", "odds", "finish"], only=last)


@query(
    "race_bundle",
    """WITH e AS (SELECT l_orderkey AS k, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS e FROM lineitem GROUP BY 1),
      p AS (SELECT l_orderkey AS k, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey AS race_id, coalesce(e, '') AS entries, coalesce(p, '') AS payouts FROM orders LEFT JOIN e ON o_orderkey = e.k LEFT JOIN p ON o_orderkey = p.k""",
)
def race_bundle(spark, sf):
    e = entries(spark, sf)
    out = L.race_bundle(
        races(spark, sf).select("race_id"),
        {"entries": (e, ["runner_no", "horse_id"]), "payouts": (e.filter("surface = 'R'"), ["jockey_id"])},
        "race_id",
    )
    return out.select(
        "race_id",
        F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x["runner_no"], x["horse_id"])), ",").alias("entries"),
        F.array_join(F.transform("payouts", lambda x: x["jockey_id"].cast("string")), ",").alias("payouts"),
    )


@query(
    "score_topk",
    with_entries(
        f"SELECT {ID_SQL}, price, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY race_id ORDER BY price DESC, runner_no, horse_id, jockey_id, qty, discount, tax) AS INTEGER) AS position FROM entries) WHERE position <= 3"
    ),
)
def score_topk(spark, sf):
    ties = [c for c in TIE if c != "price"]
    return L.score_topk(entries(spark, sf), "race_id", "price", ties, 3).select(*ID, "price", "position")


@query(
    "sample_per_group",
    """SELECT event_id, event_type, user_id, CAST(sample_no AS INTEGER) AS sample_no FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) AS sample_no FROM events) WHERE sample_no <= 10""",
)
def sample_per_group(spark, sf):
    ev = table(spark, sf, "events").withColumn("action", F.col("user_id") % 3)
    out = L.sample_per_group(ev, ["event_type", "action"], ["ts", "event_id"], 10)
    return out.select("event_id", "event_type", "user_id", "sample_no")


@query(
    "bet_sort_split",
    """SELECT CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'pending' END AS state, event_id, user_id, value FROM events""",
)
def bet_sort_split(spark, sf):
    done = F.when(F.col("event_type") != "view", F.col("event_type") == "purchase")
    order = [F.desc("value"), F.col("ts"), F.col("event_id")]
    pending, completed = L.split_bets(table(spark, sf, "events"), done, order)
    cols = ["event_id", "user_id", "value"]
    return pending.select(F.lit("pending").alias("state"), *cols).unionByName(
        completed.select(F.lit("completed").alias("state"), *cols)
    )


@query(
    "dedupe_priority",
    r"""SELECT url, priority, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority, page_id) AS rn FROM
      (SELECT regexp_replace(url, '[?#].*$', '') AS url, CASE WHEN page_id % 3 = 0 THEN 'P1' ELSE 'P0' END AS priority, page_id FROM pages)) WHERE rn = 1""",
)
def dedupe_priority(spark, sf):
    cand = table(spark, sf, "pages").select(
        F.regexp_replace("url", r"[?#].*$", "").alias("url"),
        F.when(F.col("page_id") % 3 == 0, F.lit("P1")).otherwise(F.lit("P0")).alias("priority"),
        "page_id",
    )
    return L.dedupe_priority(cand, ["url"], ["priority", "page_id"])


CONTRACT = {
    "raceId": "int", "venue_name": "str", "distance": "int", "odds": "float", "popularity": "int",
    "user_id": "str", "margin": "str",
}


@query(
    "contract_check",
    with_entries(
        """, n AS (SELECT count(*) AS n, count(*) FILTER (runner_no = 2) AS n2, count(*) FILTER (runner_no = 3) AS n3,
           count(*) FILTER (finish IS NULL) AS nf FROM entries)
        SELECT * FROM (
        SELECT 'raceid' AS field, 'int' AS expected_type, n AS present, 0::BIGINT AS missing, 0::BIGINT AS wrong_type, 0::BIGINT AS unknown, 'ok' AS status FROM n
        UNION ALL SELECT 'venuename', 'str', n, 0, 0, n3, CASE WHEN n3 > 0 THEN 'incomplete' ELSE 'ok' END FROM n
        UNION ALL SELECT 'distance', 'int', n, 0, n2, 0, CASE WHEN n2 > 0 THEN 'type-mismatch' ELSE 'ok' END FROM n
        UNION ALL SELECT 'odds', 'float', n, 0, 0, 0, 'ok' FROM n
        UNION ALL SELECT 'popularity', 'int', n - nf, nf, 0, 0, CASE WHEN nf > 0 THEN 'incomplete' ELSE 'ok' END FROM n
        UNION ALL SELECT 'userid', 'str', 0, n, 0, 0, 'missing' FROM n
        UNION ALL SELECT 'margin', 'str', 0, n, 0, 0, 'missing' FROM n
        UNION ALL SELECT 'note', NULL, n, 0, NULL, 0, 'extra' FROM n)"""
    ),
)
def contract_check(spark, sf):
    no = F.col("runner_no")
    half = F.when(no == 5, F.lit("7")).otherwise(F.lit("7.25"))
    venue = F.when(no == 3, F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("surface"), F.lit('"')))
    distance = F.when(no == 2, F.lit('"1200"')).otherwise(F.lit("1200"))
    popularity = F.when(F.col("finish").isNotNull(), F.concat(F.lit(', "popularity": '), F.col("finish")))
    doc = F.concat(
        F.lit('{"race_id": '), F.col("race_id"), F.lit(', "Venue-Name": '), venue, F.lit(', "distance": '), distance,
        F.lit(', "odds": '), half, F.lit(', "note": [1, 2]'), F.coalesce(popularity, F.lit("")), F.lit("}"),
    )
    return L.contract_check(entries(spark, sf).select(doc.alias("data")), "data", CONTRACT)
