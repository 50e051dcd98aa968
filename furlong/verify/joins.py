"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.operators import joins as J
from furlong.verify.base import TIE, entries, query, races, runners, table, with_entries, with_runners

ID = ["race_id", "runner_no", "horse_id", "jockey_id"]
ID_SQL = "race_id, runner_no, horse_id, jockey_id"


@query(
    "entry_result_join",
    with_entries(
        """SELECT e.race_id, e.horse_id, e.runner_no, e.odds, f.best_finish, f.n FROM entries e JOIN (
        SELECT race_id, horse_id, min(finish) AS best_finish, count(*) AS n FROM entries WHERE finish IS NOT NULL GROUP BY 1, 2) f
        ON e.race_id = f.race_id AND e.horse_id = f.horse_id"""
    ),
)
def entry_result_join(spark, sf):
    e = entries(spark, sf)
    results = (
        e.filter("finish IS NOT NULL")
        .groupBy("race_id", "horse_id")
        .agg(F.min("finish").alias("best_finish"), F.count(F.lit(1)).alias("n"))
    )
    return J.entry_result(e.select("race_id", "horse_id", "runner_no", "odds"), results)


@query(
    "star_view",
    """SELECT l_orderkey AS race_id, l_linenumber AS runner_no, l_partkey AS horse_id, l_suppkey AS jockey_id, o_custkey AS trainer_id,
      o_orderpriority AS venue, p_name, s_name, c_name, n_name
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10
    LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
    LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def star_view(spark, sf):
    fact = entries(spark, sf).select("race_id", "runner_no", "horse_id", "jockey_id")
    race = races(spark, sf).select("race_id", "trainer_id", "venue")
    horse = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("horse_id"), "p_name")
    jockey = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("jockey_id"), "s_name")
    trainer = (
        table(spark, sf, "customer")
        .filter("c_acctbal > 0")
        .select(F.col("c_custkey").alias("trainer_id"), "c_name", F.col("c_nationkey").alias("nation"))
    )
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return J.star(
        fact, {"race_id": race}, {"horse_id": horse, "jockey_id": jockey, "trainer_id": trainer, "nation": nation}
    ).drop("nation")


@query(
    "parent_fill_join",
    with_entries(
        f"""SELECT {ID_SQL}, coalesce(CASE WHEN runner_no % 2 = 0 THEN surface END, o_orderpriority) AS venue,
        o_totalprice AS prize FROM entries LEFT JOIN orders ON race_id = o_orderkey AND o_custkey % 3 > 0"""
    ),
)
def parent_fill_join(spark, sf):
    child = entries(spark, sf).select(*ID, F.when(F.col("runner_no") % 2 == 0, F.col("surface")).alias("venue"))
    parent = races(spark, sf).filter("trainer_id % 3 > 0").select("race_id", "venue", "prize")
    return J.parent_fill(child, parent, ["race_id"])


# Fixed values of a small course table: venue, surface, distance (none = default), straight, inner bias.
COURSES = [
    ("1-URGENT", "A", 1200, 310.0, 1), ("1-URGENT", "A", 1600, 525.9, 0), ("1-URGENT", "A", 2400, 525.9, 0),
    ("1-URGENT", "R", None, 300.0, 1), ("1-URGENT", "R", 1800, 356.6, 0), ("2-HIGH", "A", None, 473.6, 0),
    ("2-HIGH", "N", 1000, 259.1, 1), ("2-HIGH", "N", 3000, 403.7, 0), ("3-MEDIUM", "R", 1500, 412.5, 0),
    ("5-LOW", "N", 800, 293.0, 1), ("5-LOW", "N", 1600, 310.0, 1), ("5-LOW", "A", 2000, 359.1, 0),
]
_COURSE_VALUES = ", ".join(
    f"('{v}', '{s}', {'NULL' if d is None else d}, {st}, {b})" for v, s, d, st, b in COURSES
)


@query(
    "course_lookup",
    with_runners(
        f""", c(venue, surface, d, straight, bias) AS (VALUES {_COURSE_VALUES}),
        k AS (SELECT DISTINCT venue, surface, distance FROM runners),
        o AS (SELECT k.*, c.straight, c.bias, row_number() OVER (PARTITION BY k.venue, k.surface, k.distance ORDER BY
          CASE WHEN c.d = k.distance THEN 0 WHEN c.straight IS NOT NULL AND c.d IS NULL THEN 1 ELSE 2 END,
          abs(c.d - k.distance), c.d) AS rn
          FROM k LEFT JOIN c ON c.venue = k.venue AND c.surface = k.surface)
        SELECT {ID_SQL}, CAST(coalesce(straight, 300.0) AS DOUBLE) AS straight, coalesce(bias, 0) AS bias,
          CASE WHEN coalesce(bias, 0) = 1 AND runner_no <= 3 THEN 1 ELSE 0 END AS inner_advantage
        FROM runners JOIN o USING (venue, surface, distance) WHERE rn = 1"""
    ),
)
def course_lookup(spark, sf):
    course = spark.createDataFrame(COURSES, "venue string, surface string, distance int, straight double, bias int")
    out = J.course_lookup(
        runners(spark, sf), course, ["venue", "surface"], "distance", {"straight": 300.0, "bias": 0}
    )
    inner = F.col("bias") * (F.col("runner_no") <= 3).cast("int")
    return out.select(*ID, "straight", "bias", inner.alias("inner_advantage"))


@query(
    "null_safe_join_back",
    with_entries(
        f""", n AS (SELECT *, CASE WHEN runner_no <> 3 THEN jockey_id END AS j FROM entries),
        f AS (SELECT j, race_id AS rid, min(qty) AS q FROM n GROUP BY 1, 2)
        SELECT {ID_SQL}, q AS best FROM n LEFT JOIN f ON n.j IS NOT DISTINCT FROM f.j AND n.race_id = rid"""
    ),
)
def null_safe_join_back(spark, sf):
    df = entries(spark, sf).withColumn("j", F.when(F.col("runner_no") != 3, F.col("jockey_id")))
    feats = df.select("j", "race_id", F.col("qty").alias("best"))
    return J.join_back(df, feats, ["j", "race_id"], ["best"]).select(*ID, "best")


@query("races_without_entries", "SELECT o_orderkey AS race_id, o_custkey AS trainer_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def races_without_entries(spark, sf):
    return J.without_children(races(spark, sf), entries(spark, sf), ["race_id"]).select("race_id", "trainer_id")


@query(
    "races_with_entries",
    """SELECT o_orderkey AS race_id, o_custkey AS trainer_id FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01'
      AND CAST(o_orderdate AS DATE) < DATE '1997-01-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def races_with_entries(spark, sf):
    day = races(spark, sf).filter("race_date >= DATE '1996-01-01' AND race_date < DATE '1997-01-01'")
    return J.with_children(day, entries(spark, sf), ["race_id"]).select("race_id", "trainer_id")


@query(
    "drop_flagged",
    with_entries(f"SELECT {ID_SQL} FROM entries WHERE race_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"),
)
def drop_flagged(spark, sf):
    flagged = races(spark, sf).filter("race_class = 'P'").select("race_id")
    return J.drop_flagged(entries(spark, sf), flagged, ["race_id"]).select(*ID)


@query(
    "history_plus_target",
    with_runners(
        """, t AS (SELECT * FROM runners WHERE race_date >= DATE '1998-01-01' AND runner_no < 5)
        SELECT race_id, runner_no, horse_id, finish, odds FROM runners WHERE race_id NOT IN (SELECT race_id FROM t)
        UNION ALL SELECT race_id, runner_no, horse_id, NULL, odds FROM t"""
    ),
)
def history_plus_target(spark, sf):
    history = runners(spark, sf).select("race_id", "runner_no", "horse_id", "finish", "odds", "race_date")
    target = history.filter("race_date >= DATE '1998-01-01' AND runner_no < 5").drop("finish")
    return J.history_plus_target(history, target).drop("race_date")


@query(
    "prediction_outcome_join",
    """WITH p AS (SELECT l_orderkey AS race_id, l_partkey AS horse_id, l_shipdate AS at, l_linenumber AS predicted_rank, l_discount AS p, l_tax AS t, l_extendedprice AS e,
        row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_discount DESC, l_tax DESC, l_extendedprice DESC) AS rn FROM lineitem),
      o AS (SELECT l_orderkey AS race_id, l_partkey AS horse_id, CAST(min(l_quantity) AS INTEGER) AS finish FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
    SELECT race_id, horse_id, predicted_rank, p, o.finish FROM p LEFT JOIN o USING (race_id, horse_id) WHERE rn = 1""",
)
def prediction_outcome_join(spark, sf):
    li = table(spark, sf, "lineitem")
    predictions = li.select(
        F.col("l_orderkey").alias("race_id"), F.col("l_partkey").alias("horse_id"), F.col("l_shipdate").alias("at"),
        F.col("l_linenumber").alias("predicted_rank"), F.col("l_discount").alias("p"), F.col("l_tax").alias("t"),
        F.col("l_extendedprice").alias("e"),
    )
    outcomes = (
        li.filter("l_returnflag <> 'N'")
        .groupBy(F.col("l_orderkey").alias("race_id"), F.col("l_partkey").alias("horse_id"))
        .agg(F.min("l_quantity").cast("int").alias("finish"))
    )
    out = J.prediction_outcome(predictions, outcomes, ["race_id", "horse_id"], ["at"])
    return out.select("race_id", "horse_id", "predicted_rank", "p", "finish")


@query(
    "keyed_compare",
    """WITH e AS (SELECT o_orderkey AS race_id, o_orderstatus AS race_class, o_totalprice AS prize FROM orders),
      c AS (SELECT race_id, CASE WHEN race_id % 3 = 0 THEN 'Z' ELSE race_class END AS race_class FROM e WHERE race_id % 5 <> 0)
    SELECT race_id, e.race_class, c.race_class AS new_race_class, CASE WHEN c.race_id IS NULL THEN 'no-candidate'
      WHEN e.race_class = c.race_class THEN 'keep' ELSE 'update' END AS decision FROM e LEFT JOIN c USING (race_id)""",
)
def keyed_compare(spark, sf):
    existing = races(spark, sf).select("race_id", "race_class")
    new_class = F.when(F.col("race_id") % 3 == 0, F.lit("Z")).otherwise(F.col("race_class"))
    candidates = existing.filter("race_id % 5 <> 0").select("race_id", new_class.alias("race_class"))
    return J.keyed_compare(existing, candidates, ["race_id"], ["race_class"])


@query(
    "cache_availability",
    with_entries(
        f"SELECT {ID_SQL}, CASE WHEN race_id IN (SELECT page_id FROM pages) THEN 'available' ELSE 'missing' END AS cache_status FROM entries"
    ),
)
def cache_availability(spark, sf):
    cache = table(spark, sf, "pages").select(F.col("page_id").alias("race_id"))
    return J.availability(entries(spark, sf).select(*ID), cache, ["race_id"])


_TOP_SQL = """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY price DESC,
  runner_no, horse_id, jockey_id, qty, discount, tax) AS rn FROM entries) WHERE rn <= 4)"""


@query(
    "top_pairs",
    with_entries(
        f"""{_TOP_SQL}
        SELECT 'pair' AS kind, a.race_id, a.runner_no || '-' || b.runner_no AS combination, round((a.odds + b.odds) / 2, 6) AS mean_odds
          FROM top a JOIN top b ON a.race_id = b.race_id AND a.rn < b.rn
        UNION ALL SELECT 'exact', a.race_id, a.runner_no || '→' || b.runner_no, round((a.odds + b.odds) / 2, 6)
          FROM top a JOIN top b ON a.race_id = b.race_id AND a.rn <> b.rn
        UNION ALL SELECT 'triple', a.race_id, a.runner_no || '-' || b.runner_no || '-' || c.runner_no, round((a.odds + b.odds + c.odds) / 3, 6)
          FROM top a JOIN top b ON a.race_id = b.race_id AND a.rn < b.rn JOIN top c ON a.race_id = c.race_id AND b.rn < c.rn"""
    ),
)
def top_pairs(spark, sf):
    df = entries(spark, sf)
    order = [F.desc("price"), *[F.col(c) for c in TIE if c != "price"]]

    def rows(kind, size, ordered, mark):
        legs = ["a", "b", "c"][:size]
        out = J.top_combinations(df, "race_id", order, ["runner_no", "odds"], size, top_n=4, ordered=ordered)
        mean = sum((F.col(f"{x}.odds") for x in legs[1:]), F.col("a.odds")) / size
        return out.select(
            F.lit(kind).alias("kind"),
            "race_id",
            F.concat_ws(mark, *[F.col(f"{x}.runner_no") for x in legs]).alias("combination"),
            F.round(mean, 6).alias("mean_odds"),
        )

    return (
        rows("pair", 2, False, "-").unionByName(rows("exact", 2, True, "→")).unionByName(rows("triple", 3, False, "-"))
    )
