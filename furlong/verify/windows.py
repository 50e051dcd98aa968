"""Window queries: within a race, and over an entity's earlier races."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.operators import history as H
from furlong.operators import within_group as G
from furlong.verify.base import TIE, entries, query, r, runners, table, with_entries, with_runners

ID = ["race_id", "runner_no", "horse_id", "jockey_id"]
ID_SQL = "race_id, runner_no, horse_id, jockey_id"
TIE_SQL = "runner_no, horse_id, jockey_id, price, qty, discount, tax"


# ---- within a race ----------------------------------------------------------


@query(
    "norm_prob",
    with_entries(
        f"SELECT {ID_SQL}, round(1 / odds / sum(1 / odds) OVER (PARTITION BY race_id), 6) AS norm_prob FROM entries"
    ),
)
def norm_prob(spark, sf):
    df = entries(spark, sf).withColumn("implied", F.when(F.col("odds") > 0, 1 / F.col("odds")))
    return G.normalise(df, ["race_id"], "implied", "norm_prob").select(*ID, r("norm_prob"))


@query(
    "odds_rank",
    with_entries(
        f"""SELECT {ID_SQL}, CAST(rank() OVER (PARTITION BY race_id ORDER BY o ASC NULLS LAST) AS BIGINT) AS odds_rank
        FROM (SELECT *, CASE WHEN runner_no <> 3 THEN odds END AS o FROM entries)"""
    ),
)
def odds_rank(spark, sf):
    df = entries(spark, sf).withColumn("o", F.when(F.col("runner_no") != 3, F.col("odds")))
    return G.odds_rank(df, ["race_id"], "o", "odds_rank").select(*ID, "odds_rank")


@query(
    "zscore_in_group",
    with_runners(
        f"""SELECT {ID_SQL},
        round((odds - avg(odds) OVER w) / (stddev_samp(odds) OVER w + 1e-8), 4) + 0.0 AS odds_z,
        round(CASE WHEN count(*) OVER g > 1 THEN (qty - avg(qty) OVER g) / (stddev_samp(qty) OVER g + 1e-8)
              ELSE 0.0 END, 4) + 0.0 AS speed_z
        FROM runners WINDOW w AS (PARTITION BY race_id), g AS (PARTITION BY surface, distance)"""
    ),
)
def zscore_in_group(spark, sf):
    base = runners(spark, sf)
    df = G.zscore(base, ["race_id"], "odds", "odds_z")
    df = G.zscore(df, ["surface", "distance"], "qty", "speed_z", zero_for_single=True, source=base)
    return df.select(*ID, r("odds_z", 4), r("speed_z", 4))


@query(
    "market_entropy",
    with_entries(
        """, q AS (SELECT race_id, 1 / odds AS q, sum(1 / odds) OVER (PARTITION BY race_id) AS t,
          count(*) OVER (PARTITION BY race_id) AS k,
          row_number() OVER (PARTITION BY race_id ORDER BY odds) AS rn FROM entries)
        SELECT race_id,
          CASE WHEN max(k) >= 2 THEN round(sum(-(q / t) * ln(q / t + 1e-10)), 6) ELSE 0.0 END AS market_entropy,
          CASE WHEN max(k) >= 2 THEN round(sum(CASE WHEN rn <= 3 THEN q / t END), 6) ELSE 0.5 END AS top3_probability
        FROM q GROUP BY race_id"""
    ),
)
def market_entropy(spark, sf):
    out = G.market_entropy(entries(spark, sf))
    return out.select("race_id", r("market_entropy"), r("top3_probability"))


@query(
    "last3f_rank",
    with_entries(
        f"""SELECT {ID_SQL}, closing,
        CASE WHEN closing IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY race_id
          ORDER BY closing ASC NULLS LAST, {TIE_SQL}) AS BIGINT) END AS last3f_rank
        FROM (SELECT *, CASE WHEN qty <= 45 THEN qty END AS closing FROM entries)"""
    ),
)
def last3f_rank(spark, sf):
    df = entries(spark, sf).withColumn("closing", F.when(F.col("qty") <= 45, F.col("qty")))
    ties = [F.col(c) for c in TIE]
    return G.closing_rank(df, "race_id", "closing", "last3f_rank", ties).select(*ID, "closing", "last3f_rank")


# ---- earlier races ----------------------------------------------------------


def prior_sql(keys: str, sums: str, src: str = "runners") -> str:
    """Totals per (keys, race), then totals of the races before."""
    on = " AND ".join(f"x.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    names = [s.split(" AS ")[1].strip() for s in sums.split(";")]
    grain = ", ".join(s.strip() for s in sums.split(";"))
    run = ", ".join(
        f"""coalesce(sum({n}) OVER (PARTITION BY {keys} ORDER BY race_date, race_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {n}"""
        for n in names
    )
    return f"""(SELECT x.*, {", ".join("p." + n for n in names)} FROM {src} x JOIN (
      SELECT {keys}, race_date, race_id, {run} FROM (
        SELECT {keys}, race_date, race_id, {grain} FROM {src} GROUP BY {keys}, race_date, race_id)) p
      ON {on} AND x.race_id = p.race_id)"""


WON = "sum(CASE WHEN finish = 1 THEN 1 ELSE 0 END)"


def _rate(num: str, den: str, alias: str, default: str = "0.0") -> str:
    return f"CASE WHEN {den} > 0 THEN round({num} / CAST({den} AS DOUBLE), 6) ELSE {default} END AS {alias}"


@query(
    "expanding_rate",
    with_runners(
        ", a AS "
        + prior_sql("jockey_id, venue", f"{WON} AS w1; count(*) AS n1")
        + ", b AS "
        + prior_sql("horse_id, surface", f"{WON} AS w2; count(*) AS n2", "a")
        + f""" SELECT {ID_SQL}, {_rate("w1", "n1", "jockey_venue_win_rate")}, CAST(n1 AS BIGINT) AS jockey_venue_count,
        {_rate("w2", "n2", "horse_surface_win_rate")}, CAST(n2 AS BIGINT) AS horse_surface_count FROM b"""
    ),
)
def expanding_rate(spark, sf):
    base = runners(spark, sf)
    df = H.expanding_rate(base, ["jockey_id", "venue"], "jockey_venue")
    df = H.expanding_rate(df, ["horse_id", "surface"], "horse_surface", source=base)
    return df.select(
        *ID,
        r("jockey_venue_win_rate"),
        "jockey_venue_count",
        r("horse_surface_win_rate"),
        "horse_surface_count",
    )


@query(
    "expanding_multi",
    with_runners(
        ", a AS "
        + prior_sql("horse_id, distance", f"{WON} AS w; count(*) AS n; sum(coalesce(finish, 0)) AS f")
        + f""" SELECT {ID_SQL}, {_rate("w", "n", "horse_distance_win_rate")},
        CAST(n AS BIGINT) AS horse_distance_count,
        {_rate("f", "n", "horse_distance_avg_finish", "NULL")} FROM a"""
    ),
)
def expanding_multi(spark, sf):
    df = H.expanding_multi(runners(spark, sf), ["horse_id", "distance"], "horse_distance", null_as_zero=True)
    return df.select(
        *ID, r("horse_distance_win_rate"), "horse_distance_count", r("horse_distance_avg_finish")
    )


_TOP = "sum(CASE WHEN finish BETWEEN 1 AND {0} THEN 1 ELSE 0 END) AS {1}{0}"


@query(
    "entity_career",
    with_runners(
        ", a AS "
        + prior_sql(
            "jockey_id",
            ";".join(_TOP.format(n, "j") for n in (1, 2, 3)) + "; count(*) AS jn",
        )
        + ", b AS "
        + prior_sql("sire", ";".join(_TOP.format(n, "s") for n in (1, 2, 3)) + "; count(*) AS sn", "a")
        + f""" SELECT {ID_SQL}, {_rate("j1", "jn", "jockey_win_rate")}, {_rate("j2", "jn", "jockey_top2_rate")},
        {_rate("j3", "jn", "jockey_top3_rate")}, CAST(jn AS BIGINT) AS jockey_race_count,
        {_rate("s1", "sn", "sire_win_rate")}, {_rate("s2", "sn", "sire_top2_rate")},
        {_rate("s3", "sn", "sire_top3_rate")}, CAST(sn AS BIGINT) AS sire_race_count FROM b"""
    ),
)
def entity_career(spark, sf):
    base = runners(spark, sf)
    df = H.entity_career(base, "jockey_id", "jockey")
    df = H.entity_career(df, "sire", "sire", source=base)
    cols = [f"{p}_{k}_rate" for p in ("jockey", "sire") for k in ("win", "top2", "top3")]
    return df.select(*ID, *[r(c) for c in cols], "jockey_race_count", "sire_race_count")


@query(
    "pair_smoothed",
    with_runners(
        ", a AS "
        + prior_sql("jockey_id, sire", f"{WON} AS w; count(*) AS n")
        + f""" SELECT {ID_SQL}, CAST(n AS BIGINT) AS combo_count, {_rate("w", "n", "combo_win_rate")},
        round((w + 5 * 0.075) / (n + 5), 6) AS combo_win_rate_smooth FROM a"""
    ),
)
def pair_smoothed(spark, sf):
    df = H.pair_smoothed(runners(spark, sf), ["jockey_id", "sire"], "combo")
    return df.select(*ID, "combo_count", r("combo_win_rate"), r("combo_win_rate_smooth"))


@query(
    "entity_stats_default",
    with_runners(
        ", a AS "
        + prior_sql(
            "trainer_id",
            f"{WON} AS w; count(*) AS n; sum(finish) AS f; count(finish) AS m",
        )
        + f""" SELECT {ID_SQL}, {_rate("w", "n", "trainer_win_rate")}, CAST(n AS BIGINT) AS trainer_count,
        {_rate("f", "m", "trainer_avg_finish", "8.0")} FROM a"""
    ),
)
def entity_stats_default(spark, sf):
    df = H.expanding_multi(runners(spark, sf), ["trainer_id"], "trainer", defaults=(0.0, 0, 8.0))
    return df.select(*ID, r("trainer_win_rate"), "trainer_count", r("trainer_avg_finish"))


@query(
    "days_since_last",
    with_runners(
        f""", starts AS (SELECT DISTINCT horse_id, race_id, race_date FROM runners),
        gaps AS (SELECT horse_id, race_id, date_diff('day',
          lag(race_date) OVER (PARTITION BY horse_id ORDER BY race_date, race_id), race_date) AS g FROM starts)
        SELECT {ID_SQL}, CASE WHEN g > 0 THEN CAST(g AS BIGINT) END AS days_since_last
        FROM runners JOIN gaps USING (horse_id, race_id)"""
    ),
)
def days_since_last(spark, sf):
    return H.days_since_last(runners(spark, sf)).select(*ID, "days_since_last")


def last_sql(expr: str, n: int, to: int = 1) -> str:
    return (
        f"{expr} OVER (PARTITION BY {{e}} ORDER BY race_date, race_id, {TIE_SQL} "
        f"ROWS BETWEEN {n} PRECEDING AND {to} PRECEDING)"
    )


def roll(entity: str, stats: dict[str, str], select: str, extra: str = "") -> str:
    body = ", ".join(f"{v} AS {k}" for k, v in stats.items()).replace("{e}", entity)
    return with_runners(
        f""", src AS (SELECT *{extra} FROM runners),
        per_row AS (SELECT *, {body},
          row_number() OVER (PARTITION BY {entity}, race_date, race_id ORDER BY {TIE_SQL}) AS first_no FROM src),
        firsts AS (SELECT {entity} AS e_id, race_id AS e_race, {select} FROM per_row WHERE first_no = 1)
        SELECT src.race_id, src.runner_no, src.horse_id, src.jockey_id, firsts.* EXCLUDE (e_id, e_race)
        FROM src JOIN firsts ON src.{entity} = e_id AND src.race_id = e_race"""
    )


_WIN = "CASE WHEN finish = 1 THEN 1.0 WHEN finish IS NOT NULL THEN 0.0 END"


@query(
    "rolling_form",
    roll(
        "horse_id",
        {f"a{n}": last_sql("avg(finish)", n) for n in (3, 5, 10)}
        | {f"w{n}": last_sql(f"avg({_WIN})", n) for n in (3, 5)},
        "round(a3, 6) AS avg_finish_3, round(a5, 6) AS avg_finish_5, round(a10, 6) AS avg_finish_10, "
        "round(w3, 6) AS win_rate_3, round(w5, 6) AS win_rate_5",
    ),
)
def rolling_form(spark, sf):
    df = H.recent_form(runners(spark, sf), "horse_id", TIE)
    cols = ["avg_finish_3", "avg_finish_5", "avg_finish_10", "win_rate_3", "win_rate_5"]
    return df.select(*ID, *[r(c) for c in cols])


@query(
    "rolling_rate_30",
    roll(
        "jockey_id",
        {"a": last_sql(f"avg({_WIN})", 30), "n": last_sql("count(finish)", 30)},
        "CASE WHEN n >= 5 THEN round(a, 6) END AS jockey_recent30",
    ),
)
def rolling_rate_30(spark, sf):
    df = H.recent_rate(runners(spark, sf), "jockey_id", "jockey_recent30", TIE)
    return df.select(*ID, r("jockey_recent30"))


CLOSING_SQL = ", CASE WHEN qty <= 45 THEN 33 + discount * 100 END AS closing, runner_no AS closing_rank"


def with_closing(df):
    return df.withColumn("closing", F.when(F.col("qty") <= 45, 33 + F.col("discount") * 100)).withColumn("closing_rank", F.col("runner_no"))


@query(
    "rolling_last3f",
    roll(
        "horse_id",
        {
            "a3": last_sql("avg(closing)", 3),
            "a5": last_sql("avg(closing)", 5),
            "k3": last_sql("avg(closing_rank)", 3),
        },
        "round(a3, 6) AS closing_avg_3, round(a5, 6) AS closing_avg_5, round(k3, 6) AS closing_rank_avg_3",
        CLOSING_SQL,
    ),
)
def rolling_last3f(spark, sf):
    df = H.recent_closing(with_closing(runners(spark, sf)), "horse_id", "closing", "closing_rank", TIE)
    return df.select(*ID, r("closing_avg_3"), r("closing_avg_5"), r("closing_rank_avg_3"))


@query(
    "rolling_log_payout",
    roll(
        "horse_id",
        {"a": last_sql("avg(ln(1 + coalesce(payout, 0)))", 5)},
        "round(a, 6) AS log_payout_avg_5",
        ", CASE WHEN finish = 1 THEN price END AS payout",
    ),
)
def rolling_log_payout(spark, sf):
    df = runners(spark, sf).withColumn("payout", F.when(F.col("finish") == 1, F.col("price")))
    return H.recent_log_payout(df, "horse_id", "payout", "log_payout_avg_5", TIE).select(
        *ID, r("log_payout_avg_5")
    )


@query(
    "rolling_style",
    roll(
        "horse_id",
        {
            "a": last_sql("avg(style)", 5),
            "s": last_sql("stddev_samp(style)", 5),
            "n": last_sql("count(*)", 5),
        },
        "round(a, 6) AS style_avg_5, CASE WHEN n > 0 THEN round(coalesce(s, 0), 6) END AS style_std_5",
        ", CASE WHEN runner_no < 7 THEN runner_no % 4 END AS style",
    ),
)
def rolling_style(spark, sf):
    df = runners(spark, sf).withColumn("style", F.when(F.col("runner_no") < 7, F.col("runner_no") % 4))
    return H.recent_style(df, "horse_id", "style", TIE).select(*ID, r("style_avg_5"), r("style_std_5"))


_ten = {
    "n": last_sql("count(*)", 10),
    "av": last_sql("avg(finish)", 10),
    "sd": last_sql("stddev_samp(finish)", 10),
    "mi": last_sql("min(finish)", 10),
    "ma": last_sql("max(finish)", 10),
    "p": last_sql("avg(popularity)", 10),
    "r3": last_sql("avg(finish)", 3),
    "o7": last_sql("avg(finish)", 10, 4),
} | {
    f"w{k}": last_sql(f"sum(CASE WHEN finish BETWEEN 1 AND {k} THEN 1 ELSE 0 END)", 10) for k in (1, 2, 3)
}


@query(
    "past10_panel",
    roll(
        "horse_id",
        _ten,
        """CAST(n AS BIGINT) AS past10_count,
        CASE WHEN n > 0 THEN round(av, 6) ELSE 0.0 END AS past10_avg_finish,
        CASE WHEN n > 1 THEN round(sd, 6) ELSE 0.0 END AS past10_std_finish,
        CASE WHEN n > 0 THEN CAST(mi AS DOUBLE) ELSE 0.0 END AS past10_best_finish,
        CASE WHEN n > 0 THEN CAST(ma AS DOUBLE) ELSE 0.0 END AS past10_worst_finish,
        CASE WHEN n > 0 THEN round(w1 / CAST(n AS DOUBLE), 6) ELSE 0.0 END AS past10_win_rate,
        CASE WHEN n > 0 THEN round(w2 / CAST(n AS DOUBLE), 6) ELSE 0.0 END AS past10_top2_rate,
        CASE WHEN n > 0 THEN round(w3 / CAST(n AS DOUBLE), 6) ELSE 0.0 END AS past10_top3_rate,
        CASE WHEN n > 0 THEN round(p, 6) ELSE 0.0 END AS past10_avg_popularity,
        CASE WHEN n > 0 THEN round(r3, 6) ELSE 0.0 END AS recent3_avg_finish,
        CASE WHEN n >= 10 THEN round(o7, 6) ELSE 0.0 END AS older7_avg_finish,
        CASE WHEN n > 1 THEN round(1 / (1 + sd), 6) WHEN n = 1 THEN 0.5 ELSE 0.0 END AS finish_consistency,
        CASE WHEN n >= 3 THEN CASE WHEN r3 IS NULL THEN 0.0 ELSE round(greatest(0.0, 10 - r3) / 10, 6) END
             ELSE 0.0 END AS form_score""",
        ", runner_no AS popularity",
    ),
)
def past10_panel(spark, sf):
    df = runners(spark, sf).withColumn("popularity", F.col("runner_no"))
    out = H.past10_panel(df, "horse_id", TIE)
    cols = [c for c in out.columns if c not in df.columns and c != "past10_count"]
    return out.select(*ID, "past10_count", *[r(c) for c in cols])


@query(
    "past5_weight_trend",
    roll(
        "horse_id",
        {
            "w": last_sql("list(weight)", 5),
            "cn": last_sql("count(change)", 5),
            "ca": last_sql("avg(change)", 5),
        },
        """round(CASE WHEN len(list_filter(w, lambda v: v IS NOT NULL)) >= 3 THEN
          (SELECT regr_slope(y, x) FROM (SELECT unnest(v) AS y, unnest(range(len(v))) AS x
            FROM (SELECT list_reverse(list_filter(w, lambda z: z IS NOT NULL)) AS v)))
          ELSE 0.0 END, 6) + 0.0 AS past5_weight_slope,
        CASE WHEN cn >= 2 THEN round(ca, 6) + 0.0 ELSE 0.0 END AS past5_weight_avg_change""",
        ", CASE WHEN runner_no <> 3 THEN 430 + qty END AS weight,"
        " CASE WHEN runner_no <> 3 THEN qty - 25 END AS change",
    ),
)
def past5_weight_trend(spark, sf):
    known = F.col("runner_no") != 3
    df = (
        runners(spark, sf)
        .withColumn("weight", F.when(known, 430 + F.col("qty")))
        .withColumn("weight_change", F.when(known, F.col("qty") - 25))
    )
    out = H.past5_weight_trend(df, "horse_id", TIE)
    return out.select(*ID, r("past5_weight_slope"), r("past5_weight_avg_change"))


@query(
    "past10_last3f",
    roll(
        "horse_id",
        {
            "a": last_sql("avg(closing)", 10),
            "b": last_sql("min(closing)", 10),
            "c": last_sql("avg(closing)", 3),
            "d": last_sql("avg(closing_rank)", 10),
            "e": last_sql("avg(CASE WHEN closing_rank = 1 THEN 1.0 ELSE 0.0 END)", 10),
        },
        """round(a, 6) AS past10_avg_closing, round(b, 6) AS past10_best_closing,
        round(c, 6) AS recent3_avg_closing, round(d, 6) AS past10_avg_closing_rank,
        round(coalesce(e, 0.0), 6) AS past10_closing_top1_rate""",
        CLOSING_SQL,
    ),
)
def past10_last3f(spark, sf):
    df = with_closing(runners(spark, sf))
    out = H.past10_closing(df, "horse_id", "closing", "closing_rank", TIE)
    return out.select(*ID, *[r(c) for c in out.columns if c not in df.columns])


@query(
    "range_180d",
    with_runners(
        f""", d AS (SELECT jockey_id, race_date, sum(CASE WHEN finish = 1 THEN 1 ELSE 0 END) AS a,
            sum(CASE WHEN finish <= 2 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN finish <= 3 THEN 1 ELSE 0 END) AS c,
            count(*) AS n, sum(finish) AS f, count(finish) AS m FROM runners GROUP BY ALL),
        p AS (SELECT x.jockey_id, x.race_date, sum(y.a) AS a, sum(y.b) AS b, sum(y.c) AS c, sum(y.n) AS n,
            sum(y.f) AS f, sum(y.m) AS m FROM d x JOIN d y ON x.jockey_id = y.jockey_id
            AND y.race_date >= x.race_date - INTERVAL 180 DAY AND y.race_date < x.race_date GROUP BY ALL)
        SELECT {ID_SQL}, coalesce(round(a / CAST(n AS DOUBLE), 6), 0.0) AS jockey_win_rate,
          coalesce(round(b / CAST(n AS DOUBLE), 6), 0.0) AS jockey_top2_rate,
          coalesce(round(c / CAST(n AS DOUBLE), 6), 0.0) AS jockey_top3_rate,
          CAST(coalesce(n, 0) AS BIGINT) AS jockey_rides,
          CASE WHEN m > 0 THEN round(f / CAST(m AS DOUBLE), 6) ELSE 0.0 END AS jockey_avg_finish
        FROM runners LEFT JOIN p USING (jockey_id, race_date)"""
    ),
)
def range_180d(spark, sf):
    df = runners(spark, sf)
    out = H.range_rates(df, "jockey_id", "jockey")
    cols = ["jockey_win_rate", "jockey_top2_rate", "jockey_top3_rate", "jockey_avg_finish"]
    return out.select(*ID, *[r(c) for c in cols], "jockey_rides")


@query(
    "range_180d_trainer",
    with_runners(
        f""", named AS (SELECT * REPLACE (CASE WHEN qty <> 9 THEN '#' || trainer_id ELSE 'T ' || trainer_id % 90 END AS trainer_id) FROM runners), d AS (SELECT trainer_id, race_date, sum(CASE WHEN finish = 1 THEN 1 ELSE 0 END) AS a,
            sum(CASE WHEN finish <= 2 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN finish <= 3 THEN 1 ELSE 0 END) AS c,
            count(*) AS n, sum(finish) AS f, count(finish) AS m FROM named GROUP BY ALL),
        p AS (SELECT x.trainer_id, x.race_date, sum(y.a) AS a, sum(y.b) AS b, sum(y.c) AS c, sum(y.n) AS n,
            sum(y.f) AS f, sum(y.m) AS m FROM d x JOIN d y ON x.trainer_id = y.trainer_id
            AND y.race_date >= x.race_date - INTERVAL 180 DAY AND y.race_date < x.race_date GROUP BY ALL)
        SELECT {ID_SQL}, coalesce(round(a / CAST(n AS DOUBLE), 6), 0.0) AS trainer_win_rate,
          coalesce(round(b / CAST(n AS DOUBLE), 6), 0.0) AS trainer_top2_rate,
          coalesce(round(c / CAST(n AS DOUBLE), 6), 0.0) AS trainer_top3_rate,
          CAST(coalesce(n, 0) AS BIGINT) AS trainer_rides,
          CASE WHEN m > 0 THEN round(f / CAST(m AS DOUBLE), 6) ELSE 0.0 END AS trainer_avg_finish
        FROM named LEFT JOIN p USING (trainer_id, race_date)"""
    ),
)
def range_180d_trainer(spark, sf):
    # a trainer without an id is known by name
    t = F.col("trainer_id")
    df = runners(spark, sf).withColumn(
        "trainer_id", F.when(F.col("qty") != 9, F.concat(F.lit("#"), t)).otherwise(F.concat(F.lit("T "), t % 90))
    )
    out = H.range_rates(df, "trainer_id", "trainer")
    cols = ["trainer_win_rate", "trainer_top2_rate", "trainer_top3_rate", "trainer_avg_finish"]
    return out.select(*ID, *[r(c) for c in cols], "trainer_rides")


@query(
    "venue_advantage",
    with_runners(
        ", a AS MATERIALIZED "
        + prior_sql("jockey_id, venue", f"{WON} AS w; count(*) AS n")
        + f""", rides AS (SELECT *, CASE WHEN count(finish) OVER last_rides >= 5 THEN avg({_WIN}) OVER last_rides END AS r30 FROM a
          WINDOW last_rides AS (PARTITION BY jockey_id ORDER BY race_date, race_id, {TIE_SQL} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
        SELECT race_id, runner_no, horse_id, jockey_id, round(CASE WHEN n > 0 THEN w / CAST(n AS DOUBLE) ELSE 0.0 END
          - first_value(r30) OVER (PARTITION BY jockey_id, race_date, race_id ORDER BY {TIE_SQL}), 6) + 0.0 AS venue_advantage
        FROM rides"""
    ),
)
def venue_advantage(spark, sf):
    base = runners(spark, sf)
    df = H.expanding_rate(base, ["jockey_id", "venue"], "course")
    df = H.recent_rate(df, "jockey_id", "recent30", TIE, source=base)
    gain = F.round(F.col("course_win_rate") - F.col("recent30"), 6)
    return df.select(*ID, gain.alias("venue_advantage"))


@query(
    "cumulative_pnl",
    """SELECT event_id, user_id, CAST(cum_cost AS BIGINT) AS cum_cost, CAST(cum_return AS BIGINT) AS cum_return,
      CAST(cum_return - cum_cost AS BIGINT) AS cum_profit,
      CASE WHEN cum_cost > 0 THEN round(cum_return / CAST(cum_cost AS DOUBLE) * 100, 1) ELSE 0.0 END AS cum_recovery
    FROM (SELECT event_id, user_id, sum(cost) OVER w AS cum_cost, sum(payout) OVER w AS cum_return FROM
      (SELECT *, CAST(round(value * 100) AS BIGINT) AS cost,
        CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) * 4 ELSE 0 END AS payout FROM events)
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
def cumulative_pnl(spark, sf):
    cents = F.round(F.col("value") * 100).cast("bigint")
    bets = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "ts",
        cents.alias("cost"),
        F.when(F.col("event_type") == "purchase", cents * 4).otherwise(F.lit(0)).alias("payout"),
    )
    return H.cumulative_pnl(bets, ["user_id"], "ts", "event_id").drop("ts", "cost", "payout")
