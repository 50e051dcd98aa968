"""Streams over the events table replayed as files, and the feature build."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions import arrays as A
from furlong.operators import model as M
from furlong.plans import features as P
from furlong.plans import predict as W
from furlong.plans.partitioned import partitioned_build
from furlong.session import shared_dir
from furlong.sources.keyed import KeyedTable
from furlong.streaming import streams as S
from furlong.verify.base import TIE, query, r, runners, runners_by_race, table, with_runners
from furlong.verify.joins import _COURSE_VALUES, COURSES
from furlong.verify.scalars import _LAPS_SQL, _SECTIONS_SQL, _lap_json
from furlong.verify.windows import CLOSING_SQL, ID, TIE_SQL, WON, _TOP, _WIN, _rate, last_sql, prior_sql, with_closing


#: Files are replayed in no order of time, so a row may be as late as the table is long.
LATE = "3650 days"


def _arrivals(spark, df, files=3):
    """Rows as several files in no order of time, one file per micro-batch."""
    path = shared_dir(spark, "arrivals")
    df.repartition(files, F.xxhash64(*df.columns)).write.parquet(path)
    return S.read_files(spark, path, df.schema, per_trigger=1)


def _events(spark, sf):
    # the tables carry times without a zone; watermarks need an instant
    return _arrivals(spark, table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def _run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@query(
    "stream_ingest",
    """SELECT event_id, user_id, event_type FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 50 <> 0) WHERE rn = 1""",
)
def stream_ingest(spark, sf):
    path = shared_dir(spark, "ingest")
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
        ]
    )
    doc = F.to_json(F.struct("event_id", "user_id", "event_type"))
    broken = F.when(F.col("event_id") % 50 == 0, F.substring(doc, 1, 9)).otherwise(doc)
    stored = KeyedTable(spark, f"{path}/table", schema, ["user_id", "event_type"], 8, max_runs=2)
    arriving = _events(spark, sf).select(broken.alias("data"))
    _run(S.ingest(arriving, schema, path, f"{path}/checkpoint", once=True, table=stored, version=["event_id"]))
    return stored.current(["event_id"])


@query(
    "stream_latest_odds",
    """WITH l AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2)
    SELECT e.user_id, e.event_type, e.value, CAST(floor(epoch(e.ts)) AS BIGINT) AS at FROM events e JOIN l ON e.user_id = l.user_id AND e.event_type = l.event_type AND e.ts = l.ts
    WHERE e.ts > (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND""",
)
def stream_latest_odds(spark, sf):
    path = shared_dir(spark, "odds")
    keys, ttl = ["user_id", "event_type"], 86400
    stream = _events(spark, sf).select(*keys, "ts", "value")
    stored = KeyedTable(spark, f"{path}/table", stream.schema, keys, 8, max_runs=2)
    _run(S.latest_odds(stream, keys, "ts", "value", f"{path}/rows", f"{path}/checkpoint", ttl, once=True, table=stored))
    out = S.odds_now(stored, "ts", ttl)
    return out.select(*keys, "value", F.floor(F.col("ts").cast("double")).alias("at"))


@query(
    "stream_windowed_counts",
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors
    FROM events GROUP BY 1, 2""",
)
def stream_windowed_counts(spark, sf):
    path = shared_dir(spark, "counts")
    stream = _events(spark, sf)
    schema = S.window_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour").schema
    stored = KeyedTable(spark, f"{path}/table", schema, ["window_start", "window_end", "event_type"], 8, max_runs=2)
    _run(
        S.stream_window_counts(
            stream, "ts", "event_type", "1 hour", None, LATE, f"{path}/rows", f"{path}/checkpoint", once=True, table=stored
        )
    )
    out = stored.current()
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events", "errors")


@query(
    "stream_dedupe",
    "SELECT count(*) AS deliveries, count(DISTINCT event_id) AS kept FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0)",
)
def stream_dedupe(spark, sf):
    path = shared_dir(spark, "dedupe")
    copies = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    # the copies of an event arrive in different micro-batches
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = _arrivals(spark, events.select("event_id", "ts", F.explode(copies).alias("delivery")))
    keyed = stream.withColumn("key", S.idempotency_key("event_id"))
    _run(S.dedupe(keyed, ["key"], "ts", LATE, f"{path}/rows", f"{path}/checkpoint", once=True))
    kept = S.read_batches(spark, f"{path}/rows", keyed.schema)
    sent = table(spark, sf, "events").agg(F.sum(F.size(copies)).alias("deliveries"))
    return sent.select("deliveries", kept.agg(F.count(F.lit(1))).scalar().alias("kept"))


_FEATURES_SQL = with_runners(
    ", a AS "
    + prior_sql("jockey_id, venue", f"{WON} AS jvw; count(*) AS jvn")
    + ", b AS "
    + prior_sql("horse_id, surface", f"{WON} AS hsw; count(*) AS hsn", "a")
    + ", c AS "
    + prior_sql("trainer_id", f"{WON} AS tw; count(*) AS tn", "b")
    + f""", m AS (SELECT *, 1 / odds / sum(1 / odds) OVER (PARTITION BY race_id) AS pn, rank() OVER (PARTITION BY race_id ORDER BY odds) AS rk,
        {last_sql(f"avg({_WIN})", 30).replace("{e}", "jockey_id")} AS r30, {last_sql("count(finish)", 30).replace("{e}", "jockey_id")} AS c30,
        row_number() OVER (PARTITION BY jockey_id, race_date, race_id ORDER BY {TIE_SQL}) AS first_no FROM c),
    f AS (SELECT jockey_id, race_id, CASE WHEN c30 >= 5 THEN r30 END AS r30 FROM m WHERE first_no = 1),
    e AS (SELECT race_id, CASE WHEN count(*) >= 2 THEN sum(-pn * ln(pn + 1e-10)) ELSE 0.0 END AS ent FROM m GROUP BY 1)
    SELECT m.race_id, runner_no, horse_id, m.jockey_id, round(pn, 6) AS implied_prob_norm, CAST(rk AS BIGINT) AS odds_rank_in_race, round(ent, 6) AS market_entropy,
      {_rate("jvw", "jvn", "jockey_course_win_rate")}, {_rate("hsw", "hsn", "horse_surface_win_rate")}, round((tw + 0.375) / (tn + 5), 6) AS trainer_win_rate_smooth,
      round(f.r30, 6) AS jockey_recent30
    FROM m JOIN f ON m.jockey_id = f.jockey_id AND m.race_id = f.race_id JOIN e ON m.race_id = e.race_id"""
)


# Columns of a runner that no feature reads and the queries do not return.
_UNREAD = ("status", "race_class", "prize", "horse_name")


@query("feature_build", _FEATURES_SQL)
def feature_build(spark, sf):
    stages = [s for s in P.STAGES if s is not P.form] + [partial(P.form, tie=TIE)]
    out = P.feature_build(runners(spark, sf).drop(*_UNREAD), stages)
    return out.select(
        *ID, r("implied_prob_norm"), "odds_rank_in_race", r("market_entropy"), r("jockey_course_win_rate"),
        r("horse_surface_win_rate"), r("trainer_win_rate_smooth"), r("jockey_recent30"),
    )


# ---- the whole build, every column of it -------------------------------------

_BAND = "CASE WHEN distance <= 1200 THEN 'sprint' WHEN distance <= 1600 THEN 'mile' WHEN distance <= 2200 THEN 'middle' ELSE 'long' END"
_DAY = "2.0::DOUBLE * pi() / 365.0::DOUBLE * dayofyear(x.race_date)"

#: Keys of the running win rates, their column prefix, and short names of total and count.
_RATES = {
    "horse_id, surface": ("horse_surface", "hs"),
    "horse_id, venue": ("horse_venue", "hv"),
    "horse_id, venue, surface": ("horse_venue_surface", "hx"),
    "horse_id, distance_band": ("horse_band", "hb"),
    "horse_id, distance_band, surface": ("horse_band_surface", "hc"),
    "jockey_id, venue": ("jockey_course", "jv"),
    "jockey_id, trainer_id": ("combo", "jt"),
}
_TIMED = (200, 400, 600, 800, 1000)


def _pace_sql():
    """Laps, sections and the mean section time of both halves; runner 7 has no readable laps."""
    timed = f"runner_no <> 7 AND least(distance // 200, {len(_TIMED)}) >= 2"
    half = f"least(distance // 200, {len(_TIMED)}) // 2"
    sums = {}
    for name, sign in (("front", "<"), ("back", ">=")):
        used = [f"CASE WHEN {i} {sign} {half} AND distance >= {d} AND s{d} > 0 THEN" for i, d in enumerate(_TIMED)]
        total = " + ".join(f"{u} s{d} ELSE 0.0 END" for u, d in zip(used, _TIMED))
        count = " + ".join(f"{u} 1 ELSE 0 END" for u in used)
        sums[name] = f"(({total}) / nullif(CAST({count} AS DOUBLE), 0))"
    front, back = (f"CASE WHEN {timed} AND {sums['front']} IS NOT NULL AND {sums['back']} IS NOT NULL THEN {v} END" for v in sums.values())
    laps = [f"CASE WHEN runner_no <> 7 THEN round(l{d}, 6) END AS lap_{d}m" for d in _TIMED]
    laps += [f"CASE WHEN runner_no <> 7 THEN round(s{d}, 6) + 0.0 END AS lap_sect_{d}m" for d in _TIMED]
    return [*laps, f"round({front}, 6) AS race_pace_front", f"round({back}, 6) AS race_pace_back",
            f"round({front} - {back}, 6) + 0.0 AS race_pace_diff", f"round({front} / {back}, 6) AS race_pace_ratio"]


_CAREERS = {"jockey_id": ("jockey", "cj"), "trainer_id": ("trainer", "ct"), "sire": ("sire", "cs"), "dam": ("damsire", "cd")}


def _whole_sql():
    chain, src, cols = "", "src", []

    def step(keys, sums):
        nonlocal chain, src
        name = f"s{chain.count('AS MATERIALIZED')}"
        chain += f", {name} AS MATERIALIZED {prior_sql(keys, sums, src)}"
        src = name

    for keys, (prefix, k) in _RATES.items():
        step(keys, f"{WON} AS {k}w; count(*) AS {k}n")
        cols += [_rate(f"{k}w", f"{k}n", f"{prefix}_win_rate"), f"CAST({k}n AS BIGINT) AS {prefix}_count"]
    step("horse_id, distance", f"{WON} AS hdw; count(*) AS hdn; sum(finish) AS hdf; count(finish) AS hdm")
    cols += [
        _rate("hdw", "hdn", "horse_distance_win_rate"), "CAST(hdn AS BIGINT) AS horse_distance_count",
        _rate("hdf", "hdm", "horse_distance_avg_finish", "NULL"), "round((jtn * CASE WHEN jtn > 0 THEN jtw / CAST(jtn AS DOUBLE) ELSE 0.0::DOUBLE END + 0.375::DOUBLE) / (jtn + 5), 12) AS combo_win_rate_smooth",
    ]
    for keys, (prefix, k) in _CAREERS.items():
        step(keys, ";".join(_TOP.format(n, k) for n in (1, 2, 3)) + f"; count(*) AS {k}n")
        cols += [_rate(f"{k}{n}", f"{k}n", f"{prefix}_{w}_rate") for n, w in ((1, "win"), (2, "top2"), (3, "top3"))]
        cols += [f"CAST({k}n AS BIGINT) AS {prefix}_race_count", f"round(({k}n * CASE WHEN {k}n > 0 THEN {k}1 / CAST({k}n AS DOUBLE) ELSE 0.0::DOUBLE END + 0.375::DOUBLE) / ({k}n + 5), 12) AS {prefix}_win_rate_smooth"]
    step("venue, distance_band, surface, inner_gate", f"{WON} AS gw; count(*) AS gn")
    cols.append("CASE WHEN gn >= 10 THEN round(gw / CAST(gn AS DOUBLE), 6) ELSE 0.5 END AS gate_win_rate")

    last = {
        **{f"avg_finish_{n}": last_sql("avg(finish)", n) for n in (3, 5, 10)},
        **{f"win_rate_{n}": last_sql(f"avg({_WIN})", n) for n in (3, 5)},
        **{f"closing_avg_{n}": last_sql("avg(closing)", n) for n in (3, 5)},
        "closing_rank_avg_3": last_sql("avg(closing_rank)", 3),
        "log_payout_avg_5": last_sql("avg(ln(1 + coalesce(payout, 0)))", 5),
        "style_avg_5": last_sql("avg(style)", 5),
        "style_sd": last_sql("stddev_samp(style)", 5),
        "starts": last_sql("count(*)", 5),
        "prev_distance": last_sql("max(distance)", 1),
        "prev_surface": last_sql("max(surface)", 1),
    }
    rides = {"r30": last_sql(f"avg({_WIN})", 30), "c30": last_sql("count(finish)", 30)}
    firsts = ""
    for entity, stats, k in (("horse_id", last, "fh"), ("jockey_id", rides, "fj"), ("trainer_id", rides, "ft")):
        body = ", ".join(f"{v} AS {n}" for n, v in stats.items()).replace("{e}", entity)
        firsts += (
            f", {k}0 AS (SELECT {entity}, race_id, {body}, row_number() OVER (PARTITION BY {entity}, race_date, race_id ORDER BY {TIE_SQL}) AS first_no FROM src)"
            f", {k} AS MATERIALIZED (SELECT * FROM {k}0 WHERE first_no = 1)"
        )
    for entity, prefix in (("jockey_id", "jockey"), ("trainer_id", "trainer")):
        firsts += f""", d_{prefix} AS MATERIALIZED (SELECT {entity}, race_date, sum(CASE WHEN finish = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN finish <= 2 THEN 1 ELSE 0 END) AS b,
            sum(CASE WHEN finish <= 3 THEN 1 ELSE 0 END) AS c, count(*) AS n, sum(finish) AS f, count(finish) AS m FROM src GROUP BY ALL),
          p_{prefix} AS MATERIALIZED (SELECT x.{entity}, x.race_date, sum(y.a) AS a, sum(y.b) AS b, sum(y.c) AS c, sum(y.n) AS n, sum(y.f) AS f, sum(y.m) AS m FROM d_{prefix} x
            JOIN d_{prefix} y ON x.{entity} = y.{entity} AND y.race_date >= x.race_date - INTERVAL 180 DAY AND y.race_date < x.race_date GROUP BY ALL)"""
        p = f"p_{prefix}"
        cols += [f"coalesce(round({p}.{x} / CAST({p}.n AS DOUBLE), 6), 0.0) AS {prefix}_180d_{w}_rate" for x, w in (("a", "win"), ("b", "top2"), ("c", "top3"))]
        cols += [f"CAST(coalesce({p}.n, 0) AS BIGINT) AS {prefix}_180d_rides", f"CASE WHEN {p}.m > 0 THEN round({p}.f / CAST({p}.m AS DOUBLE), 6) ELSE 0.0 END AS {prefix}_180d_avg_finish"]
        k = f"f{prefix[0]}"
        cols.append(f"CASE WHEN {k}.c30 >= 5 THEN round({k}.r30, 6) END AS {prefix}_recent30")
    cols += [f"round(fh.{n}, 6) AS {n}" for n in last if n not in ("style_sd", "starts", "prev_distance", "prev_surface")]
    cols += [
        "CASE WHEN fh.starts > 0 THEN round(coalesce(fh.style_sd, 0), 6) END AS style_std_5", "CAST(fh.prev_distance AS BIGINT) AS prev_distance", "fh.prev_surface",
        "CAST(distance - fh.prev_distance AS BIGINT) AS distance_change", "CASE WHEN surface <> fh.prev_surface THEN 1 ELSE 0 END AS surface_changed",
        "round(CASE WHEN jvn > 0 THEN jvw / CAST(jvn AS DOUBLE) ELSE 0.0 END - CASE WHEN fj.c30 >= 5 THEN fj.r30 END, 6) + 0.0 AS jockey_course_advantage",
        "CASE WHEN g > 0 THEN CAST(g AS BIGINT) END AS days_since_last", "CASE WHEN g <= 0 THEN NULL WHEN g <= 21 THEN 1 WHEN g <= 90 THEN 2 WHEN g > 90 THEN 3 END AS rest_code",
        "round(pn, 6) AS implied_prob_norm", "CAST(rk AS BIGINT) AS odds_rank_in_race", "round(oz, 4) + 0.0 AS odds_z_in_race",
        "round(ent, 6) AS market_entropy", "round(top3, 6) AS top3_probability", "CAST(fs AS BIGINT) AS field_size", "round(x.runner_no / CAST(fs AS DOUBLE), 6) AS gate_ratio",
        f"round(cos({_DAY}), 6) + 0.0 AS cos_date", f"round(sin({_DAY}), 6) + 0.0 AS sin_date", "CAST(month(x.race_date) % 12 // 3 AS INTEGER) AS season",
        "distance_band", "round(1 / odds, 6) AS implied_prob", "0 AS odds_is_missing", "CASE WHEN weight IS NULL THEN 1 ELSE 0 END AS weight_is_missing",
        *[f"CASE WHEN x.surface = '{v}' THEN 1 ELSE 0 END AS surface_{v}" for v in "ANR"],
        *_pace_sql(),
        "CAST(coalesce(straight, 300.0) AS DOUBLE) AS straight", "coalesce(bias, 0) AS bias",
        "CASE WHEN coalesce(bias, 0) = 1 AND x.runner_no <= 3 THEN 1 ELSE 0 END AS inner_advantage",
    ]
    return with_runners(
        f""", {_LAPS_SQL.format(src="runners")}, {_SECTIONS_SQL}, c(venue, surface, d, straight, bias) AS (VALUES {_COURSE_VALUES}),
        tracks AS (SELECT DISTINCT venue, surface, distance FROM runners),
        course AS (SELECT t.venue AS k_venue, t.surface AS k_surface, t.distance AS k_distance, c.straight, c.bias, row_number() OVER (PARTITION BY t.venue, t.surface, t.distance ORDER BY
          CASE WHEN c.d = t.distance THEN 0 WHEN c.straight IS NOT NULL AND c.d IS NULL THEN 1 ELSE 2 END, abs(c.d - t.distance), c.d) AS choice
          FROM tracks t LEFT JOIN c ON c.venue = t.venue AND c.surface = t.surface),
        src AS MATERIALIZED (SELECT *{CLOSING_SQL}, CASE WHEN finish = 1 THEN price END AS payout, CASE WHEN runner_no < 7 THEN runner_no % 4 END AS style,
          CASE WHEN runner_no <> 3 THEN 430 + qty END AS weight, {_BAND} AS distance_band, runner_no <= 4 AS inner_gate FROM sect){chain}{firsts},
        starts AS (SELECT DISTINCT horse_id, race_id, race_date FROM src),
        gaps AS (SELECT horse_id, race_id, date_diff('day', lag(race_date) OVER (PARTITION BY horse_id ORDER BY race_date, race_id), race_date) AS g FROM starts),
        mk AS (SELECT *, 1 / odds / sum(1 / odds) OVER w AS pn, rank() OVER (PARTITION BY race_id ORDER BY odds) AS rk, (odds - avg(odds) OVER w) / (stddev_samp(odds) OVER w + 1e-8) AS oz, count(*) OVER w AS fs,
          row_number() OVER (PARTITION BY race_id ORDER BY odds) AS best FROM {src} WINDOW w AS (PARTITION BY race_id)),
        en AS (SELECT race_id, CASE WHEN count(*) >= 2 THEN sum(-pn * ln(pn + 1e-10)) ELSE 0.0 END AS ent, CASE WHEN count(*) >= 2 THEN sum(CASE WHEN best <= 3 THEN pn END) ELSE 0.5 END AS top3 FROM mk GROUP BY 1)
        SELECT x.race_id, x.runner_no, x.horse_id, x.jockey_id, {", ".join(cols)}
        FROM mk x JOIN en ON x.race_id = en.race_id JOIN gaps ON x.horse_id = gaps.horse_id AND x.race_id = gaps.race_id
          JOIN fh ON x.horse_id = fh.horse_id AND x.race_id = fh.race_id JOIN fj ON x.jockey_id = fj.jockey_id AND x.race_id = fj.race_id JOIN ft ON x.trainer_id = ft.trainer_id AND x.race_id = ft.race_id
          JOIN course ON x.venue = k_venue AND x.surface = k_surface AND x.distance = k_distance AND choice = 1
          LEFT JOIN p_jockey ON x.jockey_id = p_jockey.jockey_id AND x.race_date = p_jockey.race_date LEFT JOIN p_trainer ON x.trainer_id = p_trainer.trainer_id AND x.race_date = p_trainer.race_date"""
    )


@query("feature_pipeline", _whole_sql())
def feature_pipeline(spark, sf):
    df = with_closing(runners_by_race(spark, sf)).withColumns(
        {
            "payout": F.when(F.col("finish") == 1, F.col("price")),
            "style": F.when(F.col("runner_no") < 7, F.col("runner_no") % 4),
            "weight": F.when(F.col("runner_no") != 3, 430 + F.col("qty")),
        }
    )
    df = df.drop(*_UNREAD)
    laps = P.laps("laps", _TIMED)
    course = spark.createDataFrame(COURSES, "venue string, surface string, distance int, straight double, bias int")
    out = partitioned_build(
        df,
        TIE,
        [
            P.categories({"surface": ["A", "N", "R"]}),
            # read where all has met: the map of a runner is wider than what it is read from
            lambda rows, base: laps(rows.withColumn("laps", A.lap_map(_lap_json())), base),
            P.course(course, {"straight": 300.0, "bias": 0}, "bias"),
        ],
    )
    made = [c for c in out.columns if c not in df.columns]
    kinds = dict(out.dtypes)
    # smoothed rates end in a 5 at the seventh digit too often to be rounded there
    digits = {"odds_z_in_race": 4} | {c: 12 for c in made if c.endswith("_smooth")}
    return out.select(*ID, *[r(c, digits.get(c, 6)) if kinds[c] == "double" else c for c in made])


# ---- from history to expected value -----------------------------------------

_CUT = "1998-06-01"
_CURVE = ([0.1, 0.3, 0.6], [0.05, 0.25, 0.45])


def _predict_sql():
    chain = ", a AS MATERIALIZED " + prior_sql("jockey_id, venue", f"{WON} AS jw; count(*) AS jn", "src")
    chain += ", b AS MATERIALIZED " + prior_sql("horse_id, surface", f"{WON} AS hw; count(*) AS hn", "a")
    chain += ", c AS MATERIALIZED " + prior_sql("trainer_id", f"{WON} AS tw; count(*) AS tn", "b")
    return with_runners(
        f""", src AS MATERIALIZED (SELECT * REPLACE (CASE WHEN race_date < DATE '{_CUT}' THEN finish END AS finish) FROM runners){chain},
        s AS (SELECT *, round(0.1137::DOUBLE + 2 * CASE WHEN jn > 0 THEN jw / CAST(jn AS DOUBLE) ELSE 0.0 END + CASE WHEN hn > 0 THEN hw / CAST(hn AS DOUBLE) ELSE 0.0 END + 0.05::DOUBLE * (runner_no % 3), 9) AS raw,
          round(0.2219::DOUBLE + 3 * (tw + 0.375::DOUBLE) / (tn + 5) - 0.01::DOUBLE * runner_no, 9) AS pl FROM c WHERE race_date >= DATE '{_CUT}'),
        k AS (SELECT *, greatest(least(raw, 1.0), 0.0) AS x, greatest(least(pl, 1.0), 0.0) AS y FROM s),
        q AS (SELECT *, round(CASE WHEN x <= 0.1 THEN 0.05::DOUBLE WHEN x <= 0.3 THEN 0.05::DOUBLE + (x - 0.1) * (0.2::DOUBLE / 0.2) WHEN x <= 0.6 THEN 0.25::DOUBLE + (x - 0.3) * (0.2::DOUBLE / 0.3) ELSE 0.45::DOUBLE END, 9) AS p FROM k),
        n AS (SELECT *, p / sum(p) OVER w AS pn, y / sum(y) OVER w AS ps FROM q WINDOW w AS (PARTITION BY race_id)),
        e AS (SELECT *, 0.6::DOUBLE * pn + 0.4::DOUBLE * ps AS m FROM n)
        SELECT {", ".join(ID)}, raw AS p_raw, round(pn, 6) AS p_norm, CAST(rank() OVER (PARTITION BY race_id ORDER BY p DESC) AS BIGINT) AS predicted_rank,
          round(m / sum(m) OVER (PARTITION BY race_id), 6) AS p_ensemble, round(CASE WHEN runner_no <> 5 THEN pn * odds END, 8) AS expected_value FROM e"""
    )


@query("predict_races", _predict_sql())
def predict_races(spark, sf):
    df = P.stored(runners(spark, sf).drop(*_UNREAD))  # history and entries are read from it
    cut = F.lit(_CUT).cast("date")
    history = df.filter(F.col("race_date") < cut)
    entries = df.filter(F.col("race_date") >= cut).withColumn("odds", F.when(F.col("runner_no") != 5, F.col("odds")))
    features = W.target_features(entries, history, TIE)
    raw = 0.1137 + 2 * F.col("jockey_course_win_rate") + F.col("horse_surface_win_rate") + 0.05 * (F.col("runner_no") % 3)
    place = 0.2219 + 3 * F.col("trainer_win_rate_smooth") - 0.01 * F.col("runner_no")
    curve = M.piecewise(*_CURVE)
    out = W.predict_races(
        features, W.Scorer.of_column(F.round(raw, 9), calibrator=lambda p: F.round(curve(p), 9)),
        W.Scorer.of_column(F.round(place, 9), "place3"), source=entries,
    )
    return out.select(*ID, "p_raw", r("p_norm"), "predicted_rank", r("p_ensemble"), r("expected_value", 8))
