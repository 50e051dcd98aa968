"""Scalar functions over whole tables, on text made from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.functions import arrays as A
from furlong.functions import pages as P
from furlong.functions.race_page import race_fields
from furlong.functions import racing as R
from furlong.functions import text as T
from furlong.operators.history import has_history, smooth_rate
from furlong.operators.prep import fill_policy
from furlong.verify.base import entries, query, r, runners, table, with_entries, with_runners

ID = ["race_id", "runner_no", "horse_id", "jockey_id"]
ID_SQL = "race_id, runner_no, horse_id, jockey_id"


def text_of(c):
    return c.cast("int").cast("string")


def _when_no(values: dict, otherwise):
    """A value by runner number, to make dirty text out of clean columns."""
    out = None
    for k, v in values.items():
        cond = F.col("runner_no") == k
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(otherwise)


@query(
    "coalesce_aliases",
    with_entries(
        f"""SELECT {ID_SQL}, coalesce(a, b, c) AS race_number,
        CASE WHEN a IS NOT NULL THEN 'race_number' WHEN b IS NOT NULL THEN 'race_no'
             WHEN c IS NOT NULL THEN 'round' END AS race_number_source
        FROM (SELECT *, CASE WHEN runner_no % 3 = 0 THEN surface END AS a,
          CASE WHEN runner_no % 2 = 0 THEN status END AS b, CASE WHEN runner_no < 6 THEN 'x' END AS c FROM entries)"""
    ),
)
def coalesce_aliases(spark, sf):
    no = F.col("runner_no")
    value, source = T.first_known(
        {
            "race_number": F.when(no % 3 == 0, F.col("surface")),
            "race_no": F.when(no % 2 == 0, F.col("status")),
            "round": F.when(no < 6, F.lit("x")),
        }
    )
    return entries(spark, sf).select(*ID, value.alias("race_number"), source.alias("race_number_source"))


@query(
    "id_from_url",
    r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'B' || page_id
        ELSE coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([A-Za-z0-9]+)/?$', 1), ''),
          'page ' || page_id) END AS entity_id FROM pages""",
)
def id_from_url(spark, sf):
    pid = F.col("page_id")
    ident = F.when(pid % 5 == 0, F.concat(F.lit(" B"), pid)).when(pid % 5 == 1, F.lit(" nan ")).when(
        pid % 5 == 2, F.lit("  ")
    )
    name = F.concat(F.lit("page "), pid)
    return table(spark, sf, "pages").select("page_id", T.id_from_url(ident, F.col("url"), name).alias("entity_id"))


_DIRTY_SQL = """CASE runner_no WHEN 1 THEN '取消' WHEN 2 THEN ' ' WHEN 3 THEN '-' WHEN 4 THEN ' ' || CAST(qty AS INTEGER) || '.5 '
  WHEN 5 THEN CAST(qty AS INTEGER) || 'x' ELSE CAST(CAST(qty AS INTEGER) AS VARCHAR) END"""


def _dirty():
    q = text_of(F.col("qty"))
    return _when_no(
        {
            1: F.lit("取消"),
            2: F.lit(" "),
            3: F.lit("-"),
            4: F.concat(F.lit(" "), q, F.lit(".5 ")),
            5: F.concat(q, F.lit("x")),
        },
        q,
    )


@query(
    "number_or_null",
    with_entries(
        f"""SELECT {ID_SQL}, TRY_CAST(trim({_DIRTY_SQL}) AS DOUBLE) AS number_value,
        CAST(floor(TRY_CAST(trim({_DIRTY_SQL}) AS DOUBLE)) AS INTEGER) AS int_value FROM entries"""
    ),
)
def number_or_null(spark, sf):
    return entries(spark, sf).select(
        *ID, T.number_or_null(_dirty()).alias("number_value"), T.int_or_null(_dirty()).alias("int_value")
    )


@query(
    "clock_to_seconds",
    with_entries(
        f"""SELECT {ID_SQL}, CASE runner_no
          WHEN 1 THEN round((CAST(qty AS INTEGER) % 3) * 60 + CAST(qty AS INTEGER) % 60 + 0.5, 3)
          WHEN 2 THEN CAST((CAST(qty AS INTEGER) % 3) * 60 + CAST(qty AS INTEGER) % 60 AS DOUBLE)
          WHEN 3 THEN round(CAST(qty AS INTEGER) + 0.25, 3) WHEN 4 THEN NULL WHEN 5 THEN NULL
          ELSE CAST(CAST(qty AS INTEGER) AS DOUBLE) END AS seconds FROM entries"""
    ),
)
def clock_to_seconds(spark, sf):
    q = F.col("qty").cast("int")
    clock = F.concat((q % 3).cast("string"), F.lit(":"), F.lpad((q % 60).cast("string"), 2, "0"))
    t = _when_no(
        {
            1: F.concat(clock, F.lit(".5")),
            2: clock,
            3: F.concat(q.cast("string"), F.lit(".25")),
            4: F.lit("-"),
            5: F.concat(clock, F.lit(":9")),
        },
        q.cast("string"),
    )
    return entries(spark, sf).select(*ID, F.round(T.clock_to_seconds(t), 3).alias("seconds"))


@query(
    "date_any_format",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y%m%d') END AS ymd,
      CASE WHEN o_orderkey % 6 < 5 THEN strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y%m%d') END AS month_bound
    FROM orders""",
)
def date_any_format(spark, sf):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    text = F.lit("junk")
    for i, layout in enumerate(["yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy-MM-dd'T'00:00:00"]):
        text = F.when(k == i, F.date_format(day, layout)).otherwise(text)
    month = F.when(k < 5, F.date_format(day, "yyyyMM")).otherwise(F.lit("20xx"))
    return table(spark, sf, "orders").select(
        "o_orderkey", T.date_any_format(text).alias("ymd"), T.month_end_bound(month).alias("month_bound")
    )


@query(
    "sex_age_split",
    with_entries(
        f"""SELECT {ID_SQL}, CASE WHEN runner_no = 7 THEN NULL WHEN runner_no = 6 THEN 'f' ELSE surface END AS sex,
        CASE WHEN runner_no = 5 OR runner_no = 7 THEN NULL ELSE CAST(qty AS INTEGER) END AS age FROM entries"""
    ),
)
def sex_age_split(spark, sf):
    q = text_of(F.col("qty"))
    cell = _when_no({5: F.col("surface"), 7: F.lit(" ")}, F.concat(F.col("surface"), q))
    sex, age = T.split_sex_age(cell)
    given = F.when(F.col("runner_no") == 6, F.lit("f"))
    return entries(spark, sf).select(*ID, F.coalesce(given, sex).alias("sex"), age.alias("age"))


@query(
    "weight_split",
    with_entries(
        f"""SELECT {ID_SQL}, CASE WHEN runner_no IN (3, 4) THEN NULL ELSE 430 + CAST(qty AS INTEGER) END AS weight_kg,
        CASE WHEN runner_no IN (3, 4, 5) THEN NULL ELSE CAST(qty AS INTEGER) - 25 END AS weight_change FROM entries"""
    ),
)
def weight_split(spark, sf):
    q = F.col("qty").cast("int")
    kg = (430 + q).cast("string")
    change = F.concat(F.lit("("), F.when(q > 25, F.lit("+")).otherwise(F.lit("")), (q - 25).cast("string"), F.lit(")"))
    cell = _when_no(
        {
            2: F.concat(kg, F.lit("<small>"), change, F.lit("</small>")),
            3: F.lit("---"),
            4: F.lit("計不"),
            5: kg,
        },
        F.concat(kg, change),
    )
    weight, delta = T.split_weight(cell)
    return entries(spark, sf).select(*ID, weight.alias("weight_kg"), delta.alias("weight_change"))


def _corner_text():
    q = F.col("qty").cast("int")
    full = F.concat_ws("-", F.col("runner_no"), q % 18 + 1, (q * 7) % 18 + 1, F.lit("x"), (q * 5) % 18 + 1)
    return _when_no({5: q.cast("string"), 6: F.lit(""), 7: F.lit(None).cast("string")}, full)


_CORNERS_SQL = """CASE runner_no WHEN 5 THEN [CAST(qty AS INTEGER)] WHEN 6 THEN CAST([] AS INTEGER[])
  WHEN 7 THEN CAST([] AS INTEGER[])
  ELSE [runner_no, CAST(qty AS INTEGER) % 18 + 1, (CAST(qty AS INTEGER) * 7) % 18 + 1, (CAST(qty AS INTEGER) * 5) % 18 + 1] END"""


@query(
    "corner_list",
    with_entries(f"SELECT {ID_SQL}, array_to_string(c, ',') AS corners, len(c) AS n_corners FROM "
                 f"(SELECT *, {_CORNERS_SQL} AS c FROM entries)"),
)
def corner_list(spark, sf):
    c = T.split_corners(_corner_text())
    return entries(spark, sf).select(
        *ID,
        F.array_join(c.cast("array<string>"), ",").alias("corners"),
        F.size(c).cast("bigint").alias("n_corners"),
    )


_VENUE_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in R.VENUES.items())


@query(
    "code_decode",
    with_entries(
        f""", v(code, name) AS (VALUES {_VENUE_VALUES})
        SELECT {ID_SQL}, coalesce(v.name, t) AS venue,
          CASE WHEN runner_no % 3 = 0 THEN '帯広（ば）' ELSE coalesce(v.name, t) END AS venue_spelling
        FROM (SELECT *, CASE WHEN runner_no = 7 THEN 'Oz' ELSE CAST(CAST(qty AS INTEGER) AS VARCHAR) END AS t FROM entries)
        LEFT JOIN v ON v.code = lpad(t, 2, '0')"""
    ),
)
def code_decode(spark, sf):
    code = _when_no({7: F.lit("Oz")}, text_of(F.col("qty")))
    venue = T.decode(code, R.VENUES, pad=2)
    spelled = F.when(F.col("runner_no") % 3 == 0, F.lit("帯広(ば)")).otherwise(
        F.concat(venue, F.when(F.col("runner_no") == 1, F.lit(R.VENUE_SUFFIX)).otherwise(F.lit("")))
    )
    return entries(spark, sf).select(*ID, venue.alias("venue"), R.venue_spelling(spelled).alias("venue_spelling"))


@query(
    "id_parts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y%m%d') END AS id_date,
      CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') END AS id_venue,
      CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 20 BETWEEN 1 AND 12 THEN CAST(o_orderkey % 20 AS INTEGER) END AS id_race_number
    FROM orders""",
)
def id_parts(spark, sf):
    key = F.col("o_orderkey")
    race_id = F.concat(
        F.date_format("o_orderdate", "yyyyMMdd"),
        F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"),
        F.lpad((key % 20).cast("string"), 2, "0"),
    )
    race_id = F.when(key % 7 == 0, F.lit("20x")).otherwise(race_id)
    parts = T.id_parts(race_id, date=(1, 8), venue=(9, 2))
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query(
    "placeholder_name",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 = 1 THEN '[H' || c_custkey || ']' WHEN c_custkey % 6 IN (2, 3) THEN '[不明馬]'
      ELSE c_name END AS name FROM customer""",
)
def placeholder_name(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 6 == 1, F.lit(" ")).when(k % 6 == 2, F.lit("nan")).when(k % 6 != 3, F.col("c_name"))
    ident = F.when(k % 6 == 2, F.lit("None")).when(k % 6 != 3, F.concat(F.lit("H"), k))
    return table(spark, sf, "customer").select("c_custkey", T.placeholder_name(name, ident).alias("name"))


# Titles and classes that exercise every grade.
TITLES = ["天皇賞(G1)", "京都記念(GII)", "中山 GIII", "東京記念GI", "オークス G1", "札幌(L)", "Open特別", "OP 特別", "OP戦",
          "3勝クラス", "2勝クラス", "1勝クラス", "3歳未勝利", "2歳新馬", "地方", ""]
CLASSES = ["", "A1", "A2", "B", "B3", "C1", "C2", "C1二", "重賞", "3歳", "x"]


def _sql_list(values):
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


@query(
    "class_grade",
    with_entries(
        f""", g AS (SELECT *, {_sql_list(TITLES)}[CAST(qty AS INTEGER) % {len(TITLES)} + 1] AS t,
          {_sql_list(CLASSES)}[(CAST(qty AS INTEGER) + runner_no) % {len(CLASSES)} + 1] AS c FROM entries),
        h AS (SELECT *, t || ' ' || c AS b FROM g)
        SELECT {ID_SQL}, CASE
          WHEN contains(b, 'GⅠ') OR contains(b, 'G1') OR regexp_matches(b || '.', 'GI[^I]') THEN 8.0
          WHEN contains(b, 'GⅡ') OR contains(b, 'G2') OR regexp_matches(b || '.', 'GII[^I]') THEN 7.0
          WHEN contains(b, 'GⅢ') OR contains(b, 'G3') OR contains(b, 'GIII') THEN 6.0
          WHEN contains(b, '(L)') OR contains(b, 'Listed') OR contains(b, 'リステッド') THEN 5.0
          WHEN contains(b, 'オープン') OR contains(lower(b), 'open') OR regexp_matches(b || ' ', '(?i)op[ ()]') THEN 4.0
          WHEN contains(b, '3勝') THEN 3.0 WHEN contains(b, '2勝') THEN 2.0 WHEN contains(b, '1勝') THEN 1.0
          WHEN contains(b, '未勝利') THEN 0.0 WHEN contains(b, '新馬') THEN -1.0
          WHEN c IN ('重賞', 'A', 'A1') THEN 4.0 WHEN c IN ('A2', 'A3') THEN 3.0 WHEN c IN ('B', 'B1') THEN 2.0
          WHEN c IN ('B2', 'B3') THEN 1.0 WHEN c IN ('C', 'C1') THEN 0.5 WHEN c LIKE 'C%' THEN 0.0
          WHEN regexp_matches(c, '^[0-9]+歳') THEN 0.0 END::DOUBLE AS grade FROM h"""
    ),
)
def class_grade(spark, sf):
    q = F.col("qty").cast("int")
    title = F.get(F.array(*[F.lit(t) for t in TITLES]), q % len(TITLES))
    cls = F.get(F.array(*[F.lit(c) for c in CLASSES]), (q + F.col("runner_no")) % len(CLASSES))
    return entries(spark, sf).select(*ID, R.class_grade(title, cls).alias("grade"))


@query(
    "distance_band",
    with_runners(
        f"""SELECT {ID_SQL}, CASE WHEN runner_no = 3 OR distance IS NULL THEN 'unknown' WHEN distance <= 1200 THEN 'sprint'
        WHEN distance <= 1600 THEN 'mile' WHEN distance <= 2200 THEN 'middle' ELSE 'long' END AS band FROM runners"""
    ),
)
def distance_band(spark, sf):
    d = F.when(F.col("runner_no") != 3, F.col("distance"))
    return runners(spark, sf).select(*ID, R.distance_band(d).alias("band"))


@query(
    "season_cycle",
    with_runners(
        f"""SELECT {ID_SQL}, round(cos(2 * pi() * dayofyear(race_date) / 365.0), 6) + 0.0 AS cos_date,
        round(sin(2 * pi() * dayofyear(race_date) / 365.0), 6) + 0.0 AS sin_date,
        CASE WHEN month(race_date) IN (12, 1, 2) THEN 0 WHEN month(race_date) < 6 THEN 1
             WHEN month(race_date) < 9 THEN 2 ELSE 3 END AS season,
        round(cos(2 * pi() * dayofyear(race_date) / 365.0) * [-1, 1, -1, 0][runner_no % 4 + 1], 6) + 0.0 AS seasonal_sex,
        CAST(CASE surface WHEN 'A' THEN -1 WHEN 'N' THEN 1 ELSE 0 END * runner_no AS DOUBLE) AS frame_race_type
        FROM runners"""
    ),
)
def season_cycle(spark, sf):
    sex = F.get(F.array(*[F.lit(s) for s in ("牡", "牝", "セ", "?")]), F.col("runner_no") % 4)
    surface = F.when(F.col("surface") == "A", F.lit("芝")).when(F.col("surface") == "N", F.lit("ダート"))
    cyc = R.season_cycle(F.col("race_date"))
    return runners(spark, sf).select(
        *ID,
        F.round(cyc["cos_date"], 6).alias("cos_date"),
        F.round(cyc["sin_date"], 6).alias("sin_date"),
        cyc["season"].alias("season"),
        F.round(cyc["cos_date"] * R.sex_code(sex), 6).alias("seasonal_sex"),
        (R.surface_code(surface) * F.col("runner_no")).alias("frame_race_type"),
    )


def _lap_json():
    """Cumulative laps 200..1000 as JSON text; one is null, one out of range, some text is not JSON."""
    q, no = F.col("qty").cast("int"), F.col("runner_no")
    parts = [
        F.concat(F.lit('{"200": '), q + 10, F.lit(".1")),
        F.concat(F.lit('"400": '), q + no + 21, F.lit(".4")),
        F.concat(F.lit('"600": '), q + no + 33, F.lit(".7")),
        F.concat(F.lit('"800": '), F.when(no == 2, F.lit("null")).otherwise((q + no + 46).cast("string"))),
        F.concat(F.lit('"1000": '), F.when(no == 4, F.lit("900")).otherwise((q + no + 58).cast("string")), F.lit("}")),
    ]
    return F.when(no == 7, F.lit("not json")).otherwise(F.concat_ws(", ", *parts))


_LAPS_SQL = """laps AS (SELECT *, q + 10 + 0.1::DOUBLE AS l200, q + runner_no + 21 + 0.4::DOUBLE AS l400,
   q + runner_no + 33 + 0.7::DOUBLE AS l600, CASE WHEN runner_no <> 2 THEN CAST(q + runner_no + 46 AS DOUBLE) END AS l800,
   CASE WHEN runner_no = 4 THEN 900.0 ELSE CAST(q + runner_no + 58 AS DOUBLE) END AS l1000
   FROM (SELECT *, CAST(qty AS INTEGER) AS q FROM {src}))"""


@query(
    "lap_expand",
    with_entries(
        f""", {_LAPS_SQL.format(src="entries")}
        SELECT {ID_SQL}, """
        + ", ".join(
            f"CASE WHEN runner_no <> 7 THEN round(l{d}, 3) END AS lap_{d}m" if d <= 1000 else f"NULL AS lap_{d}m"
            for d in A.LAP_DISTANCES
        )
        + " FROM laps"
    ),
)
def lap_expand(spark, sf):
    df = entries(spark, sf).withColumn("laps", A.lap_map(_lap_json()))
    out = df.select(*ID, *A.lap_columns(F.col("laps"), "lap"))
    return out.select(*ID, *[r(f"lap_{d}m", 3) for d in A.LAP_DISTANCES])


_SECTIONS_SQL = """sect AS (SELECT *, round(l200, 1) AS s200, round(l400 - l200, 1) AS s400, round(l600 - l400, 1) AS s600,
   CASE WHEN l800 IS NOT NULL THEN round(l800 - l600, 1) END AS s800,
   CASE WHEN l1000 <= 200 THEN round(l1000 - coalesce(l800, l600), 1) END AS s1000 FROM laps)"""


@query(
    "lap_to_sectional",
    with_entries(
        f""", {_LAPS_SQL.format(src="entries")}, {_SECTIONS_SQL}
        SELECT {ID_SQL}, """
        + ", ".join(f"CASE WHEN runner_no <> 7 THEN s{d} + 0.0 END AS sect_{d}m" for d in (200, 400, 600, 800, 1000))
        + " FROM sect"
    ),
)
def lap_to_sectional(spark, sf):
    df = A.with_sectionals(entries(spark, sf).withColumn("laps", A.lap_map(_lap_json())), "laps", "sect")
    df = df.withColumn("sect", F.map_from_entries("sect"))
    return df.select(*ID, *A.lap_columns(F.col("sect"), "sect", [200, 400, 600, 800, 1000]))


@query(
    "pace_summary",
    with_runners(
        f""", {_LAPS_SQL.format(src="runners")}, {_SECTIONS_SQL},
        long AS (SELECT {ID_SQL}, price, qty, discount, tax, distance, d, CASE WHEN runner_no = 7 THEN NULL WHEN d = 200 THEN s200
            WHEN d = 400 THEN s400 WHEN d = 600 THEN s600 WHEN d = 800 THEN s800 WHEN d = 1000 THEN s1000 END AS t
          FROM sect, (SELECT unnest([200, 400, 600, 800, 1000]) AS d)),
        halves AS (SELECT *, least(distance // 200, 5) AS k FROM long WHERE d <= distance),
        m AS (SELECT {ID_SQL}, price, qty, discount, tax, max(k) AS k,
          avg(CASE WHEN d <= (k // 2) * 200 AND t > 0 THEN t END) AS f, avg(CASE WHEN d > (k // 2) * 200 AND t > 0 THEN t END) AS b,
          count(*) // max(k) AS copies FROM halves GROUP BY ALL)
        SELECT {ID_SQL}, CASE WHEN k >= 2 AND b IS NOT NULL THEN round(f, 6) END AS race_pace_front,
          CASE WHEN k >= 2 AND f IS NOT NULL THEN round(b, 6) END AS race_pace_back,
          CASE WHEN k >= 2 THEN round(f - b, 6) + 0.0 END AS race_pace_diff,
          CASE WHEN k >= 2 THEN round(f / b, 6) END AS race_pace_ratio
        FROM m, (SELECT unnest(range(1, 50)) AS i) WHERE i <= copies
        UNION ALL SELECT {ID_SQL}, NULL, NULL, NULL, NULL FROM runners WHERE distance < 200"""
    ),
)
def pace_summary(spark, sf):
    df = A.with_sectionals(runners(spark, sf).withColumn("laps", A.lap_map(_lap_json())), "laps", "sect")
    df = df.withColumn("sect", F.map_from_entries("sect"))
    timed = [200, 400, 600, 800, 1000]
    df = df.select(*ID, "distance", *A.lap_columns(F.col("sect"), "sect", timed))
    df = A.with_pace(df, {d: f"sect_{d}m" for d in timed}, "distance")
    return df.select(*ID, *[r(f"race_pace_{k}") for k in ("front", "back", "diff", "ratio")])


@query(
    "corner_stats",
    with_entries(
        f"""SELECT {ID_SQL}, round(list_avg(c), 6) AS corner_position_avg,
        CASE WHEN len(c) > 1 THEN round(list_var_pop(c), 6) ELSE 0.0 END AS corner_position_variance,
        c[-1] AS last_corner_position, CASE WHEN len(c) > 1 THEN c[1] - c[-1] ELSE 0 END AS position_change
        FROM (SELECT *, {_CORNERS_SQL} AS c FROM entries)"""
    ),
)
def corner_stats(spark, sf):
    df = entries(spark, sf).withColumn("c", T.split_corners(_corner_text()))
    s = A.corner_stats(F.col("c"))
    return df.select(
        *ID,
        F.round(s["corner_position_avg"], 6).alias("corner_position_avg"),
        F.round(s["corner_position_variance"], 6).alias("corner_position_variance"),
        s["last_corner_position"].alias("last_corner_position"),
        s["position_change"].alias("position_change"),
    )


@query(
    "running_style",
    with_entries(
        f"""SELECT {ID_SQL}, s AS running_style_num, ['逃げ', '先行', '差し', '追込'][s + 1] AS running_style FROM (
        SELECT *, CASE WHEN len(c) = 0 THEN NULL WHEN c[1] <= 2 AND list_avg(c) <= n / 3.0 THEN 0
          WHEN list_avg(c) <= n / 3.0 THEN 1 WHEN list_avg(c) <= n * 2 / 3.0 THEN 2 ELSE 3 END AS s
        FROM (SELECT *, {_CORNERS_SQL} AS c, CASE WHEN runner_no = 2 THEN 8
          ELSE greatest(CAST(discount * 200 AS INTEGER), 2) END AS n FROM entries WHERE discount > 0 OR runner_no = 2
          UNION ALL SELECT *, {_CORNERS_SQL}, 8 FROM entries WHERE NOT (discount > 0 OR runner_no = 2)))"""
    ),
)
def running_style(spark, sf):
    size = F.when(F.col("runner_no") != 2, F.round(F.col("discount") * 200).cast("int"))
    df = entries(spark, sf).withColumn("c", T.split_corners(_corner_text()))
    code = A.running_style(F.col("c"), size)
    return df.select(*ID, code.alias("running_style_num"), A.style_name(code).alias("running_style"))


@query(
    "category_dummies",
    with_entries(
        f"""SELECT {ID_SQL}, CAST(runner_no <> 7 AND q <= 3 AS INTEGER) AS is_young, CAST(runner_no <> 7 AND q BETWEEN 4 AND 6 AS INTEGER) AS is_prime,
        CAST(runner_no <> 7 AND q >= 7 AS INTEGER) AS is_veteran, CAST(surface = 'A' AS INTEGER) AS sex_A, CAST(surface = 'N' AS INTEGER) AS sex_N,
        CAST(surface = 'R' AS INTEGER) AS sex_R, CAST(status = 'F' AS INTEGER) AS pace_F, CAST(status = 'O' AS INTEGER) AS pace_O
        FROM (SELECT *, CAST(qty AS INTEGER) AS q FROM entries)"""
    ),
)
def category_dummies(spark, sf):
    age = F.when(F.col("runner_no") != 7, F.col("qty").cast("int"))
    return entries(spark, sf).select(
        *ID,
        *R.age_bands(age),
        *R.one_hot(F.col("surface"), ["A", "N", "R"], "sex"),
        *R.one_hot(F.col("status"), ["F", "O"], "pace"),
    )


@query(
    "rest_bins",
    with_entries(
        f"""SELECT {ID_SQL}, CASE WHEN d <= 14 THEN 'short' WHEN d <= 30 THEN 'normal' WHEN d <= 60 THEN 'long'
          WHEN d > 60 THEN 'very_long' END AS rest_class,
        CASE WHEN d <= -1 THEN NULL WHEN d <= 0 THEN 0 WHEN d <= 21 THEN 1 WHEN d <= 90 THEN 2 WHEN d > 90 THEN 3 END AS rest_code
        FROM (SELECT *, CASE WHEN runner_no <> 5 THEN CAST(qty AS INTEGER) * 3 - 6 END AS d FROM entries)"""
    ),
)
def rest_bins(spark, sf):
    d = F.when(F.col("runner_no") != 5, F.col("qty").cast("int") * 3 - 6)
    return entries(spark, sf).select(*ID, R.rest_class(d).alias("rest_class"), R.rest_code(d).alias("rest_code"))


@query(
    "field_ratio",
    with_entries(
        f"SELECT {ID_SQL}, round(finish / CAST(nullif(runner_no % 4, 0) AS DOUBLE), 6) AS finish_ratio FROM entries"
    ),
)
def field_ratio(spark, sf):
    return entries(spark, sf).select(
        *ID, F.round(R.ratio(F.col("finish"), F.col("runner_no") % 4), 6).alias("finish_ratio")
    )


@query(
    "prev_start_deltas",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_linenumber = 1 THEN 7 ELSE CASE WHEN g >= 1 THEN g END END AS days_since_last,
      CAST(c AS INTEGER) AS distance_change, CASE WHEN c > 0 THEN 1 ELSE 0 END AS distance_increased,
      CASE WHEN c < 0 THEN 1 ELSE 0 END AS distance_decreased
    FROM (SELECT *, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS g,
      CASE WHEN l_linenumber <> 4 THEN p_size * 100 - CAST(l_quantity AS INTEGER) * 100 END AS c
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
)
def prev_start_deltas(spark, sf):
    li = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    no = F.col("l_linenumber")
    known = F.when(no == 1, F.lit(7))
    days = R.days_between(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    change = F.when(no != 4, F.col("p_size") * 100 - F.col("l_quantity").cast("int") * 100)
    up, down = R.sign_flags(change)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(no == 1, known).otherwise(days).alias("days_since_last"),
        change.alias("distance_change"),
        up.alias("distance_increased"),
        down.alias("distance_decreased"),
    )


@query(
    "career_rate",
    with_entries(f"SELECT {ID_SQL}, CASE WHEN runner_no % 4 > 0 THEN round(finish / CAST(runner_no % 4 AS DOUBLE), 6) END AS win_rate FROM entries"),
)
def career_rate(spark, sf):
    return entries(spark, sf).select(
        *ID, F.round(R.career_rate(F.col("finish"), F.col("runner_no") % 4), 6).alias("win_rate")
    )


@query(
    "speed_index",
    with_runners(
        f"""SELECT {ID_SQL}, round(a, 6) AS prev_speed, round(b, 6) AS prev2_speed, round(a - b, 6) + 0.0 AS speed_change FROM (
        SELECT *, CASE WHEN qty > 5 THEN distance / (qty - 5) END AS a, CASE WHEN odds > 0 THEN distance / odds END AS b FROM runners)"""
    ),
)
def speed_index(spark, sf):
    a = R.speed_index(F.col("distance"), F.col("qty") - 5)
    b = R.speed_index(F.col("distance"), F.col("odds"))
    return runners(spark, sf).select(
        *ID, F.round(a, 6).alias("prev_speed"), F.round(b, 6).alias("prev2_speed"), F.round(a - b, 6).alias("speed_change")
    )


@query(
    "form_weighted",
    with_entries(
        f"""SELECT {ID_SQL}, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(0.6 * a + 0.4 * b, 6)
          ELSE CAST(coalesce(a, b) AS DOUBLE) END AS form_weighted, CAST(a - b AS INTEGER) AS form_trend
        FROM (SELECT *, finish AS a, CASE WHEN runner_no <> 2 THEN runner_no END AS b FROM entries)"""
    ),
)
def form_weighted(spark, sf):
    last, second = F.col("finish"), F.when(F.col("runner_no") != 2, F.col("runner_no"))
    return entries(spark, sf).select(
        *ID, F.round(R.weighted_form(last, second), 6).alias("form_weighted"), (last - second).alias("form_trend")
    )


@query(
    "implied_prob",
    with_entries(
        f"""SELECT {ID_SQL}, round(CASE WHEN o > 0 THEN 1 / o END, 6) AS implied_prob,
        round(CASE WHEN p > 0 THEN 100 / p END, 6) AS payout_prob, round(ln(1 + coalesce(p, 0)), 6) AS payout_log
        FROM (SELECT *, CASE WHEN runner_no = 3 THEN 0 WHEN runner_no <> 5 THEN odds END AS o,
          CASE WHEN finish = 1 THEN price END AS p FROM entries)"""
    ),
)
def implied_prob(spark, sf):
    o = F.when(F.col("runner_no") == 3, F.lit(0.0)).when(F.col("runner_no") != 5, F.col("odds"))
    p = F.when(F.col("finish") == 1, F.col("price"))
    return entries(spark, sf).select(
        *ID,
        F.round(R.implied_prob(o), 6).alias("implied_prob"),
        F.round(R.payout_prob(p), 6).alias("payout_prob"),
        F.round(R.payout_log(p), 6).alias("payout_log"),
    )


@query(
    "missing_flags",
    with_entries(
        f"""SELECT {ID_SQL}, v AS prev_finish, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS prev_finish_is_missing,
        CASE WHEN finish IS NULL THEN 1 ELSE 0 END AS finish_is_missing
        FROM (SELECT *, TRY_CAST(trim({_DIRTY_SQL}) AS DOUBLE) AS v FROM entries)"""
    ),
)
def missing_flags(spark, sf):
    v = T.number_or_null(_dirty())
    return entries(spark, sf).select(
        *ID,
        v.alias("prev_finish"),
        R.missing_flag(v).alias("prev_finish_is_missing"),
        R.missing_flag(F.col("finish")).alias("finish_is_missing"),
    )


@query(
    "smooth_rate",
    """SELECT l_suppkey, n, round((n * (w / CAST(n AS DOUBLE)) + 0.375) / (n + 5), 6) AS smooth, CASE WHEN n >= 3 THEN 1 ELSE 0 END AS has_history
    FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS w FROM lineitem GROUP BY 1)""",
)
def smooth_rate_query(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("rate")
    )
    return g.select(
        "l_suppkey",
        "n",
        F.round(smooth_rate(F.col("rate"), F.col("n")), 6).alias("smooth"),
        has_history(F.col("n")).alias("has_history"),
    )


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS race_year, CAST(month(o_orderdate) AS INTEGER) AS race_month,
      CAST(day(o_orderdate) AS INTEGER) AS race_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS race_weekday FROM orders""",
)
def date_parts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *R.date_parts(F.col("o_orderdate"), "race"))


@query(
    "surface_change",
    with_entries(
        f"""SELECT {ID_SQL}, CASE WHEN a <> b THEN 1 ELSE 0 END AS is_surface_change FROM (SELECT *,
        CASE surface WHEN 'A' THEN 'turf' WHEN 'N' THEN 'dirt' END AS a, CASE WHEN runner_no % 3 = 0 THEN 'turf'
        WHEN runner_no % 3 = 1 THEN 'dirt' END AS b FROM entries)"""
    ),
)
def surface_change(spark, sf):
    now = F.when(F.col("surface") == "A", F.lit("芝")).when(F.col("surface") == "N", F.lit("ダート")).otherwise(F.lit("?"))
    before = F.when(F.col("runner_no") % 3 == 0, F.lit("turf")).when(F.col("runner_no") % 3 == 1, F.lit("dirt"))
    return entries(spark, sf).select(*ID, R.surface_change(now, before).alias("is_surface_change"))


@query(
    "rest_fill",
    with_runners(
        f""", d AS (SELECT *, CASE WHEN runner_no = 2 THEN 0 WHEN runner_no <> 4 THEN distance END AS dist,
          CASE WHEN runner_no <> 3 THEN sire END AS s, CASE WHEN runner_no <> 5 THEN qty END AS starts FROM runners)
        SELECT {ID_SQL}, CASE WHEN dist > 0 THEN CAST(dist AS DOUBLE)
          ELSE coalesce((SELECT quantile_cont(dist, 0.5) FROM d WHERE dist > 0), 1600.0) END AS distance,
          coalesce(s, 'Unknown') AS sire, coalesce(starts, 0) AS starts,
          CASE WHEN finish IS NULL THEN 1 ELSE 0 END AS is_first_race FROM d"""
    ),
)
def rest_fill(spark, sf):
    no = F.col("runner_no")
    df = (
        runners(spark, sf)
        .withColumn("distance", F.when(no == 2, F.lit(0)).when(no != 4, F.col("distance")).cast("double"))
        .withColumn("sire", F.when(no != 3, F.col("sire")))
        .withColumn("starts", F.when(no != 5, F.col("qty")))
    )
    out = fill_policy(df, zero=["starts"], unknown=["sire"], median={"distance": 1600.0}, first_start="finish")
    return out.select(*ID, "distance", "sire", "starts", "is_first_race")


@query(
    "page_validity",
    """SELECT page_id, CASE WHEN length(trim(html)) >= 80 AND NOT regexp_matches(lower(html), 'forbidden|access denied|cloudflare')
      THEN 1 ELSE 0 END AS valid, CASE WHEN contains(lower(html), 'script') THEN 0 ELSE 1 END AS scriptless FROM pages""",
)
def page_validity(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        P.page_valid(F.col("html")).alias("valid"),
        P.page_valid(F.col("html"), ["script"]).alias("scriptless"),
    )


ID_PATTERNS = [r'href="/([a-z]+)"', r'href="https?://[^"/]+/([A-Za-z0-9]+)/?"', r"track\(([0-9]+)\)"]


@query(
    "extract_ids",
    r"""WITH h AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, 'href="/([a-z]+)"', 1),
        regexp_extract_all(html, 'href="https?://[^"/]+/([A-Za-z0-9]+)/?"', 1),
        regexp_extract_all(html, 'track\(([0-9]+)\)', 1))) AS id FROM pages)
    SELECT page_id, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids, count(id) AS n_ids
    FROM (SELECT page_id FROM pages) LEFT JOIN (SELECT DISTINCT page_id, id FROM h WHERE id <> '') USING (page_id) GROUP BY page_id""",
)
def extract_ids(spark, sf):
    ids = P.found_ids(F.col("html"), ID_PATTERNS)
    return table(spark, sf, "pages").select(
        "page_id", F.array_join(ids, ",").alias("ids"), F.size(ids).cast("bigint").alias("n_ids")
    )


@query(
    "extract_odds",
    with_entries(
        f"""SELECT {ID_SQL}, lpad(CAST(least(runner_no, q) AS VARCHAR), 2, '0') || ',' || lpad(CAST(greatest(runner_no, q) AS VARCHAR), 2, '0') AS pair_key,
        lpad(CAST(runner_no AS VARCHAR), 2, '0') || ',' || lpad(CAST(q AS VARCHAR), 2, '0') AS exact_key, CAST(q + 0.5 AS DOUBLE) AS odds
        FROM (SELECT *, CAST(qty AS INTEGER) AS q FROM entries)"""
    ),
)
def extract_odds(spark, sf):
    q = text_of(F.col("qty"))
    cell = F.concat(
        F.lit("<tr><TD>"), F.col("runner_no"), F.lit(","), q,
        F.lit('</td> <td class="oddsvalue">'), q, F.lit(".5</td></tr>"),
    )
    df = entries(spark, sf).withColumn("html", cell)
    pairs = P.odds_cells(F.col("html"), 2, ordered=False)
    exact = P.odds_cells(F.col("html"), 2, ordered=True)
    return df.select(*ID, F.explode(F.arrays_zip(pairs.alias("p"), exact.alias("e"))).alias("z")).select(
        *ID, F.col("z.p.key").alias("pair_key"), F.col("z.e.key").alias("exact_key"), F.col("z.p.odds").alias("odds")
    )


@query(
    "extract_odds_by_bet",
    with_entries(
        """, c AS (SELECT race_id, list_transform(range(1, 4), lambda k: CAST((CAST(qty AS INTEGER) * k + runner_no) % 120 AS BIGINT)) AS n, runner_no, row_number() OVER (PARTITION BY race_id ORDER BY runner_no, horse_id, jockey_id, price, qty, discount, tax) AS pos FROM entries),
        k AS (SELECT race_id, pos, runner_no + 0.5::DOUBLE AS odds, bet, CASE WHEN bet IN ('quinella', 'trio') THEN list_sort(n[1:legs]) ELSE n[1:legs] END AS ns
          FROM c, (VALUES ('win', 1), ('quinella', 2), ('exacta', 2), ('trio', 3), ('trifecta', 3)) b(bet, legs)),
        s AS (SELECT race_id, bet, pos, odds, array_to_string(list_transform(ns, lambda x: CASE WHEN x < 10 THEN '0' ELSE '' END || CAST(x AS VARCHAR)), ',') AS key FROM k)
        SELECT race_id, bet AS bet_type, key, arg_max(odds, pos) AS odds FROM s GROUP BY ALL"""
    ),
)
def extract_odds_by_bet(spark, sf):
    """One page for each race with a row of cells for every runner, whose keys meet again on the page."""

    def cells(x):
        n = [F.format_string("%d", ((x["qty"].cast("int") * k + x["runner_no"]) % 120).cast("bigint")) for k in (1, 2, 3)]
        odds = F.concat(F.lit("</td>\n<TD class=\"oddsvalue\">"), x["runner_no"], F.lit(".5</TD></tr>"))
        return F.concat(*[c for m in (1, 2, 3) for c in (F.lit("<tr><td>"), F.concat_ws(",", *n[:m]), odds)])

    order = ["runner_no", "horse_id", "jockey_id", "price", "qty", "discount", "tax"]
    pages = entries(spark, sf).groupBy("race_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), cells), "").alias("html")
    )
    kinds = F.array(*[F.struct(F.lit(b).alias("bet_type"), P.odds_of_bet(F.col("html"), b).alias("cells")) for b in P.BET_ODDS])
    return pages.select("race_id", F.explode(kinds).alias("k")).select(
        "race_id", "k.bet_type", F.explode("k.cells").alias("c")
    ).select("race_id", "bet_type", "c.key", "c.odds")


_RACE_PAGE = (
    """concat('<html><title>t</title><h1> </h1><h1>', CASE o_orderkey % 4 WHEN 0 THEN '東京特別' WHEN 1 THEN concat('夏の障害 ', 2000 + o_orderkey % 9 * 100, 'm') WHEN 2 THEN '3歳未勝利' ELSE '記念(G2)' END, '</h1>',
      CASE WHEN o_orderkey % 4 < 3 THEN concat('<div class="x mainrace_data"><span>', CASE o_orderkey % 4 WHEN 0 THEN concat('芝右外', 1000 + o_orderkey % 9 * 100, 'm') WHEN 1 THEN '距離不明' ELSE concat('直線 ダート 距離 ', 1200 + o_orderkey % 5 * 100, 'ｍ') END,
        '</span> / 天候 : ', CASE WHEN o_custkey % 2 = 0 THEN '晴' ELSE '小雨' END, ' / ', CASE o_orderkey % 4 WHEN 0 THEN '芝 : 良' ELSE '馬場：稍重' END, ' / 発走 : ', 9 + o_orderkey % 8, ':05</div>') ELSE '' END,
      CASE WHEN o_custkey % 3 > 0 THEN concat('<p class="smalltxt">', date_format(o_orderdate, 'yyyy'), '年', month(o_orderdate), '月', day(o_orderdate), '日 ', o_custkey % 7 + 1, '回東京', o_custkey % 12 + 1, '日目 1勝クラス</p>') ELSE '' END, '</html>')"""
)


@query(
    "race_page_fields",
    """WITH o AS (SELECT *, o_orderkey % 4 AS v, o_custkey % 3 > 0 AS small FROM orders)
    SELECT o_orderkey AS page_id, CASE v WHEN 0 THEN '東京特別' WHEN 1 THEN '夏の障害 ' || (2000 + o_orderkey % 9 * 100) || 'm' WHEN 2 THEN '3歳未勝利' ELSE '記念(G2)' END AS race_name,
      CASE v WHEN 0 THEN '芝' WHEN 1 THEN '障害' WHEN 2 THEN 'ダート' END AS surface,
      CAST(CASE v WHEN 0 THEN 1000 + o_orderkey % 9 * 100 WHEN 1 THEN 2000 + o_orderkey % 9 * 100 WHEN 2 THEN 1200 + o_orderkey % 5 * 100 END AS INTEGER) AS distance,
      CASE WHEN v < 3 THEN CASE WHEN o_custkey % 2 = 0 THEN '晴' ELSE '小雨' END END AS weather, CASE v WHEN 0 THEN '良' WHEN 1 THEN '稍重' WHEN 2 THEN '稍重' END AS going,
      CASE WHEN small THEN strftime(o_orderdate, '%Y%m%d') END AS race_date, CASE WHEN v < 3 THEN (9 + o_orderkey % 8) || ':05' END AS post_time,
      CASE WHEN v = 2 THEN '未勝利' WHEN v = 3 THEN 'G2' WHEN small THEN '1勝クラス' WHEN v = 0 THEN 'オープン' ELSE '不明' END AS race_class,
      CASE WHEN small THEN CAST(o_custkey % 7 + 1 AS INTEGER) END AS meeting, CASE WHEN small THEN CAST(o_custkey % 12 + 1 AS INTEGER) END AS meeting_day,
      CASE v WHEN 0 THEN '右外' WHEN 2 THEN '直線' END AS direction FROM o""",
)
def race_page_fields(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.expr(_RACE_PAGE).alias("html")).transform(
        lambda df: race_fields(df, F.col("html")).drop("html")
    )


PAGE_RULES = {
    "title": [r"<h1[^>]*>([^<]*)</h1>", r"<title>([^<]*)</title>"],
    "lang": [r'<html[^>]*lang="([a-z]+)"', r'<meta[^>]*language[^>]*content="([a-z]+)"'],
    "first_link": [r'<a href="([^"]*)"', r'src="([^"]*)"'],
    "first_text": [r"<p>([^<]+)", r"<div[^>]*>([^<]+)"],
}


def _field_sql(patterns):
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(html, '{p}', 1)), '')" for p in patterns) + ")"


@query(
    "page_fields",
    "SELECT page_id, " + ", ".join(f"{_field_sql(p)} AS {n}" for n, p in PAGE_RULES.items()) + " FROM pages",
)
def page_fields(spark, sf):
    return table(spark, sf, "pages").select("page_id", *P.page_fields(F.col("html"), PAGE_RULES))
