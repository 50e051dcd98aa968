"""Feature analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.operators import analysis as A
from furlong.verify.base import entries, query, r, runners, with_entries, with_runners
from furlong.verify.modelling import CATEGORIES, NUMERIC, _split

ID_SQL = "race_id, runner_no, horse_id, jockey_id"

_NUM = {"odds": "odds", "finish": "finish", "qty": "qty", "distance": "distance", "gaps": "CASE WHEN runner_no = 1 THEN tax END"}
_TXT = {"venue": "venue", "surface": "surface", "horse_name": "horse_name", "dam": "CASE WHEN runner_no > 5 THEN dam END"}


def _frame(spark, sf):
    return runners(spark, sf).withColumns(
        {
            "gaps": F.when(F.col("runner_no") == 1, F.col("tax")),
            "dam": F.when(F.col("runner_no") > 5, F.col("dam")),
        }
    )


def _profile_sql():
    num = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({e} AS DOUBLE) AS x FROM runners" for c, e in _NUM.items())
    txt = " UNION ALL ".join(f"SELECT '{c}' AS col, {e} AS x FROM runners" for c, e in _TXT.items())
    band = "CASE WHEN p = 0 THEN '0' WHEN p <= 1 THEN '0-1' WHEN p <= 20 THEN '1-20' WHEN p <= 50 THEN '20-50' ELSE '>50' END"
    return with_runners(
        f""", num AS ({num}), txt AS ({txt}),
        a AS (SELECT col, round((1 - count(x) / CAST(count(*) AS DOUBLE)) * 100, 1) + 0.0 AS p, count(DISTINCT x) AS d, quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM num GROUP BY col),
        t AS (SELECT col, string_agg(x || ':' || n, ' | ' ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, x) AS rn FROM (SELECT col, x, count(*) AS n FROM txt WHERE x IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY col),
        b AS (SELECT col, round((1 - count(x) / CAST(count(*) AS DOUBLE)) * 100, 1) + 0.0 AS p, count(DISTINCT x) AS d FROM txt GROUP BY col)
        SELECT col AS "column", p AS null_pct, {band} AS null_band, d AS "distinct", round(q[1], 3) AS min, round(q[2], 3) AS q1, round(q[3], 3) AS median, round(q[4], 3) AS q3, round(q[5], 3) AS max, '' AS top_values FROM a
        UNION ALL SELECT b.col, p, {band}, d, NULL, NULL, NULL, NULL, NULL, top FROM b JOIN t ON b.col = t.col"""
    )


@query("column_profile", _profile_sql())
def column_profile(spark, sf):
    return A.column_profile(_frame(spark, sf), list(_NUM), list(_TXT))


@query(
    "outlier_rate",
    with_entries(
        """, l AS (SELECT 'price' AS col, CASE WHEN runner_no = 1 AND qty > 40 THEN price * 50 ELSE price END AS x FROM entries UNION ALL SELECT 'qty', qty FROM entries UNION ALL SELECT 'flat', CASE WHEN qty = 50 THEN 9 ELSE 1 END FROM entries),
        q AS (SELECT col, quantile_cont(CAST(x AS DOUBLE), 0.25) AS a, quantile_cont(CAST(x AS DOUBLE), 0.75) AS b FROM l GROUP BY 1)
        SELECT l.col AS "column", CASE WHEN max(b - a) = 0 THEN 0.0 ELSE round(avg(CASE WHEN x < a - 3 * (b - a) OR x > b + 3 * (b - a) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) END AS outlier_rate FROM l JOIN q ON l.col = q.col GROUP BY 1"""
    ),
)
def outlier_rate(spark, sf):
    df = entries(spark, sf).select(
        F.when((F.col("runner_no") == 1) & (F.col("qty") > 40), F.col("price") * 50).otherwise(F.col("price")).alias("price"),
        "qty",
        F.when(F.col("qty") == 50, 9).otherwise(1).alias("flat"),
    )
    return A.outlier_rate(df, ["price", "qty", "flat"]).select("column", r("outlier_rate"))


@query(
    "spearman_target",
    with_runners(
        """, m AS (SELECT quantile_cont(CASE WHEN runner_no <> 3 THEN price END, 0.5) AS md FROM runners),
        f AS (SELECT coalesce(CASE WHEN runner_no <> 3 THEN price END, md) AS price, qty, distance, coalesce(finish, 20) AS y FROM runners, m),
        k AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0::DOUBLE AS b,
          rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0::DOUBLE AS c, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS y FROM f)
        SELECT 'price' AS feature, round(corr(a, y), 6) AS spearman FROM k UNION ALL SELECT 'qty', round(corr(b, y), 6) FROM k UNION ALL SELECT 'distance', round(corr(c, y), 6) FROM k"""
    ),
)
def spearman_target(spark, sf):
    df = runners(spark, sf).select(
        F.when(F.col("runner_no") != 3, F.col("price")).alias("price"), "qty", "distance", F.coalesce("finish", F.lit(20)).alias("y")
    )
    return A.spearman_target(df, ["price", "qty", "distance"], "y").select("feature", r("spearman"))


@query(
    "mutual_info",
    with_runners(
        """, l AS (SELECT 'qty' AS f, qty AS x, CASE WHEN finish <= 3 THEN 1 ELSE 0 END AS y FROM runners UNION ALL SELECT 'price', price, CASE WHEN finish <= 3 THEN 1 ELSE 0 END FROM runners UNION ALL SELECT 'distance', distance, CASE WHEN finish <= 3 THEN 1 ELSE 0 END FROM runners),
        q AS (SELECT f, quantile_cont(CAST(x AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM l GROUP BY f),
        b AS (SELECT l.f, y, len(list_filter(q.q, lambda e: e < l.x)) AS bin, count(*)::DOUBLE AS n FROM l JOIN q ON l.f = q.f GROUP BY 1, 2, 3),
        c AS (SELECT f, n, sum(n) OVER (PARTITION BY f, bin) AS nb, sum(n) OVER (PARTITION BY f, y) AS ny, sum(n) OVER (PARTITION BY f) AS nt FROM b)
        SELECT f AS feature, round(sum(n / nt * ln(n * nt / (nb * ny))), 6) + 0.0 AS mutual_info FROM c GROUP BY f"""
    ),
)
def mutual_info(spark, sf):
    df = runners(spark, sf).withColumn("y", F.coalesce((F.col("finish") <= 3).cast("int"), F.lit(0)))
    return A.mutual_info(df, ["qty", "price", "distance"], "y").select("feature", r("mutual_info"))


_CORR = ["odds", "price", "qty", "twice", "discount", "tax"]


def _corr_frame(spark, sf):
    return entries(spark, sf).withColumn("twice", F.col("qty") * 2 + F.col("tax"))


def _corr_sql():
    pairs = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
    rows = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM c" for a, b in pairs)
    return with_entries(f", c AS (SELECT *, qty * 2 + tax AS twice FROM entries), z AS ({rows}) SELECT * FROM z WHERE abs(r) >= 0.85")


@query("high_corr_pairs", _corr_sql())
def high_corr_pairs(spark, sf):
    return A.high_corr_pairs(_corr_frame(spark, sf), _CORR)


@query(
    "vif",
    # one over one less the share of a column's variance that a regression on the two others explains
    with_entries(
        """, c AS (SELECT corr(price, qty) AS pq, corr(price, mixed) AS pm, corr(qty, mixed) AS qm FROM (SELECT *, price + qty * 500 + discount * 100000 AS mixed FROM entries)),
        d AS (SELECT *, 1 + 2 * pq * pm * qm - pq * pq - pm * pm - qm * qm AS det FROM c)
        SELECT 'price' AS feature, round((1 - qm * qm) / det, 4) AS vif FROM d UNION ALL SELECT 'qty', round((1 - pm * pm) / det, 4) FROM d
        UNION ALL SELECT 'mixed', round((1 - pq * pq) / det, 4) FROM d"""
    ),
)
def vif(spark, sf):
    mixed = F.col("price") + F.col("qty") * 500 + F.col("discount") * 100000
    return A.vif(entries(spark, sf).withColumn("mixed", mixed), ["price", "qty", "mixed"]).select("feature", r("vif", 4))


@query(
    "permutation_importance",
    "SELECT unnest(['odds', 'qty', 'surface', 'discount', 'tax', 'runner_no', 'distance', 'venue']) AS feature, unnest([TRUE, TRUE, TRUE, FALSE, FALSE, FALSE, FALSE, FALSE]) AS matters",
)
def permutation_importance(spark, sf):
    from furlong.operators import model as M

    train, test = _split(spark, sf)
    model = M.train_logistic(train, M.prep_stages(NUMERIC, CATEGORIES))
    predict = lambda d: M.win_probability(model.transform(d)).select("probability_1", "label")
    columns = [*NUMERIC, *CATEGORIES, "label", "race_id", "horse_id", "price"]
    out = A.permutation_importance(
        test.select(*dict.fromkeys(columns)), predict, [*NUMERIC, *CATEGORIES], "label", "probability_1", ["race_id", "horse_id", "price"]
    )
    # the label is made from odds, quantity and surface
    return out.select("feature", (F.col("importance") > 0.02).alias("matters"))
