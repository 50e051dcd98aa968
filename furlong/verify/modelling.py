"""Labels, splits, encoding, training, scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.operators import model as M
from furlong.operators import prep as P
from furlong.plans.features import stored
from furlong.verify.base import entries, query, r, runners, with_entries, with_runners

ID = ["race_id", "runner_no", "horse_id", "jockey_id"]
ID_SQL = "race_id, runner_no, horse_id, jockey_id"


@query(
    "make_target",
    with_runners(
        f""", t AS (SELECT *, CAST(CAST(floor(price) AS BIGINT) % 60 AS VARCHAR) AS time, 60 + CAST(qty AS INTEGER) AS secs FROM runners),
        w AS (SELECT *, min(CASE WHEN finish = 1 THEN time END) OVER (PARTITION BY race_id) AS wt, distance / CAST(secs AS DOUBLE) AS v FROM t)
        SELECT {ID_SQL}, CASE WHEN finish = 1 THEN 1 ELSE 0 END AS win, CASE WHEN finish <= 3 THEN 1 ELSE 0 END AS place3,
          CASE WHEN finish = 1 OR (finish IS NOT NULL AND time = wt) THEN 1 ELSE 0 END AS win_tie,
          round((v - avg(v) OVER g) / nullif(stddev_samp(v) OVER g, 0), 4) + 0.0 AS speed_deviation,
          CAST(coalesce((SELECT max(finish) FROM runners) - finish + 1, 0) AS INTEGER) AS rank_label FROM w WINDOW g AS (PARTITION BY distance, surface)"""
    ),
)
def make_target(spark, sf):
    df = runners(spark, sf).withColumns(
        {
            "time": (F.floor("price") % 60).cast("string"),
            "time_seconds": 60 + F.col("qty").cast("int"),
        }
    )
    base = df
    for target in ("win", "place3", "win_tie", "speed_deviation", "rank"):
        df = P.label(df, target, out=f"y_{target}", source=base)
    return df.select(
        *ID,
        F.col("y_win").alias("win"),
        F.col("y_place3").alias("place3"),
        F.col("y_win_tie").alias("win_tie"),
        r("y_speed_deviation", 4, "speed_deviation"),
        F.col("y_rank").alias("rank_label"),
    )


@query(
    "period_filter",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y%m%d') END AS day FROM orders
    WHERE CASE WHEN o_orderkey % 4 = 0 THEN substr(CAST(199600000000 + o_orderkey AS VARCHAR), 1, 6) ELSE strftime(o_orderdate, '%Y%m') END BETWEEN '199600' AND '199706'""",
)
def period_filter(spark, sf):
    k = F.col("o_orderkey")
    df = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey",
        F.when(k % 4 == 0, F.lit("bad")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"),
        (F.lit(199600000000) + k).alias("race_id"),
    )
    return df.filter(P.in_period(F.col("day"), F.col("race_id"), "1996-00", "1997-06")).drop("race_id")


@query(
    "time_split",
    with_runners(
        f""", c AS (SELECT max(race_date) - INTERVAL 90 DAY AS d, floor(quantile_cont(CAST(epoch(race_date) / 86400 AS DOUBLE), 0.8)) AS q FROM runners)
        SELECT {ID_SQL}, CASE WHEN race_date >= d THEN 'test' ELSE 'train' END AS by_days, CASE WHEN epoch(race_date) / 86400 > q THEN 'test' ELSE 'train' END AS by_share FROM runners, c"""
    ),
)
def time_split(spark, sf):
    df = P.time_split(runners(spark, sf), "race_date", ["race_id"], last_days=90, out="by_days")
    df = P.time_split(df, "race_date", ["race_id"], test_size=0.2, out="by_share")
    return df.select(*ID, "by_days", "by_share")


@query("leak_guard", with_runners("SELECT runner_no, odds, price, qty, distance, finish FROM runners"))
def leak_guard(spark, sf):
    df = runners(spark, sf).select(*ID, "odds", "price", "qty", "distance", "finish", "venue", "surface", "race_date", F.lit(1.0).alias("last_3f"))
    return P.leak_guard(df, keep=["finish"], also=["race_date"])


@query(
    "label_encode",
    with_runners(
        f""", f AS (SELECT *, CASE WHEN runner_no <> 3 THEN sire END AS s FROM runners),
        t AS (SELECT coalesce(s, 'Unknown') AS s, row_number() OVER (ORDER BY coalesce(s, 'Unknown')) - 1 AS code FROM (SELECT DISTINCT coalesce(s, 'Unknown') AS s FROM f WHERE race_date < DATE '1995-03-01'))
        SELECT {ID_SQL}, t.code AS sire_code, CASE surface WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS surface_code FROM f LEFT JOIN t ON coalesce(f.s, 'Unknown') = t.s"""
    ),
)
def label_encode(spark, sf):
    df = runners(spark, sf).withColumn("s", F.when(F.col("runner_no") != 3, F.col("sire")))
    early = df.filter(F.col("race_date") < F.lit("1995-03-01").cast("date"))
    out = P.label_encode(df, "s", P.label_table(early, "s"), "sire_code")
    out = P.label_encode(out, "surface", P.label_table(df, "surface"), "surface_code")
    return out.select(*ID, "sire_code", "surface_code")


@query("drop_sparse", with_entries(f"SELECT {ID_SQL}, odds, finish FROM entries"))
def drop_sparse(spark, sf):
    df = entries(spark, sf).select(
        *ID, "odds", "finish", F.when(F.col("qty") == 50, F.lit(1)).alias("rare"), F.lit(None).cast("int").alias("empty")
    )
    return P.drop_sparse(df, keep=["race_id"])


@query("drop_constant", with_entries(f"SELECT {ID_SQL}, odds FROM entries"))
def drop_constant(spark, sf):
    df = entries(spark, sf).select(*ID, "odds", F.lit(7).alias("same"), F.lit(1.5).alias("same_too"))
    return P.drop_constant(df, keep=["race_id"])


@query("align_features", with_entries("SELECT odds, NULL::DOUBLE AS absent, qty, CAST(finish AS DOUBLE) AS finish, price, discount, tax, CAST(runner_no AS DOUBLE) AS runner_no, CAST(horse_id AS DOUBLE) AS horse_id, CAST(jockey_id AS DOUBLE) AS jockey_id FROM entries"))
def align_features(spark, sf):
    return P.align_features(
        entries(spark, sf), ["odds", "absent", "qty", "finish", "price", "discount", "tax", "runner_no", "horse_id", "jockey_id"]
    )


NUMERIC = ["odds", "qty", "discount", "tax", "runner_no", "distance"]
CATEGORIES = ["surface", "venue"]


def _training(spark, sf):
    """Runners with a label that depends on their columns and some noise from a hash.

    Written once: every fit, split and scoring passes over them, and none joins the tables again.
    """
    noise = P.stable_unit(["race_id", "horse_id", "price"])
    df = runners(spark, sf).withColumn("odds", F.when(F.col("runner_no") != 5, F.col("odds")))
    y = (0.6 - 0.004 * F.coalesce(F.col("odds"), F.lit(50.0)) + 0.006 * F.col("qty") + 0.3 * (F.col("surface") == "A").cast("int")) > noise
    df = df.withColumn("label", y.cast("double"))
    return stored(df.select(*dict.fromkeys([*ID, *NUMERIC, *CATEGORIES, "race_date", "price", "label"])))


def _split(spark, sf):
    df = P.time_split(_training(spark, sf), "race_date", ["race_id"], test_size=0.3)
    return df.filter("split = 'train'"), df.filter("split = 'test'")


@query("prep_stages", with_runners(f"SELECT {ID_SQL}, 16::BIGINT AS width, 2.0::DOUBLE AS hot, 0::BIGINT AS gaps FROM runners"))
def prep_stages(spark, sf):
    from pyspark.ml import Pipeline

    df = M.fill_modes(_training(spark, sf), CATEGORIES)
    out = Pipeline(stages=M.prep_stages(NUMERIC, CATEGORIES)).fit(df).transform(df)
    out = out.withColumn("_f", M.vector_to_array("features"))
    hot = sum((F.get("_f", F.lit(i)) for i in range(7, 16)), F.get("_f", F.lit(6)))
    gaps = F.size(F.filter("_f", lambda x: x.isNull() | F.isnan(x)))
    return out.select(*ID, F.size("_f").cast("bigint").alias("width"), hot.alias("hot"), gaps.cast("bigint").alias("gaps"))


_HOT = [*[("surface", v) for v in "ANR"], *[("venue", v) for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]]


def _gaps(df):
    """Runners with gaps: odds of runner 5, the surface of runner 6, the venue of some quantities."""
    return df.withColumns(
        {
            "odds": F.when(F.col("runner_no") != 5, F.col("odds")),
            "surface": F.when(F.col("runner_no") != 6, F.col("surface")),
            "venue": F.when(F.col("qty") != 11, F.col("venue")),
        }
    )


@query(
    "prep_pipeline",
    with_runners(
        f""", g AS (SELECT * REPLACE (CASE WHEN runner_no <> 5 THEN odds END AS odds, CASE WHEN runner_no <> 6 THEN surface END AS surface, CASE WHEN qty <> 11 THEN venue END AS venue) FROM runners),
        t AS (SELECT * FROM g WHERE race_date < DATE '1997-01-01'),
        s AS (SELECT surface AS v FROM t WHERE surface IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        n AS (SELECT venue AS v FROM t WHERE venue IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        f AS (SELECT * REPLACE (coalesce(odds, (SELECT quantile_cont(odds, 0.5) FROM t)) AS odds, coalesce(surface, (SELECT v FROM s)) AS surface, coalesce(venue, (SELECT v FROM n)) AS venue) FROM g)
        SELECT {ID_SQL}, round(odds, 6) AS f0, CAST(qty AS DOUBLE) AS f1, CAST(distance AS DOUBLE) AS f2,
          {", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f{i}" for i, (c, v) in enumerate(_HOT[:3], 3))}, 0.0::DOUBLE AS f6,
          {", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f{i}" for i, (c, v) in enumerate(_HOT[3:], 7))}, 0.0::DOUBLE AS f12 FROM f"""
    ),
)
def prep_pipeline(spark, sf):
    from pyspark.ml import Pipeline

    df = _gaps(runners(spark, sf))
    fitted = Pipeline(stages=M.prep_pipeline(["odds", "qty", "distance"], CATEGORIES)).fit(
        df.filter(F.col("race_date") < F.lit("1997-01-01").cast("date"))
    )
    out = fitted.transform(df).withColumn("_f", M.vector_to_array("features"))
    return out.select(*ID, *[F.round(F.get("_f", F.lit(i)), 6).alias(f"f{i}") for i in range(13)])


@query(
    "ev_weights_of_scores",
    with_entries(
        f""", s AS (SELECT *, 1 / (1 + exp(-((0.05 + discount * 2) * coalesce(o, 1.0) - 1 - 0.1) / 0.5)) + 1 AS w FROM (SELECT *, CASE WHEN runner_no <> 4 THEN odds END AS o FROM entries))
        SELECT {ID_SQL}, round(w / (SELECT avg(w) FROM s), 6) AS weight FROM s"""
    ),
)
def ev_weights_of_scores(spark, sf):
    df = entries(spark, sf).withColumns(
        {"oof": 0.05 + F.col("discount") * 2, "odds": F.when(F.col("runner_no") != 4, F.col("odds"))}
    )
    return M.ev_weights(df, center=0.1).select(*ID, r("weight"))


_SPLIT_SQL = ", c AS (SELECT floor(quantile_cont(CAST(epoch(race_date) / 86400 AS DOUBLE), 0.7)) AS q FROM runners), test AS (SELECT runners.* FROM runners, c WHERE epoch(race_date) / 86400 > q), train AS (SELECT runners.* FROM runners, c WHERE epoch(race_date) / 86400 <= q)"


def _report(name, scored, probability="probability_1"):
    """What must hold for any sound model: a score for every row, within 0..1, that tells winners from others."""
    m = M.eval_metrics(scored, probability, "label")
    p = F.col(probability)
    bounds = scored.agg(F.min((p.between(0, 1)).cast("int")).alias("_in"), F.avg("label").alias("_y"))
    m = M.with_row(m, bounds)
    return m.select(
        F.lit(name).alias("model"), "n", (F.col("_in") == 1).alias("in_range"), (F.col("auc") > 0.55).alias("ranks"),
        (F.col("brier") < F.col("_y") * (1 - F.col("_y"))).alias("beats_base_rate"),
    )


def _sound_sql(*rows):
    each = " UNION ALL ".join(f"SELECT '{name}' AS model, count(*) AS n, TRUE AS in_range, TRUE AS ranks, TRUE AS beats_base_rate FROM {t}" for name, t in rows)
    return with_runners(f"{_SPLIT_SQL} {each}")


@query("train_logistic", _sound_sql(("logistic", "test")))
def train_logistic(spark, sf):
    train, test = _split(spark, sf)
    model = M.train_logistic(train, M.prep_stages(NUMERIC, CATEGORIES))
    return _report("logistic", M.win_probability(model.transform(test)))


@query(
    "train_trees",
    with_runners(
        f"{_SPLIT_SQL} SELECT 'trees' AS model, count(*) AS n, TRUE AS in_range, TRUE AS ranks, TRUE AS beats_base_rate FROM test UNION ALL SELECT 'speed trees', count(*), NULL, NULL, TRUE FROM test"
    ),
)
def train_trees(spark, sf):
    train, test = _split(spark, sf)
    train = train.withColumn("validation", P.stable_unit(["race_id"], 7) < 0.2)
    stages = M.prep_stages(NUMERIC, CATEGORIES)
    model = M.train_trees(train, stages, validation="validation")
    classes = _report("trees", M.win_probability(model.transform(test)))
    speed = M.train_trees(train, stages, label="price", regression=True, validation="validation")
    err = F.col("prediction") - F.col("price")
    regression = speed.transform(test).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err * err)).alias("e"), F.stddev_pop("price").alias("d"))
    none = F.lit(None).cast("boolean")
    return classes.unionByName(
        regression.select(
            F.lit("speed trees").alias("model"), "n", none.alias("in_range"), none.alias("ranks"),
            (F.col("e") < F.col("d")).alias("beats_base_rate"),
        )
    )


@query("ev_weights", with_runners(f"{_SPLIT_SQL} SELECT count(*) AS n, 1.0::DOUBLE AS mean_weight, TRUE AS in_range, TRUE AS ranks, TRUE AS beats_base_rate FROM train"))
def ev_weights(spark, sf):
    train, _ = _split(spark, sf)
    scored = M.out_of_fold(train, M.prep_stages(NUMERIC, CATEGORIES), "race_id", folds=5)
    weights = M.ev_weights(scored).agg(F.round(F.avg("weight"), 6).alias("mean_weight"))
    return M.with_row(_report("out of fold", scored, "oof"), weights).drop("model")


@query("cross_validate", _sound_sql(("best of grid", "test")))
def cross_validate(spark, sf):
    train, test = _split(spark, sf)
    cv = M.cross_validate(train, M.prep_stages(NUMERIC, CATEGORIES), folds=3, grid={"regParam": [0.0, 0.01, 0.1]})
    return _report("best of grid", M.win_probability(cv.bestModel.transform(test)))


_FOLD_SQL = "('0x' || substr(md5(CAST(race_id AS VARCHAR)), 1, 8))::BIGINT % 5"


def _tree_search(spark, sf):
    train, _ = _split(spark, sf)
    return M.TreeSearch(train, M.prep_stages(NUMERIC, CATEGORIES), folds=5, depths=(2, 4), rounds=6)


@query(
    "cross_validate_trees",
    with_runners(
        f"""{_SPLIT_SQL} SELECT CAST(fold AS INTEGER) AS fold, depth, CAST(rounds AS INTEGER) AS rounds, n, races, TRUE AS beats_even_odds
        FROM (SELECT {_FOLD_SQL} AS fold, count(*) AS n, count(DISTINCT race_id) AS races FROM train GROUP BY 1), (VALUES (2), (4)) d(depth), range(1, 7) r(rounds)"""
    ),
)
def cross_validate_trees(spark, sf):
    search = _tree_search(spark, sf)
    races = search.table.groupBy("fold").agg(F.count_distinct("race_id").alias("races"))
    return search.losses().join(races, "fold").select(
        "fold", "depth", "rounds", "n", "races", (F.col("loss") < F.ln(F.lit(2.0))).alias("beats_even_odds")
    )


@query(
    "ev_weights_trees",
    with_runners(
        f"""{_SPLIT_SQL} SELECT CAST({_FOLD_SQL} AS INTEGER) AS fold, count(*) AS n, TRUE AS in_range, TRUE AS ranks, TRUE AS beats_base_rate,
        1.0::DOUBLE AS mean_weight FROM train GROUP BY 1"""
    ),
)
def ev_weights_trees(spark, sf):
    scored = _tree_search(spark, sf).out_of_fold()
    p, y = F.col("oof"), F.col("label")
    per_fold = scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), (F.min(p.between(0, 1).cast("int")) == 1).alias("in_range"),
        (F.corr("oof", "label") > 0.1).alias("ranks"), (M.brier("oof", "label") < F.var_pop(y)).alias("beats_base_rate"),
    )
    return M.with_row(per_fold, M.ev_weights(scored).agg(F.round(F.avg("weight"), 6).alias("mean_weight")))


_CELLS_SQL = """, y AS (SELECT *, CASE WHEN CAST(floor(price) AS BIGINT) % 100 < CASE surface WHEN 'A' THEN 30 WHEN 'N' THEN 45 ELSE 60 END
   + CASE WHEN venue < '3' THEN 10 ELSE 0 END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM runners)"""


def _cells(spark, sf):
    """A label that SQL can make too, and that leans on two categories."""
    share = F.when(F.col("surface") == "A", 30).when(F.col("surface") == "N", 45).otherwise(60)
    y = F.floor("price") % 100 < share + F.when(F.col("venue") < "3", 10).otherwise(0)
    return runners(spark, sf).withColumn("label", y.cast("double"))


@query(
    "logistic_moments",
    with_runners(
        f"""{_CELLS_SQL} SELECT 'surface' AS feature, surface AS value, count(*) AS n, round(avg(label), 4) AS mean_probability FROM y GROUP BY 2
        UNION ALL SELECT 'venue', venue, count(*), round(avg(label), 4) FROM y GROUP BY 2"""
    ),
)
def logistic_moments(spark, sf):
    """At the maximum of the likelihood the scores of every category sum to its labels; any other fit differs."""
    df = _cells(spark, sf)
    model = M.train_logistic(df, M.prep_stages([], CATEGORIES), max_iter=200, tol=1e-10)
    scored = M.win_probability(model.transform(df))
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in CATEGORIES])
    return scored.select("probability_1", F.explode(each).alias("c")).groupBy("c.feature", "c.value").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("probability_1"), 4).alias("mean_probability")
    )


@query(
    "tree_cells",
    with_runners("SELECT surface, count(*) AS n, round(avg(price), 4) AS lowest, round(avg(price), 4) AS highest FROM runners GROUP BY 1"),
)
def tree_cells(spark, sf):
    """Trees deep enough to part all categories predict the mean of each."""
    df = runners(spark, sf).withColumn("price", F.col("price").cast("double"))
    model = M.train_trees(df, M.prep_stages([], ["surface"]), label="price", regression=True, max_iter=2, max_depth=3)
    out = model.transform(df).groupBy("surface")
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("prediction"), 4).alias("lowest"), F.round(F.max("prediction"), 4).alias("highest")
    )


@query(
    "calibrate_steps",
    with_runners(
        f"""{_CELLS_SQL}, g AS (SELECT CAST(qty AS DOUBLE) AS score, sum(label) AS s, count(*) AS c FROM y GROUP BY 1),
        c AS (SELECT score, sum(s) OVER w AS cs, sum(c) OVER w AS cc, sum(s) OVER w - s AS bs, sum(c) OVER w - c AS bc FROM g WINDOW w AS (ORDER BY score)),
        ab AS (SELECT a.score AS lo, b.score AS hi, (b.cs - a.bs) / CAST(b.cc - a.bc AS DOUBLE) AS m FROM c a JOIN c b ON b.score >= a.score),
        low AS (SELECT x.score, ab.lo, min(m) AS m FROM c x JOIN ab ON ab.lo <= x.score AND ab.hi >= x.score GROUP BY 1, 2)
        SELECT score, round(max(m), 6) AS calibrated FROM low GROUP BY 1"""
    ),
)
def calibrate_steps(spark, sf):
    """Every step of the isotonic curve; the SQL is its definition: the largest of the least means around a score."""
    df = _cells(spark, sf).withColumn("score", F.col("qty").cast("double"))
    curve = M.calibrator_column(M.fit_calibrator(df, "score", "label"))
    return df.select("score").distinct().select("score", F.round(curve(F.col("score")), 6).alias("calibrated"))


@query("calibrate", with_runners(f"{_SPLIT_SQL} SELECT count(*) AS n, TRUE AS in_range, TRUE AS improved FROM test"))
def calibrate(spark, sf):
    train, test = _split(spark, sf)
    fit = train.filter(P.stable_unit(["race_id"], 3) < 0.7)
    held = train.filter(P.stable_unit(["race_id"], 3) >= 0.7)
    model = M.train_logistic(fit, M.prep_stages(NUMERIC, CATEGORIES))
    # a distorted score, so that there is something to repair
    bent = lambda df: M.win_probability(model.transform(df)).withColumn("bent", F.pow("probability_1", F.lit(2.0)))
    iso = M.fit_calibrator(bent(held), "bent", "label")
    scored = iso.transform(bent(test).withColumn("_x", F.col("bent")))
    return scored.agg(
        F.count(F.lit(1)).alias("n"), (F.min(F.col("calibrated").between(0, 1).cast("int")) == 1).alias("in_range"),
        (M.brier("calibrated", "label") < M.brier("bent", "label")).alias("improved"),
    )


@query(
    "eval_metrics",
    with_entries(
        """, s AS (SELECT (qty * 7 % 50) / 50.0::DOUBLE * 0.9::DOUBLE + 0.05::DOUBLE AS p, CASE WHEN surface = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM entries WHERE qty <> 7),
        k AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rs, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM s)
        SELECT count(*) AS n, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
          round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2,
          round((sum(rs) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc, round(corr(rs, ry), 6) AS spearman FROM k"""
    ),
)
def eval_metrics(spark, sf):
    df = entries(spark, sf).select(
        F.when(F.col("qty") != 7, (F.col("qty") * 7) % 50 / 50.0 * 0.9 + 0.05).alias("p"), (F.col("surface") == "A").cast("int").alias("y")
    )
    m = M.eval_metrics(df, "p", "y")
    return m.select("n", *[r(c) for c in m.columns if c != "n"])


@query(
    "score_races",
    with_entries(
        f""", s AS (SELECT *, CASE WHEN runner_no <> 4 THEN (qty - 25) / 10 END AS raw, CASE WHEN runner_no <> 5 AND race_id % 40 <> 0 THEN discount * 20 - 0.3::DOUBLE END AS cls FROM entries),
        a AS (SELECT *, coalesce(raw, min(raw) OVER w - 1, -5.0) AS safe, CASE WHEN cls < 0 THEN 0.0 WHEN cls > 1 THEN 1.0 ELSE cls END AS c FROM s WINDOW w AS (PARTITION BY race_id)),
        b AS (SELECT *, exp(safe - max(safe) OVER w) AS e, CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w ELSE c END AS p2 FROM a WINDOW w AS (PARTITION BY race_id))
        SELECT {ID_SQL}, round(e / sum(e) OVER w, 6) AS p_rank, CAST(rank() OVER (PARTITION BY race_id ORDER BY safe DESC) AS BIGINT) AS rank_rank, round(p2, 6) AS p_win,
          CAST(rank() OVER (PARTITION BY race_id ORDER BY c DESC NULLS LAST) AS BIGINT) AS rank_win FROM b WINDOW w AS (PARTITION BY race_id)"""
    ),
)
def score_races(spark, sf):
    df = entries(spark, sf).withColumns(
        {"raw": F.when(F.col("runner_no") != 4, (F.col("qty") - 25) / 10), "cls": F.when((F.col("runner_no") != 5) & (F.col("race_id") % 40 != 0), F.col("discount") * 20 - 0.3)}
    )
    df = M.score_races(df, "race_id", "raw", "rank", "p_rank", "rank_rank")
    df = M.score_races(df, "race_id", "cls", "win", "p_win", "rank_win")
    return df.select(*ID, r("p_rank"), "rank_rank", r("p_win"), "rank_win")


@query(
    "score_races_calibrated",
    with_entries(
        f""", s AS (SELECT *, CASE WHEN runner_no <> 5 THEN sqrt(discount + 0.0137::DOUBLE) * 4 - 0.45::DOUBLE END AS cls FROM entries),
        c AS (SELECT *, CASE WHEN cls < 0 THEN 0.0::DOUBLE WHEN cls > 1 THEN 1.0::DOUBLE ELSE cls END AS x FROM s),
        k AS (SELECT *, round(CASE WHEN x <= 0.1 THEN 0.0213::DOUBLE WHEN x <= 0.5 THEN 0.0213::DOUBLE + (x - 0.1) * (0.2916::DOUBLE / 0.4) WHEN x <= 0.8 THEN 0.3129::DOUBLE + (x - 0.5) * (0.4348::DOUBLE / 0.3) WHEN x IS NOT NULL THEN 0.7477::DOUBLE END, 9) AS p FROM c)
        SELECT {ID_SQL}, round(CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w ELSE p END, 6) AS p_win,
          CAST(rank() OVER (PARTITION BY race_id ORDER BY p DESC NULLS LAST) AS BIGINT) AS rank_win FROM k WINDOW w AS (PARTITION BY race_id)"""
    ),
)
def score_races_calibrated(spark, sf):
    df = entries(spark, sf).withColumn("cls", F.when(F.col("runner_no") != 5, F.sqrt(F.col("discount") + 0.0137) * 4 - 0.45))
    curve = M.piecewise([0.1, 0.5, 0.8], [0.0213, 0.3129, 0.7477])
    df = M.score_races(df, "race_id", "cls", "win", "p_win", "rank_win", calibrator=lambda p: F.round(curve(p), 9))
    return df.select(*ID, r("p_win"), "rank_win")


@query(
    "ensemble",
    with_entries(
        f""", s AS (SELECT *, sqrt(discount + 0.0137) AS m, CASE WHEN runner_no <> 6 THEN sqrt(tax + 0.0119) END AS p FROM entries),
        b AS (SELECT *, CASE WHEN count(*) OVER w = count(p) OVER w THEN 0.6 * m + 0.4 * p ELSE m END AS x, CASE WHEN count(*) OVER w = count(p) OVER w THEN 0.5 * m + 0.5 * p ELSE m END AS y FROM s WINDOW w AS (PARTITION BY race_id))
        SELECT {ID_SQL}, round(x / sum(x) OVER w, 6) AS p_win, round(y / sum(y) OVER w, 6) AS p_speed FROM b WINDOW w AS (PARTITION BY race_id)"""
    ),
)
def ensemble(spark, sf):
    df = entries(spark, sf).withColumns(
        {"m": F.sqrt(F.col("discount") + 0.0137), "p": F.when(F.col("runner_no") != 6, F.sqrt(F.col("tax") + 0.0119))}
    )
    df = M.ensemble(df, "race_id", "m", "p", out="p_win")
    df = M.ensemble(df, "race_id", "m", "p", target="speed_deviation", out="p_speed")
    return df.select(*ID, r("p_win"), r("p_speed"))
