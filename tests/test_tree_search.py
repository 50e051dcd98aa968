"""Group folds over boosted trees, isotonic steps."""

import hashlib
import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from furlong.operators import model as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(360):
        a, b = rng.random(), rng.choice(["x", "y", None])
        data.append((i // 6, i, a, b, float(rng.random() < 0.2 + 0.6 * (a > 0.5))))
    return spark.createDataFrame(data, "race_id int, no int, a double, b string, label double").persist()


def test_folds_keep_races_together(rows):
    got = rows.select("race_id", M.fold_of(["race_id"], 4).alias("f")).distinct().collect()
    assert len(got) == 60
    for r in got:
        assert r["f"] == int(hashlib.md5(str(r["race_id"]).encode()).hexdigest()[:8], 16) % 4


def test_scores_come_from_models_that_have_not_seen_the_race(rows):
    stages = M.prep_stages(["a"], ["b"])
    search = M.TreeSearch(rows, stages, folds=3, depths=(1, 3), rounds=4)
    held = rows.withColumn("fold", M.fold_of(["race_id"], 3))
    for depth, rounds in ((1, 4), (3, 4), (3, 2)):
        got = {r["no"]: (r["fold"], r["oof"]) for r in search.out_of_fold(point=(depth, rounds)).collect()}
        assert len(got) == 360
        for k in range(3):
            model = M.train_trees(held.filter(F.col("fold") != k), stages, max_iter=rounds, max_depth=depth)
            for r in M.win_probability(model.transform(held.filter(F.col("fold") == k))).collect():
                assert got[r["no"]][0] == k
                assert got[r["no"]][1] == pytest.approx(r["probability_1"], abs=1e-9)
    losses = {}
    for r in search.losses().collect():
        losses.setdefault((r["depth"], r["rounds"]), []).append(r["loss"])
        assert r["n"] == held.filter(F.col("fold") == r["fold"]).count()
    assert sorted(losses) == [(d, k) for d in (1, 3) for k in (1, 2, 3, 4)]
    mean = {p: sum(v) / 3 for p, v in losses.items()}
    assert search.best() == min(mean, key=lambda p: (mean[p], p[1], p[0]))
    # the loss of a point is the log loss of its out-of-fold scores
    one = [r for r in search.out_of_fold(point=(3, 4)).filter("fold = 1").collect()]
    log = [-math.log(r["oof"] if r["label"] == 1 else 1 - r["oof"]) for r in one]
    assert sum(log) / len(log) == pytest.approx([r["loss"] for r in search.losses().filter("depth = 3 AND rounds = 4 AND fold = 1").collect()][0])


def test_regression_and_final_rounds(rows):
    df = rows.withColumn("label", F.col("a") * 3)
    search = M.TreeSearch(df, M.prep_stages(["a"], []), folds=2, depths=(2,), rounds=3, regression=True)
    depth, rounds = search.best()
    out = search.out_of_fold()
    assert out.agg(F.corr("oof", "label")).first()[0] > 0.8
    assert len(search.fit(df).stages[-1].trees) == rounds * 2


def test_isotonic_steps_against_pooling(spark):
    rng = random.Random(8)
    points = [(float(rng.randrange(12)), float(rng.random() < 0.5)) for _ in range(150)]
    df = spark.createDataFrame([*points, (None, 1.0)], "s double, label double")
    blocks = []
    for x in sorted({p[0] for p in points}):
        ys = [y for s, y in points if s == x]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    want = {x: s / n for s, n, xs in blocks for x in xs}
    curve = M.calibrator_column(M.fit_calibrator(df, "s", "label"))
    for r in df.filter("s IS NOT NULL").distinct().select("s", curve(F.col("s")).alias("c")).collect():
        assert r["c"] == pytest.approx(want[r["s"]])


def test_cross_validation_prepares_rows_once_for_all_points_of_a_fold(rows, monkeypatch):
    fits, fit = [], M.StringIndexer._fit
    monkeypatch.setattr(M.StringIndexer, "_fit", lambda self, df: fits.append(df.count()) or fit(self, df))
    stages = M.prep_stages(["a"], ["b"])
    found = M.cross_validate(rows, stages, folds=3, grid={"regParam": [0.0, 0.1, 5.0]})
    assert len(fits) == 4 and fits[3] == 360 and sum(fits[:3]) == 720  # the other folds of three, then all rows
    monkeypatch.undo()
    folded = rows.withColumn("_fold", F.floor(M.stable_unit(["race_id"]) * 3).cast("int"))
    lr = M.LogisticRegression(featuresCol=M.FEATURES, labelCol="label", maxIter=20)
    search = CrossValidator(
        estimator=Pipeline(stages=[*stages, lr]), estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1, 5.0]).build(),
        evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=3, foldCol="_fold",
    )
    want = search.fit(folded)
    assert found.avgMetrics == pytest.approx(want.avgMetrics, abs=1e-9) and found.stdMetrics == pytest.approx(want.stdMetrics, abs=1e-9)
    assert found.bestModel.stages[-1].coefficients.toArray() == pytest.approx(want.bestModel.stages[-1].coefficients.toArray(), abs=1e-6)


def test_running_margins_pass_rows_through_all_trees_at_once(rows):
    stages = M.prep_stages(["a"], ["b"])
    model = M.train_trees(rows, stages, max_iter=3, max_depth=3)
    ready = Pipeline(stages=stages).fit(rows).transform(rows)
    plan = M.running_margins(model.stages[-1], ready, "m").select("no", "m")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("UDF(features") == 1
    scored = model.transform(rows).select("no", M.vector_to_array("rawPrediction")[1].alias("raw"))
    for r in plan.join(scored, "no").collect():
        assert len(r["m"]) == 3 and 2 * r["m"][2] == pytest.approx(2 * r["raw"], abs=1e-12)
