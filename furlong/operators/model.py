"""Training, calibration, scoring and evaluation with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators.prep import stable_unit
from furlong.operators.skew import HOT_ROWS, column_quantiles, join_group_stats, ranked, value_ranks, with_row
from furlong.operators.within_group import normalise
from furlong.session import shared_dir

FEATURES = "features"


def fill_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing categories become the most frequent one; a tie goes to the first in the alphabet."""
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        mode = counts.agg(F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c))).alias("_mode"))  # one row
        df = with_row(df, mode).withColumn(c, F.coalesce(F.col(c), F.col("_mode"))).drop("_mode")
    return df


class FillMissing(Estimator, HasInputCols, HasOutputCols):
    """Learns what stands for missing values: the exact median of a number, the most frequent category of a
    text (a tie goes to the first in the alphabet). The fitted stage fills any frame with the learned values.

    Only one value per column reaches the driver.
    """

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], suffix: str = "_filled"):
        super().__init__()
        self.numeric, self.categorical = list(numeric), list(categorical)
        inputs = [*self.numeric, *self.categorical]
        self._set(inputCols=inputs, outputCols=[f"{c}{suffix}" for c in inputs])

    def _fit(self, df: DataFrame) -> SQLTransformer:
        known = {}
        if self.numeric:
            known |= {r["column"]: r["q"][0] for r in column_quantiles(df, self.numeric, [0.5]).collect()}
        for c in self.categorical:
            counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            known[c] = counts.agg(F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c)))).first()[0]
        filled = []
        for c, out in zip(self.getInputCols(), self.getOutputCols()):
            value = known.get(c)
            if value is None:  # nothing to learn from
                filled.append(f"`{c}` AS `{out}`")
            elif c in self.numeric:
                filled.append(f"coalesce(CAST(`{c}` AS DOUBLE), {value!r}D) AS `{out}`")
            else:
                text = value.replace("\\", "\\\\").replace("'", "\\'")
                filled.append(f"coalesce(`{c}`, '{text}') AS `{out}`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def prep_pipeline(numeric: Sequence[str], categorical: Sequence[str], out: str = FEATURES) -> list:
    """Fitted medians and modes, then one-hot categories and one vector; unseen categories get a slot of their own."""
    fill = FillMissing(numeric, categorical)
    names = fill.getOutputCols()
    numbers, texts = names[: len(numeric)], names[len(numeric) :]
    index, coded = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
    encode = [
        StringIndexer(inputCols=texts, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=coded, handleInvalid="keep"),
    ]
    vector = VectorAssembler(inputCols=[*numbers, *coded], outputCol=out, handleInvalid="keep")
    return [fill, *(encode if texts else []), vector]


def prep_stages(numeric: Sequence[str], categorical: Sequence[str], out: str = FEATURES) -> list:
    """Median-imputed numbers and one-hot categories in one vector; unseen categories get a slot of their own."""
    stages = []
    filled = [f"{c}_filled" for c in numeric]
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=list(numeric), outputCols=filled))
    coded = [f"{c}_hot" for c in categorical]
    if categorical:
        index = [f"{c}_index" for c in categorical]
        stages.append(
            StringIndexer(
                inputCols=list(categorical), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"
            )
        )
        stages.append(OneHotEncoder(inputCols=index, outputCols=coded, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=filled + coded, outputCol=out, handleInvalid="keep"))
    return stages


def _needed(df: DataFrame, stages: Sequence, extra: Sequence[str]) -> DataFrame:
    """The columns that the stages read and the ones named, once: fitting passes over them several times."""
    made, read = set(), []
    for s in stages:
        for name in ("inputCols", "inputCol"):
            if s.hasParam(name) and s.isDefined(s.getParam(name)):
                v = s.getOrDefault(s.getParam(name))
                read += [c for c in ([v] if isinstance(v, str) else v) if c not in made]
        for name in ("outputCols", "outputCol"):
            if s.hasParam(name) and s.isSet(s.getParam(name)):
                v = s.getOrDefault(s.getParam(name))
                made.update([v] if isinstance(v, str) else v)
    return df.select(*dict.fromkeys([*read, *[c for c in extra if c]]))


def _fit(estimator, df: DataFrame, stages: Sequence, extra: Sequence[str]):
    data = _needed(df, stages, extra).persist()
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


def train_logistic(
    df: DataFrame, stages: Sequence, label: str = "label", weight: str | None = None, max_iter: int = 20, tol: float = 1e-6
) -> PipelineModel:
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=label, maxIter=max_iter, tol=tol)
    if weight:
        lr = lr.setWeightCol(weight)
    return _fit(Pipeline(stages=[*stages, lr]), df, stages, [label, weight])


def train_trees(
    df: DataFrame,
    stages: Sequence,
    label: str = "label",
    regression: bool = False,
    weight: str | None = None,
    validation: str | None = None,
    max_iter: int = 20,
    max_depth: int = 4,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees; rows marked in the boolean column ``validation`` decide when to stop."""
    kind = GBTRegressor if regression else GBTClassifier
    gbt = kind(featuresCol=FEATURES, labelCol=label, maxIter=max_iter, maxDepth=max_depth, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return _fit(Pipeline(stages=[*stages, gbt]), df, stages, [label, weight, validation])


def win_probability(scored: DataFrame, out: str = "probability_1") -> DataFrame:
    return scored.withColumn(out, vector_to_array("probability")[1])


def cross_validate(
    df: DataFrame,
    stages: Sequence,
    race: str = "race_id",
    label: str = "label",
    folds: int = 3,
    grid: Mapping[str, Sequence] | None = None,
    parallelism: int = 4,
    max_iter: int = 20,
) -> CrossValidatorModel:
    """Grid search by cross validation; all runners of a race fall into the same fold."""
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=label, maxIter=max_iter)
    builder = ParamGridBuilder()
    for name, values in (grid or {"regParam": [0.0, 0.1]}).items():
        builder = builder.addGrid(lr.getParam(name), list(values))
    points = builder.build()
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    folded = df.withColumn("_fold", F.floor(stable_unit([race]) * folds).cast("int"))
    rows = _in_folds(_needed(folded, stages, [label, "_fold"]), "_fold")
    areas = []
    for k in range(folds):
        # what prepares the rows is fitted once for all points of the fold, and its vectors are written once
        prep = Pipeline(stages=list(stages)).fit(rows.filter(F.col("_fold") != k))
        ready = _in_folds(prep.transform(rows).select(FEATURES, label, "_fold"), "_fold")
        rest, held = ready.filter(F.col("_fold") != k), ready.filter(F.col("_fold") == k)
        with ThreadPool(min(parallelism, len(points))) as pool:
            score = inheritable_thread_target(df.sparkSession)(lambda at: evaluator.evaluate(lr.fit(rest, at).transform(held)))
            areas.append(pool.map(score, points, chunksize=1))
    mean = [sum(x) / folds for x in zip(*areas)]
    spread = [(sum((a - m) ** 2 for a in x) / folds) ** 0.5 for x, m in zip(zip(*areas), mean)]
    best = Pipeline(stages=[*stages, lr.copy(points[mean.index(max(mean))])]).fit(rows.drop("_fold"))
    return CrossValidatorModel(best, mean, stdMetrics=spread)


def _in_folds(df: DataFrame, fold: str) -> DataFrame:
    """The rows, written with a folder for each fold, so that a fit on the other folds reads those alone."""
    path = shared_dir(df.sparkSession, "folds")
    df.write.partitionBy(fold).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def out_of_fold(df: DataFrame, stages: Sequence, race: str, label: str = "label", folds: int = 3) -> DataFrame:
    """Probability of each row from a model that has not seen its race."""
    folded = df.withColumn("_fold", F.floor(stable_unit([race]) * folds).cast("int"))
    out = None
    for k in range(folds):
        model = train_logistic(folded.filter(F.col("_fold") != k), stages, label)
        part = win_probability(model.transform(folded.filter(F.col("_fold") == k)), "oof").select(
            *df.columns, "oof"
        )
        out = part if out is None else out.unionByName(part)
    return out


def fold_of(keys: Sequence[str], folds: int) -> Column:
    """Fold 0..folds-1 from the MD5 of the keys, joined by |: the same in any engine, and whole groups stay together."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def leaf_values(tree) -> list[float]:
    """Predictions of a tree's leaves from left to right, the order in which Spark numbers them."""
    out, left_to_do = [], [tree._call_java("rootNode")]
    while left_to_do:
        node = left_to_do.pop()
        if node.numDescendants() == 0:
            out.append(node.prediction())
        else:
            left_to_do += [node.rightChild(), node.leftChild()]
    return out


def running_margins(model, scored: DataFrame, out: str) -> DataFrame:
    """Add the array of a boosted model's raw scores after its first tree, its first two trees, and so on.

    The rows pass through all trees at once for the numbers of their leaves.
    """
    columns = scored.columns
    leaves = model.copy().setLeafCol("_leaves").transform(scored).select(*columns, vector_to_array("_leaves").alias("_leaves"))
    sums, total = [], F.lit(0.0)
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
        values = F.array(*[F.lit(v * float(weight)) for v in leaf_values(tree)])
        total = total + F.get(values, F.get("_leaves", F.lit(i)).cast("int"))
        sums.append(total)
    return leaves.withColumn(out, F.array(*sums)).drop("_leaves")


class TreeSearch:
    """Group folds over boosted trees with a grid of depths; the number of rounds comes from the same fits.

    Each (fold, depth) is fitted once, for ``rounds`` rounds, on the other folds, its preparation stages too. The held
    fold gets the scores after every round, and all of them are written once: losses of every (depth, rounds) and the
    out-of-fold scores of the best one are read from that table, with no further fit. Rows of one race
    are in one fold. A fold whose complement lacks rows raises, as there is nothing to fit.

    losses: (depth, rounds, fold, n, loss), the log loss, or the squared error of a regression.
    """

    def __init__(
        self, df: DataFrame, stages: Sequence, race: str = "race_id", label: str = "label", folds: int = 5,
        depths: Sequence[int] = (3, 5), rounds: int = 20, regression: bool = False, seed: int = 42,
    ):
        self.stages, self.label, self.folds, self.regression, self.seed = list(stages), label, folds, regression, seed
        path = shared_dir(df.sparkSession, "folds")
        # df is read once; its rows lie in a folder for each fold, which later passes read instead of a cache of their own
        folded = _in_folds(df.withColumn("fold", fold_of([race], folds)), "fold")
        for k in range(folds):
            rest = _needed(folded.filter(F.col("fold") != k), stages, [label])
            prep = Pipeline(stages=self.stages).fit(rest)
            ready = prep.transform(rest).select(FEATURES, label).persist()
            try:
                scored = prep.transform(folded.filter(F.col("fold") == k))
                made = []
                for d in depths:
                    kind = GBTRegressor if regression else GBTClassifier
                    gbt = kind(featuresCol=FEATURES, labelCol=label, maxIter=rounds, maxDepth=d, seed=seed)
                    scored = running_margins(gbt.fit(ready), scored, f"_m{d}")
                    made.append(F.struct(F.lit(d).alias("depth"), F.col(f"_m{d}").alias("margins")))
                scored.select(*df.columns, "fold", F.array(*made).alias("_points")).write.mode("append").parquet(path)
            finally:
                ready.unpersist()
        self.columns = df.columns
        self.table = df.sparkSession.read.parquet(path)

    def score(self, margin: Column) -> Column:
        return margin if self.regression else 1 / (1 + F.exp(-2 * margin))

    def losses(self) -> DataFrame:
        y = F.col(self.label).cast("double")
        points = self.table.select("fold", y.alias("_y"), F.explode("_points").alias("p")).select(
            "fold", "_y", F.col("p.depth").alias("depth"), F.posexplode("p.margins").alias("at", "margin")
        )
        if self.regression:
            loss = (F.col("margin") - F.col("_y")) * (F.col("margin") - F.col("_y"))
        else:
            loss = F.ln(1 + F.exp(-2 * (2 * F.col("_y") - 1) * F.col("margin")))
        return points.groupBy("depth", (F.col("at") + 1).alias("rounds"), "fold").agg(
            F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss")
        )

    def best(self) -> tuple[int, int]:
        """(depth, rounds) with the least mean loss over the folds; ties go to fewer rounds, then less depth."""
        mean = self.losses().groupBy("depth", "rounds").agg(F.avg("loss").alias("loss"))
        top = mean.agg(F.min(F.struct("loss", "rounds", "depth")).alias("b")).first()["b"]
        return top["depth"], top["rounds"]

    def out_of_fold(self, out: str = "oof", point: tuple[int, int] | None = None) -> DataFrame:
        """The rows with their fold and the score of a model that has not seen their race."""
        depth, rounds = point or self.best()
        of_depth = F.filter("_points", lambda p: p["depth"] == depth)[0]["margins"]
        return self.table.select(*self.columns, "fold", self.score(F.get(of_depth, F.lit(rounds - 1))).alias(out))

    def fit(self, df: DataFrame, point: tuple[int, int] | None = None) -> PipelineModel:
        """The model on all rows, with rounds scaled up by folds / (folds - 1) as it learns from more of them."""
        depth, rounds = point or self.best()
        return train_trees(
            df, self.stages, self.label, self.regression, max_iter=int(rounds * self.folds / (self.folds - 1)),
            max_depth=depth, seed=self.seed,
        )


def ev_weights(
    scored: DataFrame, probability: str = "oof", odds: str = "odds", center: float = 0.0, tau: float = 0.5, out: str = "weight"
) -> DataFrame:
    """Row weight sigmoid((p * odds - 1 - center) / tau) + 1, scaled to mean 1."""
    ev = F.col(probability) * F.coalesce(F.col(odds), F.lit(1.0)) - 1
    raw = scored.withColumn("_w", 1 / (1 + F.exp(-(ev - center) / tau)) + 1)
    mean = raw.agg(F.avg("_w").alias("_mean"))  # one row
    return with_row(raw, mean).withColumn(out, F.col("_w") / F.col("_mean")).drop("_w", "_mean")


def fit_calibrator(df: DataFrame, score: str, label: str):
    """Isotonic fit on a validation fold, on the mean label of each distinct score; null scores are left out."""
    points = (
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("_x"))
        .agg(F.avg(label).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    )
    return IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(points)


def calibrator_column(model) -> Callable[[Column], Column]:
    """A fitted isotonic model as a column function: straight lines between its points, flat outside."""
    return piecewise(list(model.boundaries), list(model.predictions))


def piecewise(xs: Sequence[float], ys: Sequence[float]) -> Callable[[Column], Column]:
    points = [(float(x), float(y)) for x, y in zip(xs, ys)]

    def apply(p: Column) -> Column:
        out = F.when(p <= points[0][0], F.lit(points[0][1]))
        for (x0, y0), (x1, y1) in zip(points, points[1:]):
            out = out.when(p <= x1, y0 + (p - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(y1))
        return out.otherwise(F.lit(points[-1][1]))

    return apply


def brier(p: str, label: str) -> Column:
    return F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label)))


def eval_metrics(df: DataFrame, score: str, label: str, eps: float = 1e-15) -> DataFrame:
    """One row: AUC, log loss, Brier, RMSE, MAE, R2 and Spearman of a score against a label.

    AUC and Spearman come from average ranks over the whole table, which are taken on
    the counts per distinct value. Rows without a score or a label count in none of them, nor in n.
    """
    df = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    p = F.greatest(F.least(F.col(score), F.lit(1 - eps)), F.lit(eps))
    y = F.col(label).cast("double")
    err = F.col(score) - y
    simple = df.agg(
        F.count(F.lit(1)).alias("n"),
        (-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg(err * err).alias("brier"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.sum(err * err) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
    )
    pairs = df.select(F.col(score).cast("double").alias("_s"), y.alias("_y")).groupBy("_s", "_y").agg(
        F.count(F.lit(1)).alias("_n")
    )
    rows = df.select(F.col(score).cast("double").alias("_s"), y.alias("_y"))
    s_rank, y_rank = value_ranks(rows, "_s", "_rs"), value_ranks(rows, "_y", "_ry")
    placed = pairs.join(s_rank, "_s").join(y_rank, "_y")
    pos = F.sum(F.when(F.col("_y") == 1, F.col("_n"))).alias("pos")
    n = F.col("_n")
    sums = placed.agg(
        pos,
        F.sum(n).alias("all"),
        F.sum(F.when(F.col("_y") == 1, n * F.col("_rs"))).alias("rpos"),
        F.sum(n * F.col("_rs")).alias("a"),
        F.sum(n * F.col("_ry")).alias("b"),
        F.sum(n * F.col("_rs") * F.col("_ry")).alias("ab"),
        F.sum(n * F.col("_rs") * F.col("_rs")).alias("aa"),
        F.sum(n * F.col("_ry") * F.col("_ry")).alias("bb"),
    )
    neg = F.col("all") - F.col("pos")
    auc = (F.col("rpos") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("all")
    var_a = F.col("aa") - F.col("a") * F.col("a") / F.col("all")
    var_b = F.col("bb") - F.col("b") * F.col("b") / F.col("all")
    return with_row(simple, sums.select(auc.alias("auc"), (cov / F.sqrt(var_a * var_b)).alias("spearman")))


def score_races(
    df: DataFrame, race: str, raw: str, target: str, out: str = "p_norm", rank: str = "predicted_rank", hot_rows: int | None = HOT_ROWS,
    calibrator: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Raw scores to probabilities that sum to 1 per race, and the rank they give.

    Regression and ranking scores go through softmax, where a missing score counts as
    one below the lowest of the race; classes are clipped to 0..1, calibrated if a calibrator is
    given (see calibrator_column), and a missing one has no probability and the last rank.

    With hot_rows=None it works in plain windows over the race: the caller knows that no race is hot or missing.
    """
    together = Window.partitionBy(race)
    if target in ("speed_deviation", "rank"):
        if hot_rows is None:
            low, high = F.min(raw).over(together), F.max(raw).over(together)
            power = F.exp(F.coalesce(F.col(raw), low - 1, F.lit(-5.0)) - F.coalesce(high, F.lit(-5.0)))
            return _shared_out(_placed(df, race, raw, rank).withColumn("_e", power), race, "_e", out).drop("_e")
        # softmax keeps the order, so the rank is that of the raw score
        placed = ranked(df, [race], raw, rank, descending=True, hot_rows=hot_rows)
        ends = join_group_stats(placed, [race], {"_low": F.min(raw), "_high": F.max(raw)}, df)
        safe = F.coalesce(F.col(raw), F.col("_low") - 1, F.lit(-5.0))
        powers = ends.withColumn("_e", F.exp(safe - F.coalesce(F.col("_high"), F.lit(-5.0))))
        totals = join_group_stats(df, [race], {"_low": F.min(raw), "_high": F.max(raw)}).withColumn(
            "_e", F.exp(safe - F.coalesce(F.col("_high"), F.lit(-5.0)))
        )
        return normalise(powers, [race], "_e", out, source=totals).drop("_low", "_high", "_e")
    clipped = df.withColumn("_p", F.when(F.col(raw).isNotNull(), F.greatest(F.least(F.col(raw), F.lit(1.0)), F.lit(0.0))))
    if calibrator:
        clipped = clipped.withColumn("_p", F.when(F.col("_p").isNotNull(), calibrator(F.col("_p"))))
    if hot_rows is None:
        return _shared_out(_placed(clipped, race, "_p", rank), race, "_p", out).drop("_p")
    placed = ranked(clipped, [race], "_p", rank, descending=True, hot_rows=hot_rows)
    return normalise(placed, [race], "_p", out, source=clipped).drop("_p")


def _placed(df: DataFrame, race: str, value: str, rank: str) -> DataFrame:
    """Rank in the race, the highest value first and missing ones last, in a plain window."""
    order = Window.partitionBy(race).orderBy(F.desc_nulls_last(value))
    return df.withColumn(rank, F.rank().over(order).cast("bigint"))


def _shared_out(df: DataFrame, race: str, value: str, out: str) -> DataFrame:
    """normalise() in a plain window."""
    total = F.sum(value).over(Window.partitionBy(race))
    return df.withColumn(out, F.when(total > 0, F.col(value) / total).otherwise(F.col(value)))


def ensemble(
    df: DataFrame, race: str, main: str, place: str, target: str = "win", out: str = "p_ensemble", hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Blend of two normalised scores, 0.6 / 0.4 or for speed 0.5 / 0.5; the main score alone where the other is missing in the race.

    With hot_rows=None it works in plain windows, as score_races does.
    """
    w = 0.5 if target == "speed_deviation" else 0.6
    missing = F.sum(F.col(place).isNull().cast("int"))
    if hot_rows is None:
        s = df.withColumn("_gaps", missing.over(Window.partitionBy(race)))
    else:
        s = join_group_stats(df, [race], {"_gaps": missing})
    blend = F.when(F.col("_gaps") == 0, w * F.col(main) + (1 - w) * F.col(place)).otherwise(F.col(main))
    if hot_rows is None:
        return _shared_out(s.withColumn("_b", blend), race, "_b", out).drop("_b", "_gaps")
    return normalise(s.withColumn("_b", blend), [race], "_b", out).drop("_b", "_gaps")
