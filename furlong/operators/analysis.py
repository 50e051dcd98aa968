"""What columns look like and how they relate to each other and to a label. Always all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators.joins import top_per_group
from furlong.operators.prep import number_rows
from furlong.operators.skew import column_quantiles, column_value_counts, quantiles, stored_ranges, tied_ranks, with_row
from furlong.session import shared_dir


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def column_profile(df: DataFrame, numeric: Sequence[str], text: Sequence[str], top: int = 3) -> DataFrame:
    """One row per column: null share and band, distinct values, quartiles or most frequent values.

    Everything derives from the counts per distinct value, which one pass produces.
    """
    n_rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    counts = stored_ranges(column_value_counts(df, numeric), ["column"])
    q = quantiles(counts, [0.0, 0.25, 0.5, 0.75, 1.0])
    num = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("known"))
    names = ["min", "q1", "median", "q3", "max"]
    num = num.join(q, "column").select(
        "column",
        "distinct",
        "known",
        *[F.round(F.get("q", F.lit(i)), 3).alias(x) for i, x in enumerate(names)],
        F.lit("").alias("top_values"),
    )
    words = _long(df, text, "string").filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = top_per_group(words, ["column"], [F.desc("n"), F.col("value")], top, "_rn").groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "value", "n"))).alias("_t")
    )
    txt = words.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("known")).join(best, "column")
    txt = txt.select(
        "column",
        "distinct",
        "known",
        *[F.lit(None).cast("double").alias(x) for x in names],
        F.array_join(F.transform("_t", lambda t: F.concat_ws(":", t["value"], t["n"])), " | ").alias("top_values"),
    )
    every = n_rows.select("_rows", F.explode(F.array(*[F.lit(c) for c in [*numeric, *text]])).alias("column"))
    pct = F.round((1 - F.coalesce("known", F.lit(0)) / F.col("_rows")) * 100, 1)
    band = (
        F.when(pct == 0, "0").when(pct <= 1, "0-1").when(pct <= 20, "1-20").when(pct <= 50, "20-50").otherwise(">50")
    )
    return every.join(num.unionByName(txt), "column", "left").select(
        "column",
        pct.alias("null_pct"),
        band.alias("null_band"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        *names,
        F.coalesce("top_values", F.lit("")).alias("top_values"),
    )


def outlier_rate(df: DataFrame, columns: Sequence[str], factor: float = 3.0, least: int = 10) -> DataFrame:
    """Share of values outside the quartiles by more than factor times their distance.

    Null below ``least`` known values, which tell nothing; 0 where the quartiles are equal.
    """
    counts = stored_ranges(column_value_counts(df, columns), ["column"])
    q = quantiles(counts, [0.25, 0.75]).select(
        "column", "total", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3")
    )
    gap = (F.col("q3") - F.col("q1")) * factor
    out = (F.col("value") < F.col("q1") - gap) | (F.col("value") > F.col("q3") + gap)
    return (
        counts.join(F.broadcast(q), "column")
        .groupBy("column")
        .agg(
            F.sum(F.when(out, F.col("n")).otherwise(0)).alias("_o"),
            F.max("total").alias("_n"),
            F.max(F.col("q3") - F.col("q1")).alias("_iqr"),
        )
        .select(
            "column",
            F.when(F.col("_n") < least, F.lit(None).cast("double"))
            .when(F.col("_iqr") == 0, F.lit(0.0))
            .otherwise(F.col("_o") / F.col("_n"))
            .alias("outlier_rate"),
        )
    )


def rank_correlations(long: DataFrame) -> DataFrame:
    """(feature, spearman) from rows (feature, x, y) without nulls; 0 where one side is constant.

    One pass for all features. Counts per distinct pair lie in stored ranges of (feature, x), where x is
    ranked; sums per y follow from them and are ranked by y in turn, so ranks are never joined back to
    the pairs. The plan is the same for any number of features.
    """
    # dealt by ranges of x before they are counted: the counts need no shuffle of their own
    joint = long.repartitionByRange("feature", "x").withColumn("_slice", F.spark_partition_id().cast("bigint"))
    path = shared_dir(long.sparkSession, "pairs")
    joint.groupBy("feature", "x", "y").agg(F.min("_slice").alias("_slice"), F.count(F.lit(1)).alias("n")).write.parquet(path)
    by_x = tied_ranks(long.sparkSession.read.parquet(path), ["feature"], "_rx", "x")
    n, rx, ry = F.col("n"), F.col("_rx"), F.col("_ry")
    sums = by_x.groupBy("feature", "y").agg(F.sum(n * rx).alias("a"), F.sum(n * rx * rx).alias("aa"), F.sum(n).alias("n"))
    by_y = tied_ranks(stored_ranges(sums, ["feature"], "y"), ["feature"], "_ry", "y")
    s = by_y.groupBy("feature").agg(
        F.sum(n).alias("n"),
        F.sum("a").alias("a"),
        F.sum(n * ry).alias("b"),
        F.sum(F.col("a") * ry).alias("ab"),
        F.sum("aa").alias("aa"),
        F.sum(n * ry * ry).alias("bb"),
    )
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    va = F.col("aa") - F.col("a") * F.col("a") / F.col("n")
    vb = F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    return s.select("feature", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(F.lit(0.0)).alias("spearman"))


def spearman_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, spearman): rank correlation with the label, missing values as the median."""
    medians = column_quantiles(df, features, [0.5]).select("column", F.get("q", F.lit(0)).alias("_m"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in features])
    long = df.select(F.col(target).cast("double").alias("y"), F.explode(pairs).alias("_p")).select("_p.column", "_p.x", "y")
    # one row for each feature
    filled = long.join(F.broadcast(medians), "column", "left").select(
        F.col("column").alias("feature"), F.coalesce("x", "_m").alias("x"), "y"
    )
    return rank_correlations(filled.filter(F.col("x").isNotNull() & F.col("y").isNotNull()))


def mutual_info(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mutual_info) in nats between the quantile bin of a feature and the label."""
    cuts = column_quantiles(df, features, [i / bins for i in range(1, bins)]).select("column", "q")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in features])
    joint = (
        df.select(F.col(target).alias("_y"), F.explode(pairs).alias("p"))
        .select("_y", "p.column", "p.value")
        .filter(F.col("value").isNotNull() & F.col("_y").isNotNull())
        .groupBy("column", "value", "_y")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(F.broadcast(cuts), "column")
        .withColumn("_bin", F.size(F.filter("q", lambda e: e < F.col("value"))))
        .groupBy("column", "_bin", "_y")
        .agg(F.sum("_n").cast("double").alias("_n"))
    )
    # at most bins * labels rows per feature from here on
    by_bin, by_y, whole = Window.partitionBy("column", "_bin"), Window.partitionBy("column", "_y"), Window.partitionBy("column")
    terms = joint.select(
        "column",
        "_n",
        F.sum("_n").over(by_bin).alias("_nb"),
        F.sum("_n").over(by_y).alias("_ny"),
        F.sum("_n").over(whole).alias("_nt"),
    )
    n, nt = F.col("_n"), F.col("_nt")
    return terms.groupBy(F.col("column").alias("feature")).agg(
        F.sum(n / nt * F.ln(n * nt / (F.col("_nb") * F.col("_ny")))).alias("mutual_info")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlations, missing values as 0. Only the k x k matrix comes to the driver."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(filled).select("_v")
    return Correlation.corr(vectors, "_v").head()[0].toArray()


def high_corr_pairs(df: DataFrame, columns: Sequence[str], least: float = 0.85) -> DataFrame:
    """(a, b, r) of the column pairs with |r| of at least ``least``."""
    m = correlation_matrix(df, columns)
    rows = [
        (columns[i], columns[j], round(float(m[i, j]), 4))
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
        if abs(m[i, j]) >= least
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def vif(df: DataFrame, columns: Sequence[str], most: float = 999.0) -> DataFrame:
    """(feature, vif): diagonal of the inverse correlation matrix, capped; constant columns are left out."""
    m = correlation_matrix(df, columns)
    varying = [i for i in range(len(columns)) if not np.isnan(np.delete(m[i], i)).all()] if len(columns) > 1 else [0]
    sub = m[np.ix_(varying, varying)]
    try:
        diag = np.diag(np.linalg.inv(sub))
    except np.linalg.LinAlgError:
        diag = np.diag(np.linalg.pinv(sub))
    rows = [(columns[i], float(min(d, most)) if d >= 1 else float(most)) for i, d in zip(varying, diag)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def shuffled_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """df with ``_dealt_<column>`` for each of the columns: its values, dealt out again by hash order.

    Rows and values are numbered in two different hash orders, slice by slice, and joined on the number, once for
    all columns: every value is used exactly once.
    """
    left = number_rows(df, F.xxhash64(F.lit(seed), *keys), "_no")
    right = number_rows(df.select(*dict.fromkeys([*columns, *keys])), F.xxhash64(F.lit(seed + 1), *keys), "_no")
    return left.join(right.select("_no", *[F.col(c).alias(f"_dealt_{c}") for c in columns]), "_no").drop("_no")


def shuffled_column(df: DataFrame, column: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """df with the values of one column dealt out again by hash order."""
    return with_dealt(shuffled_columns(df, [column], keys, seed), df.columns, column)


def with_dealt(dealt: DataFrame, columns: Sequence[str], column: str) -> DataFrame:
    """The columns of a frame of shuffled_columns, one of them with its dealt values."""
    return dealt.select(*[F.col(f"_dealt_{c}").alias(c) if c == column else c for c in columns])


def permutation_importance(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    target: str,
    prediction: str,
    keys: Sequence[str],
    seed: int = 42,
) -> DataFrame:
    """(feature, importance): how much the rank correlation of the prediction falls when a column is shuffled."""

    # rows are dealt once for all columns and written; the scorings go side by side as rows of one frame, the
    # untouched one under no name, and are written for the ranks, which pass over them twice
    dealt_path, scored_path, path = (shared_dir(df.sparkSession, p) for p in ("dealt", "scored", "importance"))
    shuffled_columns(df, features, keys, seed).write.parquet(dealt_path)
    dealt = df.sparkSession.read.parquet(dealt_path)
    for c in [None, *features]:
        rows = predict(dealt.select(*df.columns) if c is None else with_dealt(dealt, df.columns, c)).select(
            F.lit(c or "").alias("feature"), F.col(prediction).cast("double").alias("x"), F.col(target).cast("double").alias("y")
        )
        rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).write.mode("append").parquet(scored_path)
    rank_correlations(df.sparkSession.read.parquet(scored_path)).write.parquet(path)
    found = df.sparkSession.read.parquet(path)
    base = found.filter("feature = ''").select(F.col("spearman").alias("_base"))
    return with_row(found.filter("feature <> ''"), base).select("feature", (F.col("_base") - F.col("spearman")).alias("importance"))
