"""Splitting of hot groups.

A window sends each group to one task. Where one key may hold a large share of
the table that task never ends, so the ordered operators cut the groups with
more than ``hot_rows`` rows into slices of their order, work slice by slice and
add what the earlier slices of the same group contribute (the carry). Groups
below the limit keep slice 0 and cost one plain window.

The choice of hot groups only decides how work is split, never a result: the
list is bounded (``MAX_HOT``), groups beyond it hold at most 1/MAX_HOT of the
rows each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.session import shared_dir

HOT_ROWS = 2_000_000
MAX_HOT = 10_000
NULL_SLICES = 1024
EDGES = 255


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than hot_rows rows, at most MAX_HOT of them, the largest first."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"), *keys)
        .limit(MAX_HOT)
        .select(*keys, F.lit(True).alias("_hot"))
    )


def slice_hot(
    df: DataFrame,
    keys: Sequence[str],
    slice_expr: Column,
    spread: Sequence[str],
    hot_rows: int = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add ``_hot`` and ``_slice``.

    slice_expr must be a bigint that never decreases along the order used later.
    Rows without a key have no group; they are spread by hash over NULL_SLICES.

    source, here and below, is a frame with the same rows and a shorter plan. Operators
    read their input more than once; in a chain of operators every one should count on
    the frame before the chain, or the plan grows with each link.
    """
    hot = hot_keys(df if source is None else source, keys, hot_rows)
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_hot", F.coalesce(F.col("_hot"), F.lit(False)))
        .withColumn(
            "_slice",
            F.when(keyless, -1 - F.pmod(F.xxhash64(*spread), F.lit(NULL_SLICES)))
            .when(F.col("_hot"), slice_expr.cast("bigint"))
            .otherwise(F.lit(0).cast("bigint")),
        )
    )


def slice_carry(sliced: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Per slice of a hot group, the totals of its earlier slices."""
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = sliced.filter("_hot").groupBy(*keys, "_slice").agg(*[c.alias(n) for n, c in totals.items()])
    return per_slice.select(*keys, "_slice", *[F.sum(n).over(before).alias(n) for n in totals])


def _search(edges: str, value: Column, equal: bool) -> Column:
    """How many of the at most EDGES sorted edges are below the value (or equal to it)."""
    steps = F.array(*[F.lit((EDGES + 1) >> k) for k in range(1, (EDGES + 1).bit_length())])

    def narrowed(at: Column, step: Column) -> Column:
        edge = F.get(edges, at + step - 1)
        return F.when(edge <= value if equal else edge < value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), narrowed)


def slice_by_value(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    descending: bool = False,
    split_equal: bool = False,
    hot_rows: int = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add ``_hot``, ``_slice`` and ``_first``: the ranges of a numeric value in hot groups, missing values last.

    The edges are values of the group's own rows, drawn by the hash of the row, so ranges hold about as
    many rows each, wherever the values lie and however they are spread. A value that was drawn m times
    over holds about m ranges' worth of rows; with split_equal these are dealt out to m slices of the
    same order, and ``_first`` names the first of them. Without it equal values share a slice.
    """
    base = df if source is None else source
    hot = hot_keys(base, keys, hot_rows)
    row = F.xxhash64(*[f.name for f in base.schema.fields if "map<" not in f.dataType.simpleString()])
    drawn = Window.partitionBy(*keys).orderBy(F.col("_v").isNull(), "_h", "_v")
    # at most MAX_HOT rows of EDGES numbers: 20 MB
    listed = (
        base.join(F.broadcast(hot), list(keys))
        .select(*keys, "_hot", F.col(value).cast("double").alias("_v"), row.alias("_h"))
        .withColumn("_no", F.row_number().over(drawn))
        .filter(F.col("_no") <= EDGES)
        .groupBy(*keys, "_hot")
        .agg(F.array_sort(F.collect_list("_v")).alias("_edges"))
    )
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    v = F.col(value).cast("double")
    below, upto, last = F.col("_below"), F.col("_upto"), F.lit(2 * EDGES + 2)
    heavy = F.lit(split_equal) & (upto - below >= 2)
    deal = F.monotonically_increasing_id()  # which of equal rows goes where changes no result
    ordinary = -2 * upto if descending else 2 * upto
    first = F.when(v.isNull(), last).when(heavy, 1 - 2 * upto if descending else 2 * below + 1).otherwise(ordinary)
    spread = F.when(v.isNull(), F.pmod(deal, F.lit(EDGES)) if split_equal else F.lit(0)).when(heavy, 2 * F.pmod(deal, upto - below))
    alone = -1 - F.pmod(F.xxhash64(*keys, value), F.lit(NULL_SLICES))
    return (
        df.join(F.broadcast(listed), list(keys), "left")
        .withColumn("_hot", F.coalesce(F.col("_hot"), F.lit(False)))
        .withColumn("_below", F.when(F.col("_hot") & F.lit(split_equal), _search("_edges", v, False)))
        .withColumn("_upto", F.when(F.col("_hot"), _search("_edges", v, True)))
        .drop("_edges")
        .withColumn("_first", F.when(keyless, alone).when(F.col("_hot"), first).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("_slice", F.col("_first") + F.when(F.col("_hot") & ~keyless, F.coalesce(spread, F.lit(0))).otherwise(F.lit(0)))
        .drop("_below", "_upto")
    )


def value_carry(sliced: DataFrame, keys: Sequence[str], total: Column, out: str) -> DataFrame:
    """Per range of a hot group (keys..., _first), the total of its earlier ranges."""
    before = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    per_range = sliced.filter("_hot").groupBy(*keys, "_first").agg(total.alias("_t"))
    return per_range.select(*keys, "_first", F.sum("_t").over(before).alias(out))


def join_group_stats(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], source: DataFrame | None = None
) -> DataFrame:
    """Attach statistics of the group to each of its rows.

    Written as aggregate and join rather than as a window: the aggregate combines on
    the map side and the join is one that adaptive execution can split on a hot key.
    Missing keys form a group of their own.
    """
    names = [f"_g_{k}" for k in keys]
    grouped = (df if source is None else source).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        *[c.alias(n) for n, c in stats.items()]
    )
    cond = F.lit(True)
    for k, n in zip(keys, names):
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    return df.join(grouped, cond, "left").drop(*names)


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    descending: bool = False,
    ties: Sequence[Column] = (),
    method: str = "min",
    hot_rows: int = HOT_ROWS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Rank by value inside each group, missing values last.

    method "min" gives the SQL rank, "first" numbers rows by value and then ties.
    """
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    how = (keys, value, descending, method == "min", hot_rows, source)
    sliced = slice_by_value(df, *how)
    base = sliced if source is None else slice_by_value(source, *how)
    w = Window.partitionBy(*keys, "_slice").orderBy(order, *ties)
    fn = F.rank() if method == "min" else F.row_number()
    local = sliced.withColumn("_local", fn.over(w))
    carry = value_carry(base, keys, F.count(F.lit(1)), "_before")
    return (
        local.join(carry, [*keys, "_first"], "left")
        .withColumn(out, (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint"))
        .drop("_local", "_before", "_slice", "_first", "_hot")
    )


def stored_ranges(counts: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Counts per distinct value, written once in ranges of (keys, value): column ``_slice`` is the range.

    Spark draws the edges from the counts themselves, so ranges are even wherever the values lie. The
    numbers must be the same for all that reads them, hence the written table.
    """
    path = shared_dir(counts.sparkSession, "ranges")
    ranged = counts.repartitionByRange(*keys, value).withColumn("_slice", F.spark_partition_id().cast("bigint"))
    ranged.write.parquet(path)
    return counts.sparkSession.read.parquet(path)


def running_counts(ranges: DataFrame, keys: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """ranges with ``_below``, the rows of the group with a smaller value, and ``_total``, all its rows.

    Each range adds up for itself; one row per group and range goes through the ordered pass.
    """
    per_range = ranges.groupBy(*keys, "_slice").agg(F.sum(n).alias("_s"))
    ordered = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_range.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_s").over(ordered), F.lit(0)).alias("_before"),
        F.sum("_s").over(Window.partitionBy(*keys)).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn("_lower", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(carry, [*keys, "_slice"])
        .withColumn("_below", F.col("_before") + F.col("_lower"))
        .drop("_lower", "_before")
    )


def mean_ranks(ranges: DataFrame, keys: Sequence[str], out: str, value: str = "value", n: str = "n") -> DataFrame:
    """(keys..., value, out): the average rank of each value in its group."""
    placed = running_counts(ranges, keys, value, n)
    return placed.select(*keys, value, (F.col("_below") + (F.col(n) + 1) / 2.0).alias(out))


def tied_ranks(ranges: DataFrame, keys: Sequence[str], out: str, value: str = "value", n: str = "n") -> DataFrame:
    """ranges with the average rank of each row's value in its group. A value may have several rows, all in one range.

    Unlike mean_ranks() no join back is needed by frames with more columns than the value.
    """
    per_range = ranges.groupBy(*keys, "_slice").agg(F.sum(n).alias("_s"))
    ordered = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_range.select(*keys, "_slice", F.coalesce(F.sum("_s").over(ordered), F.lit(0)).alias("_before"))
    upto = F.sum(n).over(Window.partitionBy(*keys, "_slice").orderBy(value))
    own = F.sum(n).over(Window.partitionBy(*keys, "_slice", value))
    placed = ranges.select("*", upto.alias("_upto"), own.alias("_own")).join(carry, [*keys, "_slice"])
    rank = F.col("_before") + F.col("_upto") - F.col("_own") + (F.col("_own") + 1) / 2.0
    return placed.withColumn(out, rank).drop("_upto", "_own", "_before", "_slice")


def value_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of each distinct value over the whole table: (value, out)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return mean_ranks(stored_ranges(counts, [], value), [], out, value, "_n")


def text_slices(df: DataFrame, column: str, out: str, slices: int = 1024) -> DataFrame:
    """Add the number of the range a text falls into; the ranges hold about as many rows each.

    df has one row per text. The edges are the slices - 1 texts of least hash, a fair choice that
    comes out the same on every run, whatever prefixes the texts share. slices is a power of two.
    """
    edges = (
        df.select(column).orderBy(F.xxhash64(column), column).limit(slices - 1)
        .agg(F.sort_array(F.collect_list(column)).alias("_edges"))
    )
    steps = F.array(*[F.lit(slices >> k) for k in range(1, slices.bit_length())])

    def narrowed(at: Column, step: Column) -> Column:
        return F.when(F.get("_edges", at + step - 1) <= F.col(column), at + step).otherwise(at)

    return with_row(df, edges).withColumn(out, F.aggregate(steps, F.lit(0), narrowed)).drop("_edges")


def column_value_counts(df: DataFrame, columns: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Rows per (column, value) of several numeric columns in one pass: (also..., column, value, n).

    Missing values are left out.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(*also, F.explode(pairs).alias("_p"))
        .select(*also, "_p.column", "_p.value")
        .filter(F.col("value").isNotNull())
        .groupBy(*also, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(counts: DataFrame, probabilities: Sequence[float], keys: Sequence[str] = ("column",)) -> DataFrame:
    """Exact quantiles with linear interpolation of each group of value counts.

    counts has (keys..., value, n); the result is one row per group with ``total`` and
    ``q``, an array in the order of the probabilities. Every value learns how many rows
    lie below it, range by range, and a quantile is then a conditional maximum, so no
    task sees a whole column. Counts that are used again should come from stored_ranges().
    """
    keys = list(keys)
    placed = running_counts(counts if "_slice" in counts.columns else stored_ranges(counts, keys), keys)
    low, high = [], []
    for i, p in enumerate(probabilities):
        pos = F.lit(p) * (F.col("_total") - 1)
        low.append(F.max(F.when(F.col("_below") <= F.floor(pos), F.col("value"))).alias(f"_lo{i}"))
        high.append(F.max(F.when(F.col("_below") <= F.ceil(pos), F.col("value"))).alias(f"_hi{i}"))
    found = placed.groupBy(*keys).agg(F.max("_total").alias("total"), *low, *high)
    values = []
    for i, p in enumerate(probabilities):
        pos = F.lit(p) * (F.col("total") - 1)
        values.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos)))
    return found.select(*keys, "total", F.array(*values).alias("q"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    return quantiles(column_value_counts(df, columns), probabilities)


def with_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery."""
    row = single.select(F.struct(*single.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select(
        *[F.col(c) for c in df.columns], *[F.col(f"_row.{c}").alias(c) for c in single.columns]
    )
