"""Flat sources: header CSV, relational tables, cached pages, payout cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions.text import first_known, normalise_url, yen


def csv_scan(
    spark: SparkSession, path: str, columns: Sequence[str], aliases: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Header CSV, every column text. aliases maps a column to the names it may go by.

    The declared columns are those of the header, in its order.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    folded = [
        first_known({n: F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns})[0].alias(out)
        for out, names in aliases.items()
    ]
    used = {n for names in aliases.values() for n in names} | set(aliases)
    return raw.select(*[c for c in raw.columns if c not in used], *folded)


def dimension(df: DataFrame, key: str, order: Column, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """One row per key: fields by first or last non-null occurrence in a given order."""

    def pick(fn, c):
        return fn(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)

    return df.groupBy(key).agg(*[pick(F.min_by, c) for c in first], *[pick(F.max_by, c) for c in last])


def relational_scan(
    spark: SparkSession, path: str, columns: Mapping[str, str]
) -> DataFrame:
    """A stored table under the names of the engine."""
    return spark.read.parquet(path).select(*[F.col(src).alias(out) for out, src in columns.items()])


def cached_pages(
    wanted: DataFrame,
    cache: DataFrame,
    key: str,
    url: str = "url",
    page: str = "page_id",
    id_pattern: str = r"/([0-9]+)(\.html)?$",
) -> DataFrame:
    """Wanted URLs with the page that holds them: by normalised URL, else by the id at its end.

    Several pages of one URL or id give the smallest page.
    """

    def ident(c: Column) -> Column:
        return F.nullif(F.regexp_extract(F.regexp_replace(normalise_url(c), r"/+$", ""), id_pattern, 1), F.lit(""))

    by_url = cache.groupBy(normalise_url(F.col(url)).alias("_u")).agg(F.min(page).alias("_by_url"))
    by_id = (
        cache.select(ident(F.col(url)).alias("_i"), page)
        .filter(F.col("_i").isNotNull())
        .groupBy("_i")
        .agg(F.min(page).alias("_by_id"))
    )
    return (
        wanted.withColumn("_u", normalise_url(F.col(url)))
        .withColumn("_i", ident(F.col(url)))
        .join(by_url, "_u", "left")
        .join(by_id, "_i", "left")
        .select(
            *[F.col(c) for c in wanted.columns],
            F.coalesce("_by_url", "_by_id").alias("cached_page"),
            F.when(F.col("_by_url").isNotNull(), F.lit("url"))
            .when(F.col("_by_id").isNotNull(), F.lit("id"))
            .otherwise(F.lit("missing"))
            .alias("matched_by"),
        )
    )


def payout_rows(df: DataFrame, combos: str, payouts: str, popularity: str) -> DataFrame:
    """One row per combination of cells that list several, split at line breaks.

    Cells without any combination count as one empty one; rows with neither a
    combination nor money are dropped.
    """

    def parts(c):
        return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    listed = df.withColumns({"_c": parts(combos), "_p": parts(payouts), "_r": parts(popularity)})
    listed = listed.withColumn("_c", F.when(F.size("_c") > 0, F.col("_c")).otherwise(F.array(F.lit(""))))
    rest = [c for c in df.columns if c not in (combos, payouts, popularity)]
    return (
        listed.select(*rest, "_p", "_r", F.posexplode("_c").alias("_i", "combination"))
        .select(
            *rest,
            "combination",
            yen(F.coalesce(F.get("_p", F.col("_i")), F.lit(""))).alias("payout"),
            F.regexp_extract(F.coalesce(F.get("_r", F.col("_i")), F.lit("")), "([0-9]+)", 1)
            .try_cast("int")
            .alias("popularity"),
        )
        .filter((F.col("combination") != "") | (F.col("payout") != 0))
    )
