"""How the driver's tables play racing tables, and the registry of checked queries.

A line item is a runner, an order its race. The same mapping is written twice: as
DataFrames here and as SQL for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators.audit import audit_grains as grains_of


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Runners with what the line item alone tells."""
    qty = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_partkey").alias("horse_id"),
        F.col("l_suppkey").alias("jockey_id"),
        F.col("l_linenumber").alias("runner_no"),
        F.col("l_returnflag").alias("surface"),
        F.col("l_linestatus").alias("status"),
        (1 + F.col("l_extendedprice") / 1000).alias("odds"),
        F.when(qty <= 45, 1 + qty.cast("int") % 18).alias("finish"),
        qty.alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def races(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("race_id"),
        F.col("o_orderdate").cast("date").alias("race_date"),
        F.col("o_custkey").alias("trainer_id"),
        F.col("o_orderpriority").alias("venue"),
        F.col("o_orderstatus").alias("race_class"),
        F.col("o_totalprice").alias("prize"),
    )


def courses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("horse_id"),
        (F.col("p_size") * 100).alias("distance"),
        F.col("p_brand").alias("sire"),
        F.col("p_type").alias("dam"),
        F.col("p_name").alias("horse_name"),
    )


def runners(spark: SparkSession, sf: str) -> DataFrame:
    """Runners with race and horse attributes."""
    return (
        entries(spark, sf)
        .join(races(spark, sf), "race_id")
        .join(courses(spark, sf), "horse_id")
    )


def runners_by_race(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of runners, joined by race last, so that what comes next by race needs no shuffle."""
    out = entries(spark, sf).join(courses(spark, sf), "horse_id").join(races(spark, sf), "race_id")
    return out.select(*runners(spark, sf).columns)


ENTRIES_SQL = """entries AS (
  SELECT l_orderkey AS race_id, l_partkey AS horse_id, l_suppkey AS jockey_id,
         l_linenumber AS runner_no, l_returnflag AS surface, l_linestatus AS status,
         1 + l_extendedprice / 1000 AS odds,
         CASE WHEN l_quantity <= 45 THEN 1 + CAST(l_quantity AS INTEGER) % 18 END AS finish,
         l_quantity AS qty, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""

RUNNERS_SQL = (
    ENTRIES_SQL
    + """, runners AS (
  SELECT e.*, CAST(o_orderdate AS DATE) AS race_date, o_custkey AS trainer_id,
         o_orderpriority AS venue, o_orderstatus AS race_class, o_totalprice AS prize,
         p_size * 100 AS distance, p_brand AS sire, p_type AS dam, p_name AS horse_name
  FROM entries e JOIN orders ON e.race_id = o_orderkey JOIN part ON e.horse_id = p_partkey)"""
)

# Total order of runners; lines equal in all of these are equal in every value used.
TIE = ["runner_no", "horse_id", "jockey_id", "price", "qty", "discount", "tax"]


def r(col: str, digits: int = 6, alias: str | None = None):
    return F.round(F.col(col), digits).alias(alias or col)


def with_entries(select: str) -> str:
    return f"WITH {ENTRIES_SQL} {select}"


def with_runners(select: str) -> str:
    return f"WITH {RUNNERS_SQL} {select}"


# Text rows as an audit sees them, with gaps of every kind made from the columns.
AUDIT_SQL = (
    RUNNERS_SQL
    + """, audit AS (
  SELECT CAST(race_id AS VARCHAR) AS race_id, CASE WHEN qty <> 12 THEN strftime(race_date, '%Y%m%d') END AS race_date,
    CASE WHEN qty <> 13 THEN venue ELSE '' END AS venue,
    CASE WHEN runner_no <> 3 THEN CAST(race_id % 12 + 1 AS VARCHAR) END AS race_number,
    CASE WHEN race_id % 100 BETWEEN 1 AND 12 THEN CAST(race_id % 100 AS INTEGER) END AS race_number_derived,
    CASE WHEN qty <> 14 THEN 'H' || horse_id ELSE ' ' END AS horse_id, horse_name,
    CASE WHEN runner_no <> 7 THEN CAST((runner_no + 1) // 2 AS VARCHAR) END AS frame_number,
    CAST(runner_no AS VARCHAR) AS horse_number,
    CASE WHEN qty = 44 THEN '' WHEN finish IS NULL THEN '取消' ELSE CAST(finish AS VARCHAR) END AS finish_position,
    CASE WHEN qty <= 43 AND qty <> 20 THEN '1:' || (CAST(qty AS INTEGER) + 10) || '.5' END AS result_time,
    CASE WHEN finish > 1 AND qty <> 21 THEN '1/2' END AS margin,
    CASE WHEN qty = 30 THEN 'x' WHEN qty <> 31 THEN CAST(CAST(qty AS INTEGER) AS VARCHAR) END AS odds,
    CASE WHEN qty = 33 THEN '?' WHEN qty <> 32 THEN CAST(runner_no AS VARCHAR) ELSE '' END AS popularity,
    CASE WHEN runner_no <> 2 THEN '480' END AS horse_weight, 'J' || jockey_id AS jockey, 'T' || trainer_id AS trainer,
    CASE WHEN discount > 0.02 THEN sire END AS sire, CASE WHEN discount > 0.01 THEN dam END AS dam,
    CASE WHEN discount > 0.01 THEN sire END AS broodmare_sire, surface AS race_type, CAST(distance AS VARCHAR) AS distance,
    surface, race_class AS class, CASE WHEN status = 'O' THEN 'entry' ELSE 'result' END AS source_page_type,
    strftime(race_date, '%Y') AS year, strftime(race_date, '%m') AS month,
    CASE WHEN runner_no = 1 THEN '1.9.0' WHEN runner_no = 2 THEN '2.0.0' WHEN runner_no <> 4 THEN '2.1' END AS parser_version,
    strftime(race_date, '%Y-%m-%d') || ' 00:00:00' AS fetched_at, CASE WHEN tax > 0.01 THEN 1 ELSE 0 END AS source_html_present,
    CASE WHEN qty = 40 THEN '404' ELSE '200' END AS http_status, 0 AS is_error_page,
    price, qty, discount, tax, runner_no,
    CASE WHEN runner_no = 1 THEN 'race_number' WHEN runner_no = 2 THEN 'race_no' WHEN runner_no <= 4 THEN 'round' WHEN runner_no = 5 THEN '' END AS race_number_source
  FROM runners)"""
)


def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    qty, no = F.col("qty"), F.col("runner_no")
    text = lambda c: F.col(c).cast("string")
    return runners(spark, sf).select(
        text("race_id").alias("race_id"),
        F.when(qty != 12, F.date_format("race_date", "yyyyMMdd")).alias("race_date"),
        F.when(qty != 13, F.col("venue")).otherwise(F.lit("")).alias("venue"),
        F.when(no != 3, (F.col("race_id") % 12 + 1).cast("string")).alias("race_number"),
        F.when((F.col("race_id") % 100).between(1, 12), (F.col("race_id") % 100).cast("int")).alias(
            "race_number_derived"
        ),
        F.when(qty != 14, F.concat(F.lit("H"), "horse_id")).otherwise(F.lit(" ")).alias("horse_id"),
        "horse_name",
        F.when(no != 7, F.floor((no + 1) / 2).cast("string")).alias("frame_number"),
        text("runner_no").alias("horse_number"),
        F.when(qty == 44, F.lit(""))
        .when(F.col("finish").isNull(), F.lit("取消"))
        .otherwise(text("finish"))
        .alias("finish_position"),
        F.when((qty <= 43) & (qty != 20), F.concat(F.lit("1:"), qty.cast("int") + 10, F.lit(".5"))).alias(
            "result_time"
        ),
        F.when((F.col("finish") > 1) & (qty != 21), F.lit("1/2")).alias("margin"),
        F.when(qty == 30, F.lit("x")).when(qty != 31, qty.cast("int").cast("string")).alias("odds"),
        F.when(qty == 33, F.lit("?")).when(qty != 32, text("runner_no")).otherwise(F.lit("")).alias("popularity"),
        F.when(no != 2, F.lit("480")).alias("horse_weight"),
        F.concat(F.lit("J"), "jockey_id").alias("jockey"),
        F.concat(F.lit("T"), "trainer_id").alias("trainer"),
        F.when(F.col("discount") > 0.02, F.col("sire")).alias("sire"),
        F.when(F.col("discount") > 0.01, F.col("dam")).alias("dam"),
        F.when(F.col("discount") > 0.01, F.col("sire")).alias("broodmare_sire"),
        F.col("surface").alias("race_type"),
        text("distance").alias("distance"),
        "surface",
        F.col("race_class").alias("class"),
        F.when(F.col("status") == "O", F.lit("entry")).otherwise(F.lit("result")).alias("source_page_type"),
        F.date_format("race_date", "yyyy").alias("year"),
        F.date_format("race_date", "MM").alias("month"),
        F.when(no == 1, F.lit("1.9.0")).when(no == 2, F.lit("2.0.0")).when(no != 4, F.lit("2.1")).alias(
            "parser_version"
        ),
        F.date_format("race_date", "yyyy-MM-dd 00:00:00").alias("fetched_at"),
        F.when(F.col("tax") > 0.01, 1).otherwise(0).alias("source_html_present"),
        F.when(qty == 40, F.lit("404")).otherwise(F.lit("200")).alias("http_status"),
        F.lit(0).alias("is_error_page"),
        "price",
        "qty",
        "discount",
        "tax",
        "runner_no",
        F.when(no == 1, F.lit("race_number"))
        .when(no == 2, F.lit("race_no"))
        .when(no <= 4, F.lit("round"))
        .when(no == 5, F.lit(""))
        .alias("race_number_source"),
    )


def audit_grains(spark: SparkSession, sf: str) -> DataFrame:
    return grains_of(audit_rows(spark, sf), "19950101", "19991231")


def with_audit(select: str) -> str:
    return f"WITH {AUDIT_SQL} {select}"
