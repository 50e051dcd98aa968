"""Sources and sinks. What is written goes to the session's shared folder and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.session import shared_dir
from furlong.sources import documents as D
from furlong.sources import sinks as K
from furlong.sources import tables as S
from furlong.sources.keyed import KeyedTable, replace_children_in, upsert_into
from furlong.verify.base import entries, query, races, runners, table, with_entries, with_runners

ID_SQL = "race_id, runner_no, horse_id, jockey_id"

RACE_DOC = T.StructType(
    [
        T.StructField("race_id", T.LongType()),
        T.StructField("venue", T.StringType()),
        T.StructField("surface", T.StringType()),
        T.StructField("prize", T.DoubleType()),
        T.StructField("_invalid_distance", T.BooleanType()),
    ]
)
RUNNER_DOC = T.StructType(
    [
        T.StructField("race_id", T.LongType()),
        T.StructField("horse_id", T.LongType()),
        T.StructField("runner_no", T.IntegerType()),
        T.StructField("surface", T.StringType()),
        T.StructField("finish", T.IntegerType()),
    ]
)


def _documents(spark, sf):
    """Tables as JSON text: one race in ten is flagged, runner 7 is cut off, runner 2 has no surface."""
    race = races(spark, sf).select(
        F.to_json(
            F.struct(
                "race_id", "venue", F.lit("?").alias("surface"), "prize",
                (F.col("trainer_id") % 10 == 0).alias("_invalid_distance"),
            )
        ).alias("data")
    )
    doc = F.to_json(
        F.struct(
            "race_id", "horse_id", "runner_no",
            F.when(F.col("runner_no") != 2, F.col("surface")).alias("surface"), "finish",
        )
    )
    runner = entries(spark, sf).select(
        F.when(F.col("runner_no") == 7, F.substring(doc, 1, 20)).otherwise(doc).alias("data")
    )
    return race, runner


@query(
    "json_blob_scan",
    with_entries(
        """SELECT e.race_id, e.horse_id, e.runner_no, CASE WHEN e.runner_no <> 2 THEN e.surface
          WHEN o_orderkey IS NOT NULL THEN '?' END AS surface, e.finish, o_orderpriority AS venue, o_totalprice AS prize
        FROM entries e LEFT JOIN orders ON e.race_id = o_orderkey
        WHERE e.runner_no <> 7 AND NOT coalesce(o_custkey % 10 = 0, false)"""
    ),
)
def json_blob_scan(spark, sf):
    race, runner = _documents(spark, sf)
    return D.scan_documents(race, runner, RACE_DOC, RUNNER_DOC)


def _open_documents(spark, sf):
    """Runner documents with keys that RUNNER_DOC does not declare; runner 7 is cut off."""
    no = F.col("runner_no")
    doc = F.to_json(
        F.struct(
            "race_id", "horse_id", "runner_no", "finish", "jockey_id",
            F.when(no == 1, F.col("surface")).alias("going"),
            F.when(no == 2, F.struct("qty")).alias("body"),
            F.when(no != 3, F.when(no < 3, F.lit("x")).otherwise(no.cast("string"))).alias("mark"),
            (F.col("qty") > 25).alias("heavy"),
        )
    )
    return entries(spark, sf).select(F.when(no == 7, F.substring(doc, 1, 20)).otherwise(doc).alias("data"))


@query(
    "json_undeclared_keys",
    with_entries(
        """, r AS (SELECT * FROM entries WHERE runner_no <> 7)
        SELECT 'jockey_id' AS key, 'number' AS kind, count(*) AS documents FROM r
        UNION ALL SELECT 'going', 'text', count(*) FROM r WHERE runner_no = 1
        UNION ALL SELECT 'body', 'object', count(*) FROM r WHERE runner_no = 2
        UNION ALL SELECT 'mark', 'text', count(*) FROM r WHERE runner_no <> 3
        UNION ALL SELECT 'heavy', 'boolean', count(*) FROM r"""
    ),
)
def json_undeclared_keys(spark, sf):
    return D.key_profile(_open_documents(spark, sf), declared=RUNNER_DOC)


@query(
    "json_open_scan",
    with_entries(
        """SELECT race_id, horse_id, runner_no, finish, CAST(jockey_id AS DOUBLE) AS jockey_id, CASE WHEN runner_no = 1 THEN surface END AS going,
          CASE WHEN runner_no = 3 THEN NULL WHEN runner_no < 3 THEN 'x' ELSE CAST(runner_no AS VARCHAR) END AS mark, qty > 25 AS heavy,
          CASE WHEN runner_no = 2 THEN CAST(qty AS DOUBLE) END AS body_qty
        FROM entries WHERE runner_no <> 7"""
    ),
)
def json_open_scan(spark, sf):
    out = D.parse_open(_open_documents(spark, sf), RUNNER_DOC)
    out = out.filter(F.col(D.CORRUPT).isNull())
    return out.select(
        "race_id", "horse_id", "runner_no", "finish", "jockey_id", "going", "mark", "heavy",
        F.try_variant_get("body", "$.qty", "double").alias("body_qty"),
    )


@query(
    "csv_scan",
    with_entries(
        """SELECT CAST(race_id AS VARCHAR) AS race_id, CAST(horse_id AS VARCHAR) AS horse_id,
        CASE WHEN runner_no <> 3 THEN surface END AS surface, CAST(coalesce(CASE WHEN runner_no % 2 = 0 THEN runner_no END, runner_no + 100) AS VARCHAR) AS race_number FROM entries"""
    ),
)
def csv_scan(spark, sf):
    path = shared_dir(spark, "csv")
    no = F.col("runner_no")
    entries(spark, sf).select(
        "race_id",
        "horse_id",
        F.when(no != 3, F.col("surface")).alias("surface"),
        F.when(no % 2 == 0, no).alias("race_number"),
        (no + 100).alias("race_no"),
    ).write.csv(path, header=True)
    columns = ["race_id", "horse_id", "surface", "race_number", "race_no"]
    return S.csv_scan(spark, path, columns, {"race_number": ["race_number", "race_no"]}).select(
        "race_id", "horse_id", F.nullif("surface", F.lit("")).alias("surface"), "race_number"
    )


@query(
    "csv_dimension",
    """SELECT l_orderkey AS race_id, min(l_shipdate) AS first_ship, arg_max(l_returnflag, (l_shipdate, l_returnflag)) AS last_surface
    FROM lineitem GROUP BY 1""",
)
def csv_dimension(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_shipdate").alias("first_ship"),
        F.col("l_returnflag").alias("last_surface"),
    )
    order = F.struct("first_ship", "last_surface")
    return S.dimension(li, "race_id", order, first=["first_ship"], last=["last_surface"])


@query("relational_scan", "SELECT o_orderkey AS race_id, o_orderpriority AS venue, o_totalprice AS prize FROM orders")
def relational_scan(spark, sf):
    names = {"race_id": "o_orderkey", "venue": "o_orderpriority", "prize": "o_totalprice"}
    return S.relational_scan(spark, f"{sf}/orders.parquet", names)


_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[?#].*$', ''),
  '^(www|m)\.', ''), '/+$', '')"""


@query(
    "page_cache_scan",
    rf"""WITH n AS (SELECT page_id, url, {_NORM} AS u FROM pages),
    c AS (SELECT page_id, u, nullif(regexp_extract(u, '/([0-9]+)(\.html)?$', 1), '') AS i FROM n),
    w AS (SELECT page_id AS want_id, CASE page_id % 3 WHEN 0 THEN u WHEN 1 THEN 'other.example.org/x/' || coalesce(i, 'q') ELSE 'none.example/zzz' END AS u,
      CASE page_id % 3 WHEN 0 THEN i WHEN 1 THEN i END AS i FROM c)
    SELECT want_id, coalesce(a.p, b.p) AS cached_page, CASE WHEN a.p IS NOT NULL THEN 'url' WHEN b.p IS NOT NULL THEN 'id' ELSE 'missing' END AS matched_by
    FROM w LEFT JOIN (SELECT u, min(page_id) AS p FROM c GROUP BY u) a ON w.u = a.u
      LEFT JOIN (SELECT i, min(page_id) AS p FROM c WHERE i IS NOT NULL GROUP BY i) b ON w.i = b.i""",
)
def page_cache_scan(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    bare = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    ident = F.nullif(F.regexp_extract(F.regexp_replace(bare, "/+$", ""), r"/([0-9]+)(\.html)?$", 1), F.lit(""))
    url = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.col("url"), F.lit("")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("http://www.other.example.org/x/"), F.coalesce(ident, F.lit("q")), F.lit("?r=1")))
        .otherwise(F.lit("https://none.example/zzz"))
    )
    wanted = pages.select(F.col("page_id").alias("want_id"), url.alias("url"))
    return S.cached_pages(wanted, pages, "want_id").drop("url")


_ROW = """l_orderkey AS race_id, l_linenumber AS runner_no, l_shipdate AS loaded, l_partkey AS horse_id, l_quantity AS qty,
  l_extendedprice AS price, l_discount AS discount, l_tax AS tax"""


def _loads(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_linenumber").alias("runner_no"),
        F.col("l_shipdate").alias("loaded"),
        F.col("l_partkey").alias("horse_id"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    return li.filter(F.col("loaded") < cut), li.filter(F.col("loaded") >= cut)


@query(
    "upsert_latest",
    f"""SELECT race_id, runner_no, strftime(loaded, '%Y%m%d') AS loaded, horse_id, qty, price FROM (SELECT *, row_number() OVER (PARTITION BY race_id, runner_no
      ORDER BY loaded DESC, horse_id DESC, qty DESC, price DESC, discount DESC, tax DESC) AS rn FROM (SELECT {_ROW} FROM lineitem)) WHERE rn = 1""",
)
def upsert_latest(spark, sf):
    old, new = _loads(spark, sf)
    stored = KeyedTable(spark, shared_dir(spark, "upsert"), old.schema, ["race_id", "runner_no"], 8)
    upsert_into(stored, old, ["loaded"])
    upsert_into(stored, new, ["loaded"])
    out = stored.rows()
    return out.select("race_id", "runner_no", F.date_format("loaded", "yyyyMMdd").alias("loaded"), "horse_id", "qty", "price")


@query(
    "replace_children",
    f"""WITH r AS (SELECT {_ROW} FROM lineitem), new AS (SELECT * FROM r WHERE loaded >= TIMESTAMP '1999-01-01')
    SELECT race_id, runner_no, horse_id, qty, price FROM r WHERE loaded < TIMESTAMP '1999-01-01' AND race_id NOT IN (SELECT race_id FROM new)
    UNION ALL SELECT race_id, runner_no, horse_id, qty, price FROM new""",
)
def replace_children(spark, sf):
    old, new = _loads(spark, sf)
    stored = KeyedTable(spark, shared_dir(spark, "children"), old.schema, ["race_id", "runner_no"], 8, bucket_by=["race_id"])
    replace_children_in(stored, old)
    replace_children_in(stored, new)
    return stored.rows().select("race_id", "runner_no", "horse_id", "qty", "price")


@query(
    "replace_partitions",
    f"""WITH r AS (SELECT {_ROW}, year(l_shipdate) AS y FROM lineitem)
    SELECT race_id, runner_no, horse_id, price FROM r WHERE y NOT IN (SELECT y FROM r WHERE runner_no = 1)
    UNION ALL SELECT race_id, runner_no, horse_id, price FROM r WHERE runner_no = 1""",
)
def replace_partitions(spark, sf):
    path = shared_dir(spark, "partitions")
    old, new = _loads(spark, sf)
    rows = old.unionByName(new).withColumn("y", F.year("loaded"))
    K.overwrite_partitions(rows, path, ["y"])
    K.overwrite_partitions(rows.filter("runner_no = 1"), path, ["y"])
    return spark.read.parquet(path).select("race_id", "runner_no", "horse_id", "price")


@query(
    "export_prefix",
    with_entries(
        """SELECT race_id, runner_no, horse_id, price FROM entries WHERE race_id IN (SELECT o_orderkey FROM orders
        WHERE strftime(o_orderdate, '%Y%m%d') LIKE '1997%' ORDER BY o_orderkey LIMIT 500)"""
    ),
)
def export_prefix(spark, sf):
    dated = races(spark, sf).withColumn("day", F.date_format("race_date", "yyyyMMdd"))
    out = K.export_prefix(dated, entries(spark, sf), "race_id", "day", "1997", 500)
    return out.select("race_id", "runner_no", "horse_id", "price")


@query("full_copy", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def full_copy(spark, sf):
    source = table(spark, sf, "customer")
    copied = K.full_copy(source, shared_dir(spark, "copy"), ["c_custkey"])
    rest = T.StructType([f for f in source.schema.fields if f.name != "c_custkey"])
    return D.parse_documents(copied, rest).drop(D.CORRUPT)


@query(
    "bet_csv_sink",
    with_entries(
        "SELECT CAST(race_id AS VARCHAR) AS race_id, surface AS bet_type, horse_id || ' / ' || jockey_id AS horses, "
        "CAST(CAST(qty * 100 AS BIGINT) AS VARCHAR) AS total_cost FROM entries"
    ),
)
def bet_csv_sink(spark, sf):
    path = shared_dir(spark, "bets")
    bets = entries(spark, sf).select(
        "race_id",
        F.col("surface").alias("bet_type"),
        F.array(F.col("horse_id").cast("string"), F.col("jockey_id").cast("string")).alias("horses"),
        (F.col("qty") * 100).cast("bigint").alias("total_cost"),
    )
    columns = ["race_id", "bet_type", "horses", "total_cost"]
    K.bet_csv(bets, path, columns)
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in columns))


@query(
    "feature_cache",
    with_runners(
        f"SELECT {ID_SQL}, CAST(finish AS INTEGER) AS finish, round(CAST(CAST(odds AS FLOAT) AS DOUBLE), 3) AS odds, distance FROM runners"
    ),
)
def feature_cache(spark, sf):
    path = shared_dir(spark, "features")

    def build():
        return runners(spark, sf).select("race_id", "runner_no", "horse_id", "jockey_id", "finish", "odds", "distance")

    K.feature_cache(spark, path, build, stages=[build])
    again = K.feature_cache(spark, path, build, stages=[build])
    return again.select(
        F.col("race_id").cast("bigint"), "runner_no", F.col("horse_id").cast("bigint"), F.col("jockey_id").cast("bigint"),
        "finish", F.round(F.col("odds").cast("double"), 3).alias("odds"), "distance",
    )


@query(
    "payout_fanout",
    """SELECT o_orderkey AS race_id, o_orderpriority AS bet_type, i || '-' || (i + 1) AS combination,
      CASE WHEN i <= 2 THEN CAST(o_custkey AS BIGINT) * 1000 + 20 * i ELSE 0 END AS payout, CASE WHEN i = 1 THEN CAST(o_custkey % 18 AS INTEGER) END AS popularity
    FROM orders, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= o_orderkey % 4""",
)
def payout_fanout(spark, sf):
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    lines = F.slice(F.array(*[F.lit(f" {i}-{i + 1} ") for i in (1, 2, 3)]), 1, (k % 4).cast("int"))
    money = F.concat_ws("\n", *[F.concat((cust * 1).cast("string"), F.lit(f",{20 * i:03d}円")) for i in (1, 2)])
    cells = table(spark, sf, "orders").select(
        k.alias("race_id"),
        F.col("o_orderpriority").alias("bet_type"),
        F.array_join(lines, "\n").alias("combos"),
        F.when(k % 4 > 0, money).alias("payouts"),
        F.concat(cust % 18, F.lit("番人気")).alias("pops"),
    )
    return S.payout_rows(cells, "combos", "payouts", "pops")
