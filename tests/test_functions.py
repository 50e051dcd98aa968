"""Literal cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from furlong.functions import arrays as A
from furlong.functions import racing as R
from furlong.functions import text as T


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, c {kind}")
    return [x[0] for x in df.orderBy("i").select(fn(F.col("c"))).collect()]


def test_clock(spark):
    got = values(spark, ["1:34.5", "1:34", "0:58.3", "94.5", None, "", "-", "nan", "2:00.0", "1:x"], T.clock_to_seconds)
    assert got == [94.5, 94.0, 58.3, 94.5, None, None, None, None, 120.0, None]


def test_numbers(spark):
    got = values(spark, ["3", " 4.0 ", "取消", "中止", "-", "", None, "1d", "abc"], T.int_or_null)
    assert got == [3, 4, None, None, None, None, None, None, None]


def test_distance_band(spark):
    got = values(spark, [1000, 1200, 1201, 1600, 1601, 2200, 2201, None], R.distance_band, "int")
    assert got == ["sprint", "sprint", "mile", "mile", "middle", "middle", "long", "unknown"]


@pytest.mark.parametrize(
    "title, cls, grade",
    [
        ("天皇賞(G1)", "", 8.0), ("レースGI", "", 8.0), ("記念GII", "", 7.0), ("賞GIII", "", 6.0), ("札幌(L)", "", 5.0),
        ("x", "オープン", 4.0), ("OP 特別", "", 4.0), ("", "2勝クラス", 2.0), ("未勝利", "", 0.0), ("新馬", "", -1.0),
        ("", "A2", 3.0), ("", "C1", 0.5), ("", "C1二", 0.0), ("", "4歳", 0.0), ("", "zzz", None),
    ],
)
def test_class_grade(spark, title, cls, grade):
    df = spark.createDataFrame([(title, cls)], "t string, c string")
    assert df.select(R.class_grade(F.col("t"), F.col("c"))).first()[0] == grade


def test_dates_and_parts(spark):
    got = values(spark, ["20240105", "2024-01-05", "2024/01/05", "2024.01.05", "05.01.2024", None], T.date_any_format)
    assert got == ["20240105"] * 4 + [None, None]
    df = spark.createDataFrame([("202401050511",), ("2024",), (None,)], "c string")
    parts = T.id_parts(F.col("c"), (1, 8), (9, 2))
    rows = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert tuple(rows[0]) == ("20240105", "05", 11)
    assert rows[1]["id_date"] is None and rows[2]["id_race_number"] is None


def test_weight_corners_sex(spark):
    df = spark.createDataFrame([("514(+6)",), ("480(-2)",), ("458<small></small>",), ("---",), (None,)], "c string")
    kg, change = T.split_weight(F.col("c"))
    assert [tuple(r) for r in df.select(kg, change).collect()] == [(514, 6), (480, -2), (458, None), (None, None), (None, None)]
    assert values(spark, ["7-7-2-2", "3", "", None, "1-x-2"], T.split_corners) == [[7, 7, 2, 2], [3], [], [], [1, 2]]
    sex, age = T.split_sex_age(F.col("c"))
    assert tuple(spark.createDataFrame([("牡5",)], "c string").select(sex, age).first()) == ("牡", 5)


def test_running_style(spark):
    df = spark.createDataFrame([([1, 1], 12), ([3, 3], 12), ([7, 7], 12), ([11, 12], 12), ([], 12), ([1], None)], "c array<int>, n int")
    got = [r[0] for r in df.select(A.running_style(F.col("c"), F.col("n"))).collect()]
    assert got == [0, 1, 2, 3, None, 0]


def test_laps(spark):
    df = spark.createDataFrame([('{"200": 12.5, "400": 23.9, "600": 35.0}',), ("bad",), ("{}",)], "j string")
    out = A.with_sectionals(df.withColumn("laps", A.lap_map(F.col("j"))), "laps", "s").select("s").collect()
    assert [(x["d"], x["t"]) for x in out[0]["s"]] == [(200, 12.5), (400, 11.4), (600, 11.1)]
    assert out[1]["s"] is None and out[2]["s"] == []


def test_rest_bins_and_season(spark):
    assert values(spark, [14, 15, 30, 60, 61, None], R.rest_class, "int") == ["short", "normal", "normal", "long", "very_long", None]
    assert values(spark, [-1, 0, 21, 90, 91, None], R.rest_code, "int") == [None, 0, 1, 2, 3, None]
    days = ["2024-12-01", "2024-01-31", "2024-03-01", "2024-08-31", "2024-09-01"]
    assert values(spark, days, lambda c: R.season_code(c.cast("date"))) == [0, 0, 1, 2, 3]
