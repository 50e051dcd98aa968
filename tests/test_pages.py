"""Odds cells and race facts in literal pages."""

from pyspark.sql import functions as F

from furlong.functions import pages as P
from furlong.functions.race_page import race_fields


def cell(numbers, odds):
    return f'<td class="n">{numbers}</td> <td a="1" class="oddsvalue">{odds}</td>'


def test_odds_by_bet_type(spark):
    html = cell("7", "1.5") + cell("3", "2.0") + cell("11,2", "9.1") + cell("2,11", "8.0") + cell("100,9,1", "77") + cell("3", "2.5")
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = [[{c["key"]: c["odds"] for c in x} for x in r] for r in df.select(*[P.odds_of_bet(F.coalesce("html", F.lit("")), b).alias(b) for b in P.BET_ODDS]).collect()]
    assert got[0] == [{"07": 1.5, "03": 2.5}, {"02,11": 8.0}, {"11,02": 9.1, "02,11": 8.0}, {"01,09,100": 77.0}, {"100,09,01": 77.0}]
    assert got[1] == got[2] == [{}] * 5


def test_a_page_is_read_once_for_a_bet_type(spark):
    n = 3000
    html = "".join(cell(str(k % 1000), f"{k}.5") for k in range(n))
    df = spark.createDataFrame([(html,)], "html string").select(P.odds_of_bet(F.col("html"), "win").alias("o"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2
    assert [(c["key"], c["odds"]) for c in df.first()["o"]] == [(f"{k % 1000:02d}", k + 0.5) for k in range(n - 1000, n)]


def fields(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").repartition(2)
    return [r.asDict() for r in race_fields(df, F.col("html")).drop("html").orderBy("i").collect()]


def test_race_fields(spark):
    full = """<h1></h1><h1><a>皐月賞</a>(G1)</h1><div class="mainrace_data fc"><span>芝右 外1800m / 天候 : 曇 / 芝 : 稍重 / 発走 : 15:40</span></div>
      <p class="smalltxt">2024年4月7日 3回中山6日目 3歳オープン</p>"""
    bare = "<h1>C1戦</h1>左へ 障害 と 3000 m 天候：雨 馬場/重 2023年12月31日"
    got = fields(spark, full, bare, None, "", "<h1>新馬戦</h1><div class='x'>ダ1000ｍ</div>", "<p>50000m 芝</p>")
    assert got[0] == {
        "i": 0, "race_name": "皐月賞 (G1)", "surface": "芝", "distance": 1800, "weather": "曇", "going": "稍重", "race_date": "20240407",
        "post_time": "15:40", "race_class": "G1", "meeting": 3, "meeting_day": 6, "direction": "右",
    }
    assert (got[1]["surface"], got[1]["distance"], got[1]["weather"], got[1]["going"], got[1]["race_date"], got[1]["race_class"]) == (
        "障害", 3000, "雨", "重", "20231231", "C1",
    )
    for r in got[2:4]:
        assert set(r.values()) - {r["i"]} == {None, "不明"}
    assert (got[4]["surface"], got[4]["distance"], got[4]["race_class"]) == ("ダート", 1000, "新馬")
    assert (got[5]["surface"], got[5]["distance"]) == (None, None)
