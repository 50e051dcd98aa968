"""Facts about a race in the text of its page. Each field is one expression over the whole page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions.pages import first_field

# Words and layouts of race pages.
SURFACE = r"(芝|ダ(?:ート)?|障(?:害)?)"
COURSE = SURFACE + r"[\s・右左直外内障]{0,8}([0-9]{3,4})\s*[mｍ]"
NAMED_COURSE = SURFACE + r".*?([0-9]{3,4})\s*[mｍ]"
BARE_DISTANCE = r"\b([0-9]{3,4})\s*[mｍ]"
DAY = r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"
WEATHER = [r"天候\s*[:/：]\s*([^\s/]+)"]
GOING = [r"(?:芝|ダート)\s*[:/：]\s*([^\s/]+)", r"馬場\s*[:/：]\s*([^\s/]+)"]
POST_TIME = [r"発走\s*[:/：]?\s*([0-9]{1,2}:[0-9]{2})"]
MEETING = [r"([0-9]+)回"]
MEETING_DAY = [r"([0-9]+)日目"]
DIRECTION = [r"[芝ダ]((?:右|左)[外内]?)"]
STRAIGHT = "直線"
# Classes in the order in which they are tried.
CLASSES = [
    r"(G[1-3])",
    r"(新馬)",
    r"(未勝利)",
    r"([1-3]勝クラス)",
    r"(オープン|OP)",
    r"(重賞)",
    r"[（(]([ABC][1-3][二三一四]?)[）)]",
    r"[（(]([AB]混合)[）)]",
    r"[（(]([AB])[）)]",
    r"[（(]([0-9]歳)[）)]",
    r"^([0-9]歳)",
    r"(?<![A-Za-z])([ABC][1-3])(?![A-Za-z])",
    r"([AB]B?混合)",
]
OPEN_CLASS = "オープン"
SPECIAL = "特別"
UNKNOWN_CLASS = "不明"
DISTANCES = (100, 3600)


def plain(html: Column) -> Column:
    """Text without tags, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def element(html: Column, tag: str, css: str) -> Column:
    """Text of the first element of a tag and class, up to its next closing tag; null if there is none."""
    inner = F.regexp_extract(html, rf'(?is)<{tag}\b[^>]*class="(?:[^"]*\s)?{css}(?:\s[^"]*)?"[^>]*>(.*?)</{tag}>', 1)
    return F.nullif(plain(inner), F.lit(""))


def surface_name(found: Column) -> Column:
    return (
        F.when(found == "芝", "芝").when(found.startswith("障"), "障害").when(found.startswith("ダ"), "ダート")
    )


def day_text(text: Column) -> Column:
    """The first date of a text as YYYYMMDD."""
    parts = [F.regexp_extract(text, DAY, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat(parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")))


def _number(c: Column) -> Column:
    return c.try_cast("int")


def race_class(name: Column, sources: Sequence[Column]) -> Column:
    """The first class named by the sources, one after the other; else what the name of the race implies."""
    found = F.coalesce(*[first_field(s, CLASSES) for s in sources])
    implied = F.when(name.contains(SPECIAL), OPEN_CLASS)
    for word in ("新馬", "未勝利", "重賞"):
        implied = implied.when(name.contains(word), word)
    return F.when(found == "OP", OPEN_CLASS).otherwise(F.coalesce(found, implied, F.lit(UNKNOWN_CLASS)))


def race_fields(df: DataFrame, html: Column) -> DataFrame:
    """Add name, surface, distance, weather, going, day, post time, class, meeting, day of the meeting and direction.

    The course comes from the block of race data, else from the name, else a distance of 100 to 3600 metres and a
    surface word are taken on their own. A field that is not found is null, the class 不明. The parts of a page that
    many fields read are cut out once, in steps.
    """
    kept = [F.col(c) for c in df.columns]
    names = F.transform(F.regexp_extract_all("_html", F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), 1), plain)
    parts = (
        df.select(*kept, F.coalesce(html, F.lit("")).alias("_html"))
        .withColumns({"_names": names, "_small": F.coalesce(element(F.col("_html"), "p", "smalltxt"), F.lit(""))})
        .withColumns(
            {
                "_name": F.coalesce(F.get(F.filter("_names", lambda x: x != ""), F.lit(0)), F.lit("")),
                "_info": F.coalesce(
                    element(F.col("_html"), "div", "mainrace_data"), F.nullif(F.col("_small"), F.lit("")),
                    element(F.col("_html"), "div", "smalltxt"), plain(F.col("_html")),
                ),
            }
        )
    )
    name, small, info = F.col("_name"), F.col("_small"), F.col("_info")
    in_info, in_name = F.regexp_extract(info, COURSE, 2), F.regexp_extract(name, NAMED_COURSE, 2)
    bare = _number(F.regexp_extract(info, BARE_DISTANCE, 1))
    said = F.coalesce(F.nullif(small, F.lit("")), info)
    found = parts.withColumns({"_in_info": in_info, "_in_name": in_name, "_bare": bare, "_said": said})
    in_info, in_name, bare, said = (F.col(c) for c in ("_in_info", "_in_name", "_bare", "_said"))
    distance = (
        F.when(in_info != "", _number(in_info)).when(in_name != "", _number(in_name)).when(bare.between(*DISTANCES), bare)
    )
    word = (
        F.when(in_info != "", F.regexp_extract(info, COURSE, 1))
        .when(in_name != "", F.regexp_extract(name, NAMED_COURSE, 1))
        .when(bare.between(*DISTANCES), F.regexp_extract(info, "(芝|ダート|ダ|障害)", 1))
    )
    return found.withColumn("_word", word).select(
        *kept,
        F.nullif(name, F.lit("")).alias("race_name"),
        surface_name(F.col("_word")).alias("surface"),
        distance.alias("distance"),
        first_field(info, WEATHER).alias("weather"),
        first_field(info, GOING).alias("going"),
        F.coalesce(day_text(small), day_text(F.col("_html"))).alias("race_date"),
        first_field(info, POST_TIME).alias("post_time"),
        race_class(name, [name, small, info]).alias("race_class"),
        _number(first_field(said, MEETING)).alias("meeting"),
        _number(first_field(said, MEETING_DAY)).alias("meeting_day"),
        F.coalesce(first_field(info, DIRECTION), F.when(info.contains(STRAIGHT), STRAIGHT)).alias("direction"),
    )
