"""Racing measures of one row. Column in, Column out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit venue codes and names.
VENUES = {
    "01": "札幌", "02": "函館", "03": "福島", "04": "新潟", "05": "東京",
    "06": "中山", "07": "中京", "08": "京都", "09": "阪神", "10": "小倉",
    "30": "門別", "31": "帯広（ば）", "35": "盛岡", "36": "水沢",
    "42": "浦和", "43": "船橋", "44": "大井", "45": "川崎", "46": "金沢",
    "47": "笠松", "48": "名古屋", "50": "園田", "51": "姫路", "54": "福山",
    "55": "高知", "60": "佐賀", "65": "帯広(ばんえい)", "66": "中津",
}

# What follows a venue name in its long spelling, and one bracket variant.
VENUE_SUFFIX = "競馬場"
VENUE_SPELLINGS = {"帯広(ば)": "帯広（ば）"}

# Title patterns of the national grades, best first; a pattern holds for
# the race title and the class text together.
TITLE_GRADES = [
    (r"G[Ⅰ1]|GI($|[^I])", 8.0),
    (r"G[Ⅱ2]|GII($|[^I])", 7.0),
    (r"G[Ⅲ3]|GIII", 6.0),
    (r"\(L\)|Listed|リステッド", 5.0),
    (r"(?i)オープン|Open|OP($|[^\p{L}\p{N}_])", 4.0),
    (r"3勝", 3.0),
    (r"2勝", 2.0),
    (r"1勝", 1.0),
    (r"未勝利", 0.0),
    (r"新馬", -1.0),
]

# Patterns of the regional classes, on the class text alone.
CLASS_GRADES = [
    (r"^重賞$", 4.0),
    (r"^A1?$", 4.0),
    (r"^A[23]$", 3.0),
    (r"^B1?$", 2.0),
    (r"^B[23]$", 1.0),
    (r"^C1?$", 0.5),
    (r"^C[23]|^C1[二三四]?", 0.0),
    (r"^[0-9]+歳", 0.0),
]

# Sex and surface codes.
SEX_CODES = {"牡": -1, "牝": 1, "セ": -1, "セン": -1, "male": -1, "female": 1, "gelding": -1}
SURFACE_CODES = {"ダート": 1, "dirt": 1, "芝": -1, "turf": -1, "sand": 1, "ばんえい": 1}
SURFACE_KINDS = {"芝": "turf", "turf": "turf", "ダート": "dirt", "dirt": "dirt", "ばんえい": "dirt"}


def lookup(c: Column, values: dict) -> Column:
    """Value of a small fixed map, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def venue_spelling(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), f"{VENUE_SUFFIX}$", "")
    return F.coalesce(lookup(t, VENUE_SPELLINGS), t)


def class_grade(title: Column, race_class: Column) -> Column:
    name = F.trim(F.coalesce(title, F.lit("")))
    cls = F.trim(F.coalesce(race_class, F.lit("")))
    both = F.concat_ws(" ", name, cls)
    rules = [(both.rlike(p), g) for p, g in TITLE_GRADES] + [(cls.rlike(p), g) for p, g in CLASS_GRADES]
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for cond, grade in rules[1:]:
        out = out.when(cond, F.lit(grade))
    return out


def bands(c: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bands: label i for values up to edges[i], the last label beyond."""
    out = F.when(c <= edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(c <= edge, F.lit(label))
    return out.when(c > edges[-1], F.lit(labels[-1])) if len(labels) > len(edges) else out


def distance_band(distance: Column) -> Column:
    """sprint to 1200, mile to 1600, middle to 2200, long beyond; whole metres."""
    d = F.floor(distance.cast("double"))
    return F.coalesce(bands(d, [1200, 1600, 2200], ["sprint", "mile", "middle", "long"]), F.lit("unknown"))


def season_cycle(day: Column) -> dict[str, Column]:
    angle = F.dayofyear(day) * (2.0 * math.pi / 365.0)
    return {"cos_date": F.cos(angle), "sin_date": F.sin(angle), "season": season_code(day)}


def season_code(day: Column) -> Column:
    """0 for December to February, then 1, 2, 3."""
    return F.coalesce(F.floor(F.pmod(F.month(day), F.lit(12)) / 3).cast("int"), F.lit(0))


def sex_code(sex: Column) -> Column:
    return F.coalesce(lookup(sex, SEX_CODES), F.lit(0)).cast("double")


def surface_code(surface: Column) -> Column:
    return F.coalesce(lookup(surface, SURFACE_CODES), F.lit(0)).cast("double")


def one_hot(c: Column, categories: Sequence[str], prefix: str) -> list[Column]:
    """0/1 column per declared category, so the schema does not depend on the data."""
    return [F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in categories]


def age_bands(age: Column) -> list[Column]:
    def flag(cond):
        return F.coalesce(cond.cast("int"), F.lit(0))

    return [
        flag(age <= 3).alias("is_young"),
        flag(age.between(4, 6)).alias("is_prime"),
        flag(age >= 7).alias("is_veteran"),
    ]


def rest_class(days: Column) -> Column:
    return bands(days, [14, 30, 60], ["short", "normal", "long", "very_long"])


def rest_code(days: Column) -> Column:
    """0 for day 0, 1 to 21 days, 2 to 90, 3 beyond; negative values have none."""
    return F.when(days > -1, bands(days, [0, 21, 90], [0, 1, 2, 3]))


def ratio(value: Column, size: Column) -> Column:
    """value / size, null for size 0."""
    return value / F.nullif(size, F.lit(0))


def days_between(later: Column, earlier: Column) -> Column:
    """At least one day, else null."""
    d = F.datediff(later, earlier)
    return F.when(d >= 1, d)


def sign_flags(change: Column) -> tuple[Column, Column]:
    return (
        F.coalesce((change > 0).cast("int"), F.lit(0)),
        F.coalesce((change < 0).cast("int"), F.lit(0)),
    )


def career_rate(wins: Column, starts: Column) -> Column:
    return F.when(starts > 0, wins / starts)


def speed_index(distance: Column, seconds: Column) -> Column:
    return F.when((distance > 0) & (seconds > 0), distance / seconds)


def weighted_form(last: Column, second_last: Column) -> Column:
    return F.coalesce(0.6 * last + 0.4 * second_last, last.cast("double"), second_last.cast("double"))


def implied_prob(odds: Column) -> Column:
    return F.when(odds > 0, 1.0 / odds)


def payout_prob(payout: Column) -> Column:
    return F.when(payout > 0, 100.0 / payout)


def payout_log(payout: Column) -> Column:
    return F.log1p(F.coalesce(payout, F.lit(0.0)))


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def date_parts(day: Column, prefix: str) -> list[Column]:
    return [
        F.year(day).alias(f"{prefix}_year"),
        F.month(day).alias(f"{prefix}_month"),
        F.dayofmonth(day).alias(f"{prefix}_day"),
        F.weekday(day).alias(f"{prefix}_weekday"),
    ]


def surface_change(current: Column, previous: Column) -> Column:
    """1 when both surfaces are known and differ."""
    a, b = lookup(current, SURFACE_KINDS), lookup(previous, SURFACE_KINDS)
    return F.coalesce((a != b).cast("int"), F.lit(0))


def month_season(day: Column, names: Sequence[str] = ("冬", "春", "夏", "秋")) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), season_code(day))
