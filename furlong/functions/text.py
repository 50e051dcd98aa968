"""Reading dirty text: numbers, clock times, dates, ids, composite cells. Column in, Column out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that stand for "no number", among them scratched, did not
# start, pulled up, excluded and disqualified.
SCRATCH_TOKENS = ["取消", "欠場", "中止", "除外", "失格", "取", "-", "---", "計不", ""]

# Text that a missing value turns into on its way through files.
NULL_TEXTS = ["", "None", "nan"]

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Accepted date layouts, tried in this order.
DATE_LAYOUTS = ["yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy-MM-dd'T'HH:mm:ss"]


def known(c: Column) -> Column:
    """Trimmed text, null where it only says that there is nothing."""
    t = F.trim(c)
    return F.when(~t.isin(NULL_TEXTS), t)


def first_known(aliases: Mapping[str, Column]) -> tuple[Column, Column]:
    """First non-null of several alias columns, and the name of the alias that gave it."""
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in aliases.items()])
    return F.coalesce(*aliases.values()), source


def number_or_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~t.isin(SCRATCH_TOKENS) & t.rlike(_NUMBER), t.try_cast("double"))


def int_or_null(c: Column) -> Column:
    """Whole part of a lenient number; null beyond the integer range."""
    v = number_or_null(c)
    return F.when(F.abs(v) < 2147483648.0, v.cast("int"))


def clock_to_seconds(c: Column) -> Column:
    """ "1:34.5" or "94.5" in seconds."""
    t = F.trim(c)
    pattern = r"^([0-9]+):([0-9]+)(\.[0-9]+)?$"
    minutes = F.regexp_extract(t, pattern, 1).try_cast("double")
    seconds = F.regexp_extract(t, pattern, 2).try_cast("double")
    fraction = F.coalesce(F.concat(F.lit("0"), F.regexp_extract(t, pattern, 3)).try_cast("double"), F.lit(0.0))
    return F.when(t.rlike(pattern), minutes * 60 + seconds + fraction).otherwise(number_or_null(t))


def date_any_format(c: Column, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """YYYYMMDD from the first layout that fits."""
    t = F.substring(F.trim(c), 1, 19)
    return F.date_format(F.coalesce(*[F.try_to_timestamp(t, F.lit(x)) for x in layouts]), "yyyyMMdd")


def month_end_bound(c: Column) -> Column:
    """Exclusive upper bound of a YYYYMM month: the first day of the next one, as YYYYMMDD."""
    first = F.try_to_timestamp(F.concat(F.trim(c), F.lit("01")), F.lit("yyyyMMdd")).cast("date")
    return F.date_format(F.add_months(first, 1), "yyyyMMdd")


def split_sex_age(c: Column) -> tuple[Column, Column]:
    """First character and trailing digits."""
    t = F.trim(c)
    sex = F.when(F.length(t) > 0, F.substring(t, 1, 1))
    return sex, F.regexp_extract(t, r"([0-9]+)$", 1).try_cast("int")


def split_weight(c: Column) -> tuple[Column, Column]:
    """ "514(+6)" as body weight and change; markup inside the cell is ignored."""
    t = F.trim(F.regexp_replace(c, r"<[^>]+>", ""))
    pattern = r"^([0-9]+)(\(([+-]?[0-9]+)\))?"
    return (
        F.regexp_extract(t, pattern, 1).try_cast("int"),
        F.regexp_extract(t, pattern, 3).try_cast("int"),
    )


def split_corners(c: Column) -> Column:
    """ "7-7-2-2" as an integer array; parts that are not digits are dropped, no text is an empty array."""
    parts = F.split(F.coalesce(c, F.lit("")), "-")
    return F.transform(
        F.filter(parts, lambda x: F.trim(x).rlike("^[0-9]+$")), lambda x: F.trim(x).try_cast("int")
    )


def decode(c: Column, names: Mapping[str, str], pad: int = 0) -> Column:
    """Name of a code, the text itself where the code is unknown."""
    t = F.trim(c)
    key = F.when(t.rlike("^[0-9]+$"), F.lpad(t, pad, "0")).otherwise(t) if pad else t
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), t)


def id_from_url(ident: Column, url: Column, name: Column) -> Column:
    """The id if there is one, else the last path segment of the URL, else the name."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    tail = F.regexp_extract(path, r"/([A-Za-z0-9]+)/?$", 1)
    return F.coalesce(known(ident), F.when(tail != "", tail), name)


def normalise_url(url: Column) -> Column:
    """Scheme, query, fragment, leading www. or m. and closing slash do not distinguish pages."""
    bare = F.regexp_replace(F.lower(url), r"^https?://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"^(www|m)\.", "")
    return F.regexp_replace(bare, r"/+$", "")


def id_parts(race_id: Column, date: tuple[int, int], venue: tuple[int, int], length: int = 12) -> dict[str, Column]:
    """Fixed positions of a race id; the race number is its last two digits, 1 to 12.

    Id layouts differ between sources, so the positions (start, length) are given.
    """
    t = F.trim(race_id)
    whole = (F.length(t) == length) & t.rlike("^[0-9]+$")
    number = F.right(t, F.lit(2)).try_cast("int")
    return {
        "id_date": F.when(whole, F.substring(t, *date)),
        "id_venue": F.when(whole, F.substring(t, *venue)),
        "id_race_number": F.when(t.rlike("[0-9]{2}$") & number.between(1, 12), number),
    }


def placeholder_name(name: Column, ident: Column, unknown: str = "[不明馬]") -> Column:
    """ "[id]" for a blank name, a fixed label if the id is blank as well."""
    return F.coalesce(
        F.when(known(name).isNotNull(), name),
        F.concat(F.lit("["), known(ident), F.lit("]")),
        F.lit(unknown),
    )


def yen(c: Column) -> Column:
    """Digits of a money cell as an integer, 0 if there are none."""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def version_key(c: Column) -> Column:
    """ "2.0.1" as an array of three integers that compares in version order."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\.")
    return F.array(*[F.coalesce(F.get(parts, i).try_cast("int"), F.lit(0)) for i in range(3)])
