"""Facts in page bodies, found by ordered patterns over the whole text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of pages that refuse the visitor, and the least length of a body.
BLOCK_MARKS = ["forbidden", "access denied", "cloudflare"]
MIN_BODY = 80

# Odds cells per bet type: runner numbers in the first cell, odds in the second.
ODDS_CELL = r'<td[^>]*>({numbers})</td>\s*<td[^>]*class="oddsvalue"[^>]*>([0-9.]+)'
ODDS_NUMBERS = {1: r"[0-9]+", 2: r"[0-9]+,[0-9]+", 3: r"[0-9]+,[0-9]+,[0-9]+"}


def page_valid(html: Column, marks: Sequence[str] = BLOCK_MARKS) -> Column:
    body = F.trim(F.coalesce(html, F.lit("")))
    ok = F.length(body) >= MIN_BODY
    for m in marks:
        ok = ok & ~F.lower(body).contains(m)
    return ok.cast("int")


def found_ids(html: Column, patterns: Sequence[str]) -> Column:
    """All first groups of all patterns, each once, sorted."""
    hits = [F.regexp_extract_all(html, F.lit(p), 1) for p in patterns]
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*hits)), lambda x: x != "")))


# Bet types by how many runners they name and whether their order counts.
BET_ODDS = {"win": (1, True), "quinella": (2, False), "exacta": (2, True), "trio": (3, False), "trifecta": (3, True)}


def two_digits(n: Column) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def odds_of_bet(html: Column, bet_type: str) -> Column:
    """Odds of a bet type by key; a key that the page shows again has its last odds.

    Cells are sorted by key and place, so the last one of a key stands before another key: a page of n cells
    takes n log n steps. The sorted cells are bound as one value, else every step would read the page again.
    """
    cells = odds_cells(html, *BET_ODDS[bet_type])
    numbered = F.transform(cells, lambda c, i: F.struct(c["key"].alias("key"), i.alias("at"), c["odds"].alias("odds")))

    def last(by_key: Column) -> Column:
        kept = F.filter(by_key, lambda c, i: ~F.coalesce(F.get(by_key, i + 1)["key"] == c["key"], F.lit(False)))
        return F.sort_array(F.transform(kept, lambda c: F.struct(c["at"].alias("at"), c["key"].alias("key"), c["odds"].alias("odds"))))

    found = F.get(F.transform(F.array(F.sort_array(numbered)), last), F.lit(0))
    return F.transform(found, lambda c: F.struct(c["key"].alias("key"), c["odds"].alias("odds")))


def odds_cells(html: Column, legs: int, ordered: bool) -> Column:
    """Array of (key, odds); keys are two-digit runner numbers, sorted where order does not matter."""
    pattern = F.lit("(?i)" + ODDS_CELL.format(numbers=ODDS_NUMBERS[legs]))
    keys = F.regexp_extract_all(html, pattern, 1)
    odds = F.regexp_extract_all(html, pattern, 2)

    def key(k: Column) -> Column:
        numbers = F.transform(F.split(k, ","), lambda x: x.cast("decimal(38,0)"))
        return F.array_join(F.transform(numbers if ordered else F.sort_array(numbers), two_digits), ",")

    return F.transform(
        F.arrays_zip(keys.alias("k"), odds.alias("o")),
        lambda e: F.struct(key(e["k"]).alias("key"), e["o"].try_cast("double").alias("odds")),
    )


def first_field(text: Column, patterns: Sequence[str]) -> Column:
    """First group of the first pattern that is found, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def page_fields(html: Column, rules: Mapping[str, Sequence[str]]) -> list[Column]:
    return [first_field(html, patterns).alias(name) for name, patterns in rules.items()]
