"""Secret scans with a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams: a list of clauses that must all
hold, each a list of alternatives, each a set of trigrams that must all occur. The index has a
posting (trigram, document) for every trigram that some rule asks for. Intersecting the postings
gives candidate documents; the regex is run on those only. A rule without a mandatory trigram is
run on every document.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "op1_secret_scan"
_WIDEST = 64


@dataclass(frozen=True)
class Rule:
    """pattern: in the dialect Python and Java share, without back references or look-around at its
    ends. group, least: matches whose group is shorter than least characters are dropped after the
    search, so they still use up the text they cover."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# fixed values of the contract, then the rules that this scan adds
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@"),
)
RULES = BASE_RULES + MORE_RULES


# ---- from a regex to its trigram query


class _Strings:
    """What a part of a regex can match, if that is a short list of strings; None stands for anything."""

    @staticmethod
    def product(a: set[str] | None, b: set[str] | None) -> set[str] | None:
        if a is None or b is None or len(a) * len(b) > _WIDEST:
            return None
        return {x + y for x in a for y in b}


def _exact(node) -> set[str] | None:
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN and len(arg) <= 8 and all(x[0] is C.LITERAL for x in arg):
        return {chr(x[1]).lower() for x in arg}
    if op is C.SUBPATTERN:
        return _exact_all(arg[3])
    if op is C.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
        one, out = _exact_all(arg[2]), set()
        for n in range(arg[0], arg[1] + 1):
            got = reduce(_Strings.product, [one] * n, {""})
            if got is None:
                return None
            out |= got
        return out
    return None


def _exact_all(nodes) -> set[str] | None:
    return reduce(_Strings.product, (_exact(n) for n in nodes), {""})


def _clauses(nodes) -> list[list[frozenset[str]]]:
    out: list[list[frozenset[str]]] = []
    run: set[str] = {""}

    def close() -> None:
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(run)]
        if all(grams):
            # an alternative that asks for more than another one adds nothing
            out.append([g for k, g in enumerate(grams) if not any(h < g or (h == g and j < k) for j, h in enumerate(grams))])

    for node in nodes:
        got = _exact(node)
        longer = _Strings.product(run, got)
        if longer is not None:
            run = longer
            continue
        close()
        run = {""} if got is None else got
        if got is None:
            op, arg = node
            if op is C.SUBPATTERN:
                out += _clauses(arg[3])
            elif op is C.MAX_REPEAT and arg[0] > 0:
                out += _clauses(arg[2])
            elif op is C.BRANCH:
                sides = [_clauses(x) for x in arg[1]]
                if all(sides):  # one clause of each side, the first, keeps this a list of clauses
                    out.append([g for side in sides for g in side[0]])
    close()
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that every match satisfies, over lower-case text; none if nothing is mandatory.

    Strings are extended over neighbouring nodes while their list stays short, so for
    ``api_?key=`` the alternatives are the trigrams of both spellings.
    """
    return _clauses(list(_parser.parse(pattern)))


# ---- index, intersection, verification


def _branches(rules: Sequence[Rule]) -> list[tuple[int, int, int, str, int]]:
    """(rule, clause, alternative, trigram, trigrams of the alternative)"""
    return [
        (r, c, a, t, len(grams))
        for r, rule in enumerate(rules)
        for c, clause in enumerate(trigram_query(rule.pattern))
        for a, grams in enumerate(clause)
        for t in sorted(grams)
    ]


def postings(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, id) for each trigram that the rules ask for and each row that has it."""
    wanted = sorted({b[3] for b in _branches(rules)})
    low = docs.select(F.col(id_col), F.lower(F.col(text_col)).alias("_low"))
    found = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col("_low"), t))
    return low.filter(F.col("_low").isNotNull()).select(F.explode(found).alias("trigram"), id_col)


def candidates(index: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id") -> DataFrame:
    """(id, rules): intersect the postings of each alternative, then of the clauses of each rule."""
    spark = index.sparkSession
    rows = _branches(rules)
    terms = spark.createDataFrame(rows, "rule int, clause int, alt int, trigram string, n_alt int")
    clauses = {r: len(trigram_query(rule.pattern)) for r, rule in enumerate(rules)}
    asked = F.create_map(*[F.lit(x) for pair in clauses.items() for x in pair])
    whole = (
        index.join(F.broadcast(terms), "trigram")  # a few rows for each rule
        .groupBy(id_col, "rule", "clause", "alt", "n_alt")
        .agg(F.count_distinct("trigram").alias("n"))
        .filter("n = n_alt")
    )
    met = whole.groupBy(id_col, "rule").agg(F.count_distinct("clause").alias("n"))
    met = met.filter(F.col("n") == asked[F.col("rule")])
    return met.groupBy(id_col).agg(F.collect_set("rule").alias("rules"))


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans of the rule in text, as structs (start, order, kind, end), in code points.

    Each match is found together with the gap before it; starts are sums of the lengths so far.
    ``\\G`` keeps the search from being tried again at every place after the last match.
    """
    groups = re.compile(rule.pattern).groups
    whole = F.lit(rf"(?s)\G(.*?)({rule.pattern})")
    pieces = [F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))]
    if rule.group:
        assert rule.group <= groups
        pieces.append(F.regexp_extract_all(text, whole, F.lit(2 + rule.group)))
    steps = F.arrays_zip(*[p.alias(f"p{i}") for i, p in enumerate(pieces)])
    steps = F.transform(
        steps,
        lambda s: F.struct(
            F.char_length(s["p0"]).cast("bigint").alias("gap"),
            F.char_length(s["p1"]).cast("bigint").alias("size"),
            F.char_length(s["p2" if rule.group else "p1"]).alias("judged"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans"))

    def take(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + s["size"]
        one = F.struct(
            start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")
        )
        spans = F.when(s["judged"] >= rule.least, F.array_append(acc["spans"], one)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(steps, zero, take, lambda acc: acc["spans"])


def _guard(rule: Rule) -> str:
    """A regex that is quick to try and holds wherever the rule has a match that it keeps."""
    plain = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{plain[1]}{{{rule.least}}}" if plain and rule.least else rule.pattern


_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _with_spans(docs: DataFrame, rules: Sequence[Rule], id_col: str, text_col: str, name: str) -> DataFrame:
    """docs and, in the column name, the spans of its text."""
    key, hits = free_name(docs, "_found"), free_name(docs, "_rules")
    found = candidates(postings(docs, rules, id_col, text_col), rules, id_col)
    found = found.select(F.col(id_col).alias(key), F.col("rules").alias(hits))
    rows = docs.join(found, F.col(id_col).eqNullSafe(F.col(key)), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = []
    for k, rule in enumerate(rules):
        todo = text.rlike(_guard(rule))
        if trigram_query(rule.pattern):
            todo = F.coalesce(F.array_contains(hits, k), F.lit(False)) & todo
        spans.append(F.when(todo, _matches(text, rule, k)).otherwise(F.array().cast(_SPANS)))
    return rows.withColumn(name, F.array_sort(F.flatten(F.array(*spans)))).drop(key, hits)


def scan(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text, spans array<struct<start, rank, kind, end>>), one row per input row, spans by start, then rule.

    Rows meet their candidates by a join on the id; a null id matches itself there. A null text is
    empty and has no span. Rows that share an id share their candidates, and each is verified by
    itself, so repeated rows and ids are right. Other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return _with_spans(rows, rules, id_col, text_col, "spans")


def redact(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with each span that scan() finds replaced by ``[secret:<kind>]``; overlapping spans become
    one, named after the first. All rows and all other columns stay as they are, a null text too."""
    name = free_name(docs, "_spans")
    rows, text = _with_spans(docs, rules, id_col, text_col, name), F.col(text_col)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        between = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        added = F.concat(acc["out"], between, F.lit("[secret:"), s["kind"], F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], added).otherwise(acc["out"]).alias("out")
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.char_length(text)))

    clean = F.when(F.size(name) > 0, F.aggregate(F.col(name), zero, put, finish)).otherwise(text)
    return rows.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def _count_of(rank: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")


def _spelled(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [_count_of(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select(
        "doc_id", *counts, F.sha2(_spelled(base), 256).alias("base_sha256"), _spelled(F.col("spans")).alias("spans")
    )


def _sql_spans(rule: Rule, order: int) -> str:
    """DuckDB: the rule's spans as rows (doc_id, start, rank, kind, end)."""
    pattern = rf"(?s)(.*?)({rule.pattern})".replace("'", "''")
    judged = 2 + rule.group if rule.group else 2
    return f"""SELECT doc_id, total - size AS s, {order} AS rank, '{rule.kind}' AS kind, total AS e FROM (
        SELECT doc_id, size, judged, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM (
            SELECT doc_id, generate_subscripts(g, 1) AS i, unnest([length(x) for x in g]) AS gap,
                unnest([length(x) for x in m]) AS size, unnest([length(x) for x in j]) AS judged
            FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 1) AS g, regexp_extract_all(t, '{pattern}', 2) AS m,
                regexp_extract_all(t, '{pattern}', {judged}) AS j FROM texts))) WHERE judged >= {rule.least}"""


SQL = f"""
WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS MATERIALIZED ({" UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
told AS (SELECT doc_id, rank, s, kind || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM spans),
sums AS (
    SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
        count(*) FILTER (rank = 2) AS n_hex, string_agg(x, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
        string_agg(x, ',' ORDER BY s, rank) AS spans
    FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN sums USING (doc_id)
"""
