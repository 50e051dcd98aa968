"""Personal data: found, and replaced by keyed surrogates of the same type and format.

Each entity has a canonical form (an address in lower case, a number as its digits, a name without
its title). A surrogate is drawn from a keyed hash of type and canonical form, so all mentions of
an entity in all documents get the same one. Drawn surrogates are checked: none may be the
canonical form of a real entity of the corpus, and no two entities may share one; who loses draws
again until all are distinct. Mentions are written in the format they had: digit groups and their
separators, letter case, titles and script stay, and names keep the gender of title or first name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.secrets import free_name
from furlong.session import shared_dir

NAME = "op5_surrogates"
SQL = None
KEY = "furlong.llm.private.key"

# fixed values: titles and common first names by gender and script, and parts that invented names are made of
_TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Signora Госпожа госпожа г-жа".split(),
    "m": "Mr Herr Monsieur Señor Sr Signor Господин господин г-н".split(),
}
_FIRST = {
    ("f", "latin"): "Anna Maria Emma Julia Laura Sophie Claire Elena Carmen Lucía Ingrid Hannah Alice Marta Nadine Paula".split(),
    ("m", "latin"): "John Peter Paul Thomas Michael Pierre Hans Jürgen Carlos Miguel David Robert Stefan Luis Henri Oscar".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Михаил Андрей Николай".split(),
}
_SYLLABLES = {
    "latin": "ba den cor vel mar tin lo ras kem bur sal win der fos tal mon rek hal gis pa lin dor van sel".split(),
    "cyrillic": "ба ден кор вел мар тин ло рас кем бур сал вин дер фос тал мон рек хал гис па лин дор ван сел".split(),
}
_ENDS = {
    ("f", "latin"): ["ton", "er", "sen", "man"], ("m", "latin"): ["ton", "er", "sen", "man"],
    ("f", "cyrillic"): ["ова", "ина", "ева", "кина"], ("m", "cyrillic"): ["ов", "ин", "ев", "кин"],
}
_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_ANY_TITLE = "|".join(t for g in ("f", "m") for t in _TITLES[g])
_ANY_FIRST = "|".join(n for names in _FIRST.values() for n in names)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# what is found, in order: at one place the first kind that matches wins
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?<![A-Za-z0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![A-Za-z0-9]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])",
    "card": r"(?<![A-Za-z0-9+.-])\d(?:[\x20-]?\d){12,18}(?![A-Za-z0-9]|[.-]\d)",
    "phone": r"(?<![A-Za-z0-9+])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{1,4}(?:[\x20.-]?\d{2,4}){1,4}|\(?\d{3}\)?[\x20.-]\d{3}[\x20.-]\d{4})(?![A-Za-z0-9]|[.-]\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_ANY_TITLE})\.?\x20{_WORD}(?:\x20{_WORD})?|(?:{_ANY_FIRST})\x20{_WORD})(?![\p{{L}}\p{{N}}])",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_NUMBERS = ("ssn", "card", "phone")


def _gaps_and_mentions(text: Column) -> Column:
    """Array of (gap, mention, kind): each mention with the text between the one before and it."""
    whole = F.lit(rf"(?s)\G(.*?)({_ANY})")
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("mention")
    )

    def named(s: Column) -> Column:
        kind = reduce(
            lambda rest, k: F.when(s["mention"].rlike(rf"\A(?:{PATTERNS[k]})\z"), F.lit(k)).otherwise(rest),
            reversed(KINDS),
            F.lit("person"),
        )
        return F.struct(s["gap"].alias("gap"), s["mention"].alias("mention"), kind.alias("kind"))

    none = F.array().cast("array<struct<gap:string,mention:string,kind:string>>")
    return F.when(text.rlike(_ANY), F.transform(zipped, named)).otherwise(none)


def _gender(mention: Column) -> Column:
    female = [*_TITLES["f"], *_FIRST["f", "latin"], *_FIRST["f", "cyrillic"]]
    return F.when(F.regexp_extract(mention, r"^[^\s.]+", 0).isin(female), "f").otherwise("m")


def _script(mention: Column) -> Column:
    return F.when(mention.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _bare_name(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^(?:{_ANY_TITLE})\.?\x20", "")


def canonical(kind: Column, mention: Column) -> Column:
    """What makes two mentions the same entity. A person is gender, script and name, so that a title
    and a first name that say the same gender agree."""
    person = F.concat_ws(":", _gender(mention), _script(mention), _bare_name(mention))
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin(*_NUMBERS), F.regexp_replace(mention, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(mention, r"\x20", ""))
        .when(kind == "person", person)
        .otherwise(mention)
    )


# ---- drawing


def _draw(seed: Column, at: Column | int, sides: int) -> Column:
    """A number below sides: the at-th draw from the keyed hash in seed (64 hexadecimal digits)."""
    place = at if isinstance(at, Column) else F.lit(at)
    again = F.sha2(F.concat_ws("#", seed, place.cast("string")), 256)
    return F.conv(F.substring(again, 1, 12), 16, 10).cast("bigint") % sides


def _seed(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """Hash with the key before and after (the hash of a hash), so that it cannot be extended or tried without it."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), kind, form, attempt.cast("string")), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


_DIGITS = "0123456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_by_letter(form: Column, seed: Column) -> Column:
    """Digits become digits, letters letters of the same case, everything else stays."""

    def one(c: Column, i: Column) -> Column:
        digit = F.substring(F.lit(_DIGITS), (_draw(seed, i, 10) + 1).cast("int"), F.lit(1))
        letter = F.substring(F.lit(_LETTERS), (_draw(seed, i, 26) + 1).cast("int"), F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _luhn_digit(digits: Column) -> Column:
    """The check digit that makes digits followed by it valid."""
    turned = F.split(F.reverse(digits), "")

    def add(acc: Column, s: Column) -> Column:
        return acc + s

    doubled = F.transform(
        turned,
        lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(
            c.cast("int")
        ),
    )
    return ((10 - F.aggregate(doubled, F.lit(0), add) % 10) % 10).cast("string")


def _person(form: Column, seed: Column, attempt: int = 0) -> Column:
    """gender:script:name, with as many words as before. Each attempt adds a syllable, so the space grows."""
    parts = F.split(form, ":")
    gender, script, words = parts[0], parts[1], F.size(F.split(parts[2], " "))
    out = None
    for (g, s), firsts in _FIRST.items():
        syllables, ends = F.array(*map(F.lit, _SYLLABLES[s])), F.array(*map(F.lit, _ENDS[g, s]))
        pick = lambda a, n, k: F.element_at(a, (_draw(seed, k, n) + 1).cast("int"))
        last = F.initcap(
            F.concat(*[pick(syllables, len(_SYLLABLES[s]), k) for k in range(3)], *[pick(syllables, len(_SYLLABLES[s]), 100 + k) for k in range(attempt)], pick(ends, len(_ENDS[g, s]), 3))
        )
        first = pick(F.array(*map(F.lit, firsts)), len(firsts), 4)
        name = F.when(words > 1, F.concat_ws(" ", first, last)).otherwise(last)
        mine = (gender == g) & (script == s)
        out = F.when(mine, name) if out is None else out.when(mine, name)
    return F.concat_ws(":", gender, script, out)


def surrogate_form(kind: Column, form: Column, seed: Column, attempt: int = 0) -> Column:
    """A canonical form of the same type: addresses keep their last domain part, numbers their length
    and whether they begin with 0, cards their first digit and a valid check digit, IBANs their country.
    From the fifth attempt on, addresses grow by a letter each."""
    at = F.regexp_extract(form, r"^(.*)\.([^.]*)$", 1)
    more = [F.substring(F.lit(_LETTERS), (_draw(seed, 100 + k, 26) + 1).cast("int"), F.lit(1)) for k in range(attempt - 3)]
    email = F.concat(*more, _letter_by_letter(at, seed), F.lit("."), F.regexp_extract(form, r"\.([^.]*)$", 1))
    ip = F.concat_ws(".", *[(_draw(seed, k, 254) + 1).cast("string") for k in range(4)])
    digits = _letter_by_letter(form, seed)
    lead = F.when(form.startswith("0"), "0").otherwise((_draw(seed, 99, 9) + 1).cast("string"))
    number = F.concat(lead, F.substring(digits, F.lit(2), F.length(form)))
    body = F.concat(F.substring(form, 1, 1), F.substring(digits, F.lit(2), F.length(form) - 2))
    iban = F.concat(F.substring(form, 1, 2), F.substring(digits, F.lit(3), F.length(form)))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "iban", iban)
        .when(kind == "card", F.concat(body, _luhn_digit(body)))
        .when(kind == "person", _person(form, seed, attempt))
        .otherwise(number)
    )


def written_like(kind: Column, mention: Column, form: Column) -> Column:
    """The surrogate in the format of the mention: its separators, its title, its letter case."""
    chars = F.split(mention, "")
    plain = F.split(form, "")
    zero = F.struct(F.lit(0).alias("used"), F.lit("").alias("out"))

    def put(acc: Column, c: Column) -> Column:
        takes = F.when(kind == "iban", c != " ").otherwise(c.rlike("[0-9]"))
        return F.struct(
            F.when(takes, acc["used"] + 1).otherwise(acc["used"]).alias("used"),
            F.concat(acc["out"], F.when(takes, F.get(plain, acc["used"])).otherwise(c)).alias("out"),
        )

    grouped = F.aggregate(chars, zero, put, lambda acc: acc["out"])
    title = F.regexp_extract(mention, rf"^(?:{_ANY_TITLE})\.?\x20", 0)
    upper = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return (
        F.when(kind.isin(*_NUMBERS, "iban"), grouped)
        .when(kind == "person", F.concat(title, F.split(form, ":")[2]))
        .when((kind == "email") & upper, F.upper(form))
        .otherwise(form)
    )


def _shape(kind: Column, form: Column) -> Column:
    """What a surrogate keeps of a form whose space cannot grow."""
    spelled = F.regexp_replace(F.regexp_replace(form, "[0-9]", "0"), "[A-Z]", "A")
    lead = F.when(kind == "card", F.substring(form, 1, 1)).otherwise(form.startswith("0").cast("string"))
    return (
        F.when(kind == "iban", F.concat(F.substring(form, 1, 2), spelled))
        .when(kind.isin(*_NUMBERS), F.concat_ws(":", lead, F.length(form).cast("string")))
        .otherwise(kind)
    )


def _permuted(entities: DataFrame, done: DataFrame, left: DataFrame, key: str) -> DataFrame:
    """done, with all forms of the shapes of left anew: each gets the one after it in a keyed order."""
    shape = _shape(F.col("kind"), F.col("form"))
    full = left.select("kind", shape.alias("shape")).distinct()
    shaped = entities.select("kind", "form", shape.alias("shape"))
    turn = _seed(key, F.col("kind"), F.col("form"), F.lit("turn"))
    order = Window.partitionBy("kind", "shape").orderBy("turn", "form")
    own = shaped.join(full, ["kind", "shape"], "left_semi").withColumn("turn", turn)
    after = F.coalesce(F.lead("form").over(order), F.first("form").over(order))
    moved = own.select("kind", "form", after.alias("new"))
    if not moved.filter("new = form").isEmpty():
        raise ValueError("no free surrogates are left for some kind of entity")
    kept = done.withColumn("shape", shape).join(full, ["kind", "shape"], "left_anti")
    return kept.select("kind", "form", "new").unionByName(moved)


def surrogates(entities: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """(kind, form, new): entities are distinct (kind, form). One new form for each, all distinct and
    none of them a form of entities, but for numbers whose space is full.

    Every round draws for those without one, keeps a draw that is free (of equal draws, that of the
    least form) and writes the round to the shared folder. It ends when nobody is left: each draw is
    a fresh hash, and the spaces of names and addresses grow with the rounds, so they end at any size.
    Numbers keep their length, so real forms may fill their space (four-digit ones have 9,000). If some
    are left after the last round, all numbers of their shape are permuted among themselves by the key.
    """
    spark = entities.sparkSession
    folder = shared_dir(spark, "surrogates")
    entities.write.parquet(f"{folder}/entities")
    entities = spark.read.parquet(f"{folder}/entities")
    left, done = entities, None
    for attempt in range(rounds):
        seed = _seed(key, F.col("kind"), F.col("form"), F.lit(attempt))
        drawn = left.select("kind", "form", surrogate_form(F.col("kind"), F.col("form"), seed, attempt).alias("new"))
        free = drawn.join(entities.select("kind", F.col("form").alias("new")), ["kind", "new"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        won = free.groupBy("kind", "new").agg(F.min("form").alias("form")).select("kind", "form", "new")
        won.write.parquet(f"{folder}/won/round={attempt}")
        done = spark.read.schema("kind string, form string, new string").parquet(f"{folder}/won")
        left = entities.join(done.select("kind", "form"), ["kind", "form"], "left_anti")
        if left.isEmpty():
            return done.select("kind", "form", "new")
    return _permuted(entities, done, left, key)


def replace_private(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with each mention of an entity replaced, and a column n_<kind> bigint for each kind.

    All rows and columns stay; a null text stays null with counts of 0. A column of docs that already
    has the name of a count is replaced by it. A row looks its entities up by id and hash of its text,
    so repeated ids and null ids, however many, each get those of their own text.
    """
    spans, mine = free_name(docs, "_spans"), free_name(docs, "_news")
    found_id, found_hash = free_name(docs, "_found"), free_name(docs, "_hash")
    hashed = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), hashed.alias("h"), _gaps_and_mentions(F.col(text_col)).alias("s"))
    mentions = rows.select("id", "h", F.explode("s").alias("m")).select(
        "id", "h", F.col("m.kind").alias("kind"), F.col("m.mention").alias("mention")
    )
    forms = mentions.select("id", "h", "kind", canonical(F.col("kind"), F.col("mention")).alias("form")).distinct()
    folder = shared_dir(docs.sparkSession, "mentions")
    forms.write.parquet(folder)
    forms = docs.sparkSession.read.parquet(folder)
    news = surrogates(forms.select("kind", "form").distinct(), key)
    per_doc = forms.join(news, ["kind", "form"]).groupBy(F.col("id").alias(found_id), F.col("h").alias(found_hash)).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "form"), F.col("new")))).alias(mine)
    )
    out = docs.join(per_doc, F.col(id_col).eqNullSafe(F.col(found_id)) & (hashed == F.col(found_hash)), "left")
    out = out.withColumn(
        spans, F.when(F.col(mine).isNotNull(), _gaps_and_mentions(F.col(text_col))).otherwise(F.array().cast("array<struct<gap:string,mention:string,kind:string>>"))
    )

    def replaced(s: Column) -> Column:
        form = F.element_at(F.col(mine), F.concat_ws("|", s["kind"], canonical(s["kind"], s["mention"])))
        return F.concat(s["gap"], written_like(s["kind"], s["mention"], form))

    used = F.aggregate(
        F.col(spans), F.lit(0), lambda acc, s: acc + F.char_length(s["gap"]) + F.char_length(s["mention"])
    )
    tail = F.substring(F.col(text_col), used + 1, F.char_length(F.col(text_col)))
    text = F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, replaced), ""), tail)).otherwise(F.col(text_col))
    counts = [_count(spans, kind).alias(f"n_{kind}") for kind in KINDS]
    names = {f"n_{kind}" for kind in KINDS}
    kept = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in names]
    return out.select(*kept, *counts)


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_private(docs, spark.conf.get(KEY, "a key for tests only"))
