"""Two-level JSON documents: one per race, one per runner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.operators.joins import drop_flagged, parent_fill

CORRUPT = "_corrupt"


def parse_documents(df: DataFrame, schema: T.StructType, data: str = "data") -> DataFrame:
    """Parse a JSON text column into the declared fields; unreadable text is kept in _corrupt.

    The parsed document comes out of a generator, which a later filter on its fields does not pass, so
    each text is parsed once.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(data), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    names = [f.name for f in schema.fields]
    rest = [c for c in df.columns if c != data and c not in names]
    return df.select("*", F.explode(F.array(parsed)).alias("_doc")).select(
        *rest,
        *[F.col(f"_doc.{n}").alias(n) for n in names],
        F.when(F.col(data).isNull(), F.lit("")).otherwise(F.col(f"_doc.{CORRUPT}")).alias(CORRUPT),
    )


def no_nan(df: DataFrame) -> DataFrame:
    """NaN would spread through every mean; missing values are null only."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def scan_documents(
    race_docs: DataFrame,
    runner_docs: DataFrame,
    race_schema: T.StructType,
    runner_schema: T.StructType,
    race: str = "race_id",
    flag: str = "_invalid_distance",
) -> DataFrame:
    """Runner rows with race fields filled in; corrupt documents and all runners of flagged races are left out."""
    races = parse_documents(race_docs, race_schema).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    runners = parse_documents(runner_docs, runner_schema).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    flagged = races.filter(F.col(flag)).select(race)
    return no_nan(parent_fill(drop_flagged(runners, flagged, [race]), races.drop(flag), [race]))


def corrupt_count(docs: DataFrame, schema: T.StructType) -> DataFrame:
    return parse_documents(docs, schema).agg(
        F.count(F.lit(1)).alias("documents"), F.count(CORRUPT).alias("corrupt")
    )


# ---- keys that no schema declares

#: What a variant's type says, told coarsely: numbers of one key come as whole ones and decimals.
KINDS = {"BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "STRING": "text", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null"}
#: How a key of each kind is read; mixed kinds, objects and arrays stay variants.
READ_AS = {"number": "double", "text": "string", "boolean": "boolean"}


def as_variant(df: DataFrame, data: str = "data", out: str = "doc") -> DataFrame:
    """The text as a variant, parsed once; null where it is unreadable."""
    return df.select("*", F.explode(F.array(F.try_parse_json(data))).alias(out))


def key_profile(df: DataFrame, data: str = "data", declared: T.StructType | None = None) -> DataFrame:
    """(key, kind, documents): the keys at the top of the documents, by kind of value.

    With a declared schema only the keys outside it. Unreadable texts and documents that are no
    object have no key.
    """
    known = [f.name for f in declared.fields] if declared else []
    docs = as_variant(df.select(data), data).filter(F.col("doc").isNotNull()).select("doc")
    docs = docs.filter(F.schema_of_variant("doc").startswith("OBJECT"))
    pairs = docs.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("doc").outer())).filter(~F.col("key").isin(known))
    name = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return pairs.groupBy("key", F.coalesce(F.try_element_at(kinds, name), F.lit("other")).alias("kind")).agg(
        F.count(F.lit(1)).alias("documents")
    )


def parse_open(df: DataFrame, schema: T.StructType, data: str = "data", most: int = 1000) -> DataFrame:
    """parse_documents, and a column for every key outside the schema that occurs: typed where all of its values are
    of one kind (null aside), else a variant. At most ``most`` further keys, which is checked."""
    found: dict[str, set[str]] = {}
    rows = key_profile(df, data, schema).filter(F.col("kind") != "null").limit(len(KINDS) * most + 1).collect()
    for r in rows:
        found.setdefault(r["key"], set()).add(r["kind"])
    if len(found) > most:
        raise ValueError(f"more than {most} undeclared keys")
    # both readings come out of one generator each, so a text is parsed once for the schema and once for the rest
    declared = parse_documents(as_variant(df, data, "_open"), schema, data)
    read = []
    for key, kinds in sorted(found.items()):
        quote = "'" if "'" not in key else '"'
        if quote in key:
            raise ValueError(f"no path can name the key {key!r}")
        path = f"$[{quote}{key}{quote}]"
        read.append(F.try_variant_get("_open", path, READ_AS.get(next(iter(kinds)), "variant") if len(kinds) == 1 else "variant").alias(key))
    return declared.select(*[F.col(c) for c in declared.columns if c != "_open"], *read)
