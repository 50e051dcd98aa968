"""Merging new rows into stored ones, exports and snapshots."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Insert or replace by key, the last version wins; equal versions are settled by the row's values.

    Taken as the maximum of (version, row), which combines before the shuffle, so that
    many copies of one key stay cheap.
    """
    rows = existing.unionByName(incoming)
    rest = [c for c in rows.columns if c not in keys and c not in version]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*version, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in rows.columns])


def replace_children(existing: DataFrame, incoming: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Drop the stored children of every parent that arrives, then add what arrived."""
    arrived = incoming.select(*parent).distinct()
    return existing.join(arrived, list(parent), "left_anti").unionByName(incoming)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions that df has rows for."""
    (
        df.repartition(*by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def export_prefix(races: DataFrame, runners: DataFrame, key: str, prefix_of: str, prefix: str, limit: int) -> DataFrame:
    """Runners of the first ``limit`` races whose text field starts with the prefix."""
    chosen = races.filter(F.col(prefix_of).startswith(prefix)).orderBy(key).limit(limit).select(key)
    return runners.join(chosen, key, "left_semi")


def full_copy(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Copy a table to another store as (keys, data) with each row as JSON text, and read it back."""
    rest = [c for c in df.columns if c not in keys]
    df.select(*keys, F.to_json(F.struct(*rest)).alias("data")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def bet_csv(df: DataFrame, path: str, columns: Sequence[str], separator: str = " / ") -> None:
    """CSV of bets in a fixed column order, list columns joined to text."""
    lists = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    out = df.select(*[F.array_join(c, separator).alias(c) if c in lists else F.col(c) for c in columns])
    out.write.mode("overwrite").csv(path, header=True)


def downcast(df: DataFrame) -> DataFrame:
    """Doubles and longs to four bytes where every value fits; one pass finds out."""
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    fits = [
        F.coalesce(F.max(F.abs(F.col(c))) < 2147483648, F.lit(True)).alias(c) for c in longs
    ]
    narrow = df.agg(*fits).first() if longs else {}
    casts = {c: F.col(c).cast("int") for c in longs if narrow[c]}
    casts |= {c: F.col(c).cast("float") for c in doubles}
    return df.withColumns(casts) if casts else df


def fingerprint(df: DataFrame, stages: Sequence[Callable | str] = ()) -> str:
    """A name for what df is made of: its schema, the stages (by source, or as given), and its input files
    by path, length and time of change. Frames without files are told apart by schema and stages only."""
    told = [s if isinstance(s, str) else inspect.getsource(s) for s in stages]
    files = df.inputFiles()
    if files:
        # file attributes only, contents are not read; the sum does not depend on the order
        found = df.sparkSession.read.format("binaryFile").load(files)
        row = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        told.append(str(tuple(found.agg(F.count(F.lit(1)), F.sum(row)).first())))
    return hashlib.sha256("\n".join([df.schema.json(), *told]).encode()).hexdigest()[:20]


def feature_cache(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], narrow: bool = True, stages: Sequence[Callable | str] = ()
) -> DataFrame:
    """The snapshot of build() below path; written first if there is none for its present fingerprint.

    build only declares the frame. A change of the inputs, the columns or the stages makes another
    snapshot; one that was not written to its end counts as none.
    """
    df = build()
    place = f"{path.rstrip('/')}/snapshot-{fingerprint(df, stages)}"
    files, root = pafs.FileSystem.from_uri(place)
    if files.get_file_info(f"{root}/_SUCCESS").type == pafs.FileType.NotFound:
        (downcast(df) if narrow else df).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
