"""Arriving documents, odds and job events as Structured Streaming.

Sinks write one folder per micro-batch below the given path. A batch that is repeated
after a failure overwrites its own folder, so every row is counted once; readers take
the newest row per key. Given a KeyedTable, a sink adds its batches to that table instead, whose
runs are compacted as they pile up. Nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from furlong.operators.joins import latest
from furlong.sources.documents import CORRUPT, parse_documents
from furlong.sources.keyed import KeyedTable

BATCH = "batch_id"


def read_files(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def _append_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str, once: bool, table: KeyedTable | None = None,
    version: Sequence[str] = (), expire: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        if table:
            table.append(batch, number, version, expire)
            return
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(full).option("basePath", path).parquet(path)


def ingest(
    stream: DataFrame,
    schema: T.StructType,
    path: str,
    checkpoint: str,
    data: str = "data",
    once: bool = False,
    table: KeyedTable | None = None,
    version: Sequence[str] = (),
) -> StreamingQuery:
    """Parse arriving documents; good rows go to the table or path/rows, unreadable ones to path/corrupt.

    Rows are appended and merged on read (``ingested``, or the table's ``current``), so a batch costs its
    own size, not that of the table.
    """
    parsed = parse_documents(stream, schema, data)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            good = batch.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
            if table:
                table.append(good, number, version)
            else:
                good.write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={number}")
            batch.filter(F.col(CORRUPT).isNotNull()).write.mode("overwrite").parquet(
                f"{path}/corrupt/{BATCH}={number}"
            )
        finally:
            batch.unpersist()

    writer = parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingested(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: Sequence[str]
) -> DataFrame:
    """The table the ingested batches add up to: the last version of every key."""
    rows = read_batches(spark, f"{path}/rows", schema)
    return latest(rows, keys, [*version, BATCH]).drop(BATCH)


def latest_odds(
    stream: DataFrame, keys: Sequence[str], time: str, value: str, path: str, checkpoint: str, ttl: int = 300, once: bool = False,
    table: KeyedTable | None = None,
) -> StreamingQuery:
    """Newest value per key and ttl window; the state of a window goes when the watermark passes it.

    A table holds the newest value of each key, and forgets at its merges keys older than ttl before the
    newest of the merged rows; reading it costs the live keys, not the batches that there were.
    """
    per_window = (
        stream.withWatermark(time, f"{ttl} seconds")
        .groupBy(*keys, F.window(time, f"{ttl} seconds"))
        .agg(F.max(F.struct(time, value)).alias("_l"))
        .select(*keys, F.col(f"_l.{time}").alias(time), F.col(f"_l.{value}").alias(value))
    )
    return _append_batches(per_window, path, checkpoint, "update", once, table, [time], lambda rows: _alive(rows, time, ttl))


def _alive(rows: DataFrame, time: str, ttl: int) -> DataFrame:
    return rows.filter(F.col(time) > rows.agg(F.max(time)).scalar() - F.expr(f"INTERVAL {ttl} SECONDS"))


def odds_now(table: KeyedTable, time: str, ttl: int = 300) -> DataFrame:
    """The newest value of each key, without those older than ttl before the newest of all."""
    return _alive(table.current([time]), time, ttl)


def current_odds(rows: DataFrame, keys: Sequence[str], time: str, ttl: int = 300) -> DataFrame:
    """What ``latest_odds`` wrote, newest per key, without entries older than ttl before the newest of all."""
    newest = latest(rows, keys, [time, BATCH]).drop(BATCH)
    now = rows.agg(F.max(time)).scalar()
    return newest.filter(F.col(time) > now - F.expr(f"INTERVAL {ttl} SECONDS"))


def window_counts(df: DataFrame, time: str, kind: str, size: str, slide: str | None = None) -> DataFrame:
    """Events per window and kind; the same for a stream and for a table."""
    return (
        df.groupBy(F.window(time, size, slide or size).alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("events"), F.sum((F.col(kind) == "error").cast("bigint")).alias("errors"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "events", "errors")
    )


def stream_window_counts(
    stream: DataFrame, time: str, kind: str, size: str, slide: str | None, late: str, path: str, checkpoint: str, once: bool = False,
    table: KeyedTable | None = None,
) -> StreamingQuery:
    """Window counts of a stream; rows later than ``late`` are dropped. A table by window and kind holds the last counts."""
    counts = window_counts(stream.withWatermark(time, late), time, kind, size, slide)
    return _append_batches(counts, path, checkpoint, "update", once, table)


def final_counts(rows: DataFrame, kind: str) -> DataFrame:
    return latest(rows, ["window_start", "window_end", kind], [BATCH]).drop(BATCH)


def dedupe(
    stream: DataFrame, keys: Sequence[str], time: str, late: str, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Deliveries with a key seen within the watermark are ignored."""
    once_only = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return _append_batches(once_only, path, checkpoint, "append", once)


def idempotency_key(*fields: str):
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
