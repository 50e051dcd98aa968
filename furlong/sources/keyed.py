"""Tables that are stored in buckets of their key and change bucket by bucket.

A table is a folder. ``parts/<run>/_bucket=<n>`` holds the rows that one write brought to one bucket, a run;
``manifests/<version>.json`` says which runs each bucket consists of. A change writes new runs, then one new
manifest, in a single file that appears at once; readers take the manifest of the highest version. So

* a merge reads and writes only the buckets that the incoming rows fall into; other files stay as they are;
* micro-batches append small runs, and a bucket with more than ``max_runs`` of them is merged into one
  (each row is then rewritten about once per max_runs batches, and reading stays bounded);
* a write that dies leaves runs that no manifest names: nothing is lost and nothing is seen twice;
* a batch number that the manifest knows is not applied again.

One writer at a time; a second one that finishes first makes the other fail, as versions are never
overwritten. ``vacuum`` removes runs and manifests that are no longer needed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.operators.joins import latest
from furlong.sources.sinks import replace_children, upsert_latest

BUCKET = "_bucket"
#: How a run is told from a later one with equal versions.
RUN = "_run"


class KeyedTable:
    """keys decide the bucket, and equal keys the row; bucket_by are the keys that decide the bucket (all by
    default). The number of buckets is fixed when the table is made: take about one per gigabyte."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64,
        max_runs: int = 8, bucket_by: Sequence[str] | None = None,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.max_runs, self.bucket_by = list(keys), max_runs, list(bucket_by or keys)
        self.files, self.root = pafs.FileSystem.from_uri(self.path)
        self.files.create_dir(f"{self.root}/manifests", recursive=True)
        self.buckets = self.manifest()["buckets"] or buckets

    # ---- manifests

    def _versions(self) -> list[int]:
        found = self.files.get_file_info(pafs.FileSelector(f"{self.root}/manifests"))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def manifest(self) -> dict:
        """version, buckets, runs (by bucket, oldest first) and the last batch."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "buckets": 0, "runs": {}, "batch": None}
        with self.files.open_input_stream(f"{self.root}/manifests/{versions[-1]:012d}.json") as f:
            return json.loads(f.read())

    def _commit(self, before: dict, runs: dict[str, list[str]], batch: int | None) -> None:
        after = {"version": before["version"] + 1, "buckets": self.buckets, "runs": runs, "batch": before["batch"] if batch is None else batch}
        place = f"{self.root}/manifests/{after['version']:012d}.json"
        if self.files.get_file_info(place).type != pafs.FileType.NotFound:
            raise RuntimeError(f"version {after['version']} of {self.path} was written by someone else")
        draft = f"{self.root}/manifests/{uuid.uuid4().hex}.draft"
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps(after).encode())
        self.files.move(draft, place)

    # ---- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        """Stored rows of the buckets, with the place of their run in the bucket's list."""
        by_place: dict[int, list[str]] = {}
        for b, runs in manifest["runs"].items():
            if buckets is None or b in buckets:
                for k, run in enumerate(runs):
                    by_place.setdefault(k, []).append(f"{self.path}/parts/{run}/{BUCKET}={b}")
        full = T.StructType([*self.schema.fields, T.StructField(RUN, T.IntegerType())])
        out = None
        for k, paths in sorted(by_place.items()):
            rows = self.spark.read.schema(self.schema).parquet(*paths).withColumn(RUN, F.lit(k))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], full) if out is None else out

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """A run of the rows, and the buckets that have any. Rows of a bucket go to a few tasks, by key."""
        run = uuid.uuid4().hex[:16]
        rows = rows.select(*self.schema.names).withColumn(BUCKET, self._bucket())
        deal = F.pmod(F.xxhash64(*self.keys), F.lit(4))
        rows.repartition(BUCKET, deal).write.partitionBy(BUCKET).parquet(f"{self.path}/parts/{run}")
        found = self.files.get_file_info(pafs.FileSelector(f"{self.root}/parts/{run}"))
        return run, [f.base_name.split("=", 1)[1] for f in found if f.base_name.startswith(f"{BUCKET}=")]

    def rows(self) -> DataFrame:
        """All stored rows, those that newer ones of their key will replace included."""
        return self._rows(self.manifest()).drop(RUN)

    def current(self, version: Sequence[str] = ()) -> DataFrame:
        """The last version of every key; of equal versions the one that was written last."""
        return latest(self._rows(self.manifest()), self.keys, [*version, RUN]).drop(RUN)

    # ---- changes

    def rewrite(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
        """Replace the buckets that incoming falls into by merge(their rows, incoming); returns these buckets."""
        before = self.manifest()
        # at most one row per bucket
        touched = sorted(str(r[0]) for r in incoming.select(self._bucket().alias("b")).distinct().collect())
        if not touched:
            return []
        run, filled = self._write(merge(self._rows(before, touched).drop(RUN), incoming))
        runs = {b: r for b, r in before["runs"].items() if b not in touched} | {b: [run] for b in filled}
        self._commit(before, runs, None)
        return touched

    def append(self, batch: DataFrame, number: int, version: Sequence[str] = (), expire: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Add a micro-batch as a run; buckets with too many runs are merged. False if the batch is known.

        expire filters the rows that a merged bucket keeps.
        """
        before = self.manifest()
        if before["batch"] is not None and number <= before["batch"]:
            return False
        run, filled = self._write(batch)
        runs = {b: list(r) for b, r in before["runs"].items()}
        for b in filled:
            runs.setdefault(b, []).append(run)
        self._commit(before, runs, number)
        self.compact(version, self.max_runs, expire)
        return True

    def compact(self, version: Sequence[str] = (), max_runs: int = 1, expire: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
        """Merge the buckets with more than max_runs runs into one run each; returns these buckets."""
        before = self.manifest()
        full = sorted(b for b, r in before["runs"].items() if len(r) > max_runs)
        if not full:
            return []
        kept = latest(self._rows(before, full), self.keys, [*version, RUN]).drop(RUN)
        run, filled = self._write(expire(kept) if expire else kept)
        runs = {b: r for b, r in before["runs"].items() if b not in full} | {b: [run] for b in filled}
        self._commit(before, runs, None)
        return full

    def vacuum(self, versions: int = 2) -> int:
        """Remove runs that none of the last versions names, and older manifests; returns how many runs went."""
        known = self._versions()
        kept, used = known[-versions:], set()
        for v in kept:
            with self.files.open_input_stream(f"{self.root}/manifests/{v:012d}.json") as f:
                used |= {run for runs in json.loads(f.read())["runs"].values() for run in runs}
        gone = 0
        for f in self.files.get_file_info(pafs.FileSelector(f"{self.root}/parts", allow_not_found=True)):
            if f.base_name not in used:
                self.files.delete_dir(f.path)
                gone += 1
        for v in known[:-versions]:
            self.files.delete_file(f"{self.root}/manifests/{v:012d}.json")
        return gone


def upsert_into(table: KeyedTable, incoming: DataFrame, version: Sequence[str]) -> list[str]:
    """Insert or replace by key, the last version wins (see sinks.upsert_latest), in the touched buckets only."""
    return table.rewrite(incoming, lambda old, new: upsert_latest(old, new, table.keys, version))


def replace_children_in(table: KeyedTable, incoming: DataFrame) -> list[str]:
    """Replace the children of the arriving parents; the table's buckets must go by the parent (bucket_by)."""
    return table.rewrite(incoming, lambda old, new: replace_children(old, new, table.bucket_by))
