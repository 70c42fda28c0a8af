"""Structured Streaming: changes of files into tables, and sessions of reads.

The file table of a folder lies in buckets by the hash of repository and path. A batch of changes writes the buckets that
it touches anew, under its number; a small manifest says which writing of each bucket counts. So a batch costs what it
touches and not the table, a large repository is in many buckets, and readers of the manifest before aren't disturbed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeseam.operators import incremental
from codeseam.session import distinct_rows, durable, small_side

CHANGES = "repo string, path string, ts timestamp, size long, content string, deleted boolean"
#: Buckets of a new table; for a large one more, so that each is of a size that a task writes.
BUCKETS = 64
#: Manifests that are kept for readers, and days after which the mark of a deleted file is forgotten.
KEEP_VERSIONS, KEEP_DELETED_DAYS = 2, 30


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Change events (see CHANGES) that arrive as Parquet files in a folder."""
    return spark.readStream.schema(CHANGES).parquet(folder)


class _Store:
    """The manifests and buckets of a file table, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.jvm = spark, folder.rstrip("/"), spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str, start: str) -> list[str]:
        if not self.fs.exists(self._path(name)):
            return []
        return sorted(n for x in self.fs.listStatus(self._path(name)) if (n := x.getPath().getName()).startswith(start))

    def manifest(self) -> dict | None:
        """The newest one: version, buckets, and the version that holds each written bucket."""
        found = sorted(int(n.split("-")[1]) for n in self.names("manifests", "m-"))
        if not found:
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/m-{found[-1]}", wholetext=True).first()[0])

    def publish(self, manifest: dict) -> None:
        """Written aside and renamed, so that a manifest is there whole or not at all."""
        name = f"m-{manifest['version']}"
        out = self.fs.create(self._path(f"manifests/.{name}"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self.fs.rename(self._path(f"manifests/.{name}"), self._path(f"manifests/{name}"))

    def expire(self) -> None:
        """Remove old manifests, and what none of those that are left refers to."""
        versions = sorted(int(n.split("-")[1]) for n in self.names("manifests", "m-"))
        for v in versions[:-KEEP_VERSIONS]:
            self.fs.delete(self._path(f"manifests/m-{v}"), False)
        used = set()
        for v in versions[-KEEP_VERSIONS:]:
            held = json.loads(self.spark.read.text(f"{self.folder}/manifests/m-{v}", wholetext=True).first()[0])
            used |= {(int(x), b) for b, x in held["written"].items()}
        for name in self.names("", "v-"):
            v = int(name.split("-")[1])
            if v > versions[-1]:
                continue
            buckets = self.names(name, "bucket=")
            gone = [b for b in buckets if (v, b.split("=")[1]) not in used]
            for b in gone if len(gone) < len(buckets) else []:
                self.fs.delete(self._path(f"{name}/{b}"), True)
            if len(gone) == len(buckets):
                self.fs.delete(self._path(name), True)

    def read(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame | None:
        """All rows of the buckets (of all for None), also those that mark deleted files."""
        wanted = [f"{self.folder}/v-{v}/bucket={b}" for b, v in sorted(manifest["written"].items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(CHANGES).parquet(*wanted) if wanted else None


def current(spark: SparkSession, folder: str) -> tuple[DataFrame, int] | None:
    """The table's files as of its newest manifest, and its number; None if nothing was written yet."""
    store = _Store(spark, folder)
    manifest = store.manifest()
    if manifest is None:
        return None
    rows = store.read(manifest)
    rows = spark.createDataFrame([], CHANGES) if rows is None else rows
    return rows.where("not deleted").select("repo", "path", "ts", "size", "content"), manifest["version"]


def apply_changes(
    spark: SparkSession, batch: DataFrame, folder: str, version: int, skip_dirs: frozenset[str] = frozenset(), buckets: int = BUCKETS,
    keep_deleted_days: int = KEEP_DELETED_DAYS
) -> None:
    """Bring the file table up to date with a batch; a version written before is not written again.

    Of all changes of a path, in whatever batch they come, the one of the largest ts counts (of equal ones a deletion, then
    the larger size): an older event that arrives later changes nothing. Deleted files stay as marks for
    keep_deleted_days before the newest event, so that late events don't bring them back. Files in skip_dirs, and rows
    without repository, path or ts, are left out. Whatever is derived from the table is a query over it.
    """
    store = _Store(spark, folder)
    manifest = store.manifest() or {"version": -1, "buckets": buckets, "written": {}}
    if manifest["version"] >= version:
        return
    bucket = F.pmod(F.xxhash64("repo", "path"), F.lit(manifest["buckets"])).cast("int")
    rows = batch.where("repo is not null and path is not null and ts is not null").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    rows = rows.select("repo", "path", "ts", "size", "content", "deleted")
    if skip_dirs:
        rows = rows.where(~F.exists(F.split("path", "/"), lambda p: p.isin(sorted(skip_dirs))))
    touched, newest = rows.agg(F.collect_set(bucket.cast("string")), F.max("ts")).first()  # at most `buckets`
    if touched:
        old = store.read(manifest, touched)
        merged = incremental.latest(rows if old is None else old.unionByName(rows), ["repo", "path"], ["ts", "deleted", "size"])
        merged = merged.where(~F.col("deleted") | (F.col("ts") >= F.lit(newest) - F.make_dt_interval(F.lit(keep_deleted_days))))
        merged = merged.withColumn("content", F.when(~F.col("deleted"), F.col("content")))
        merged.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store.folder}/v-{version}")
        there = {n.split("=")[1] for n in store.names(f"v-{version}", "bucket=")}
        written = {b: v for b, v in manifest["written"].items() if b not in touched} | {b: version for b in there}
        manifest = manifest | {"written": written}
    store.publish(manifest | {"version": version})
    store.expire()


def keep_current(
    changes: DataFrame, folder: str, checkpoint: str, skip_dirs: frozenset[str] = frozenset(), after: Callable[[DataFrame], None] | None = None,
    every: str = "500 milliseconds"
) -> StreamingQuery:
    """Keep the file table of a folder current; `after` gets the table after each batch."""
    spark = changes.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        apply_changes(spark, rows, folder, number, skip_dirs)
        if after:
            after(current(spark, folder)[0])

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(checkpoint, "files")).trigger(processingTime=every).start()


def rescan(spark: SparkSession, folder: str, repo: str, files: DataFrame, ts: str, version: int) -> None:
    """Bring one repository of a file table to the state of a scan (path, size, content) made at ts: what is new or differs is
    upserted, what the scan lacks is deleted. Of a repository that isn't in the table all files are added."""
    now = current(spark, folder)
    there = spark.createDataFrame([], CHANGES).select("path", "size", "content") if now is None else now[0].where(F.col("repo") == repo).select("path", "size", "content")
    state = lambda rows, name: rows.select("path", F.struct("size", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h")).alias(name))
    once = distinct_rows(files, "path")
    both = durable(state(there, "old").join(state(once, "new"), "path", "full_outer").where("not (old <=> new)").select("path", F.col("new").isNull().alias("deleted")))
    fresh = once.select("path", "size", "content").join(small_side(both.where("not deleted")), "path")
    rows = fresh.unionByName(both.where("deleted"), allowMissingColumns=True)
    apply_changes(spark, rows.select(F.lit(repo).alias("repo"), "path", F.lit(ts).cast("timestamp").alias("ts"), "size", "content", "deleted"), folder, version)


def live_sessions(reads: DataFrame, gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """Sessions of a stream of reads (session_id, path, tokens, ts): closed after the gap, late reads kept for a while."""
    return incremental.sessions(reads.withWatermark("ts", late), gap)


def live_debounce(events: DataFrame, key: str, quiet: str = "500 milliseconds", late: str = "1 second") -> DataFrame:
    """One row per burst of events on a key, once it was quiet."""
    return incremental.debounce(events.withWatermark("ts", late), key, quiet)


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, total) in tumbling or sliding windows of event time."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "events", "total")
