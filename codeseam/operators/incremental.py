"""Keeping tables up to date: upserts, deletes, the latest entry of a key, cache hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregate that combines before it shuffles (nulls are oldest)."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__m"))
    return best.select(*keys, *(F.col(f"__m.{c}").alias(c) for c in others))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the keys of the changes replaced; changes whose `deleted` is true only remove."""
    kept = table.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes.where(~F.coalesce(F.col("deleted"), F.lit(False))).select(*table.columns))


def cache_state(cached: DataFrame, current: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """keys of current with state: hit if size and time are those of the cache, stale if not, missing if absent."""
    old = cached.select(*keys, *(F.col(c).alias(f"__{c}") for c in same), F.lit(True).alias("__there"))
    rows = current.join(old, keys, "left")
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.select(*keys, F.when(F.col("__there").isNull(), "missing").when(equal, "hit").otherwise("stale").alias("state"))


def sessions(reads: DataFrame, gap: str) -> DataFrame:
    """(session_id, start, end, reads, tokens): runs of reads without a pause of the gap; works on streams with a watermark."""
    return reads.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("reads"), F.sum("tokens").alias("tokens")).select(
        "session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "reads", "tokens"
    )


def debounce(events: DataFrame, key: str, quiet: str) -> DataFrame:
    """(key, start, last, events): one change per burst of events on a key that ends with a quiet time."""
    bursts = events.groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.max("ts").alias("last"), F.count("*").alias("events"))
    return bursts.select(key, F.col("w.start").alias("start"), "last", "events")


def session_summary(reads: DataFrame) -> DataFrame:
    """(session_id, files_read, tokens_served, started_at, last_read)."""
    return reads.groupBy("session_id").agg(
        F.countDistinct("path").alias("files_read"), F.sum("tokens").alias("tokens_served"), F.min("ts").alias("started_at"),
        F.max("ts").alias("last_read")
    )


def active(reads: DataFrame, now: str, idle: str = "30 minutes") -> DataFrame:
    """session_summary of the sessions that read something within the idle time before now; the others are pruned."""
    end = F.lit(now).cast("timestamp_ntz")
    return session_summary(reads.where(F.col("ts") <= end)).where(F.col("last_read") >= end - F.expr(f"interval {idle}"))
