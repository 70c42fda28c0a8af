"""Commit history: blame, file history, changes, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def civil_date(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def commit_time(seconds: Column, offset_minutes: Column) -> Column:
    """Local time of a commit to the minute."""
    return F.date_format((seconds + offset_minutes * 60).cast("timestamp"), "yyyy-MM-dd HH:mm")


def blame(lines: DataFrame, repo: str, first: int = 1, last: int | None = None) -> DataFrame:
    """(path, line_no, author, time, hash, content) of a repository's lines in a range; a line delivered twice counts once."""
    rows = lines.where((F.col("repo") == repo) & (F.col("line_no") >= first))
    rows = rows if last is None else rows.where(F.col("line_no") <= last)
    return rows.dropDuplicates(["blame_id"]).select(
        "blame_id", F.translate("rel_path", "\\", "/").alias("path"), "line_no", "author", F.date_format(
            "committed_at", "yyyy-MM-dd HH:mm"
        ).alias("time"), F.substring("commit_hash", 1, 8).alias("hash"), "content"
    )


def blame_drift(lines: DataFrame, current: DataFrame) -> DataFrame:
    """(repo, path, lines, same, differ, gone): blamed lines against the current ones (repo, path, line_no, line) of their files."""
    blamed = lines.where("repo is not null and rel_path is not null and line_no is not null").select(
        "blame_id", "repo", F.translate("rel_path", "\\", "/").alias("path"), "line_no", "content"
    ).dropDuplicates(["blame_id"])
    rows = blamed.join(current, ["repo", "path", "line_no"], "left")
    same = F.coalesce(F.regexp_replace("content", "\r$", "") == F.col("line"), F.lit(False))
    counts = F.count("*").alias("lines"), F.count_if(same).alias("same"), F.count_if(
        ~same & F.col("line").isNotNull()
    ).alias("differ"), F.count_if(F.col("line").isNull()).alias("gone")
    return rows.groupBy("repo", "path").agg(*counts)


def file_history(commits: DataFrame, files: DataFrame, path: str, limit: int, most_files: int = 50) -> DataFrame:
    """(hash, author, ts, files_changed, paths): the latest commits that touched a path, with the files they changed.

    paths are the first most_files of them in order; files_changed counts all.
    """
    touched = files.where(F.col("path") == path).select("hash").distinct()
    latest = commits.join(touched, "hash").select("hash", "author", "ts").orderBy(F.desc("ts"), "hash").limit(limit)
    changed = files.join(F.broadcast(latest.select("hash")), "hash", "left_semi").select("hash", "path").distinct()  # of at most `limit` commits
    sizes = changed.groupBy("hash").agg(F.count("*").alias("files_changed"), F.slice(F.array_sort(F.collect_list("path")), 1, most_files).alias("paths"))
    return latest.join(sizes, "hash").select("hash", "author", "ts", "files_changed", "paths").orderBy(F.desc("ts"), "hash")


def changed_since(commits: DataFrame, files: DataFrame, since: str) -> DataFrame:
    """(path, status) of the paths that differ between the state at a moment and the last: added, deleted or modified.

    A path is there if its last change up to a time isn't its deletion; if its first known change comes after the moment,
    it was there before unless that change added it. What was added and deleted since shows nothing, what was added and
    then modified is added. Renames show as deleted and added.
    """
    rows = files.join(commits.select("hash", "ts"), "hash").select(
        "path", "status", F.struct("ts", "hash", "status").alias("at"), (F.col("ts") > F.lit(since).cast("timestamp_ntz")).alias("late")
    )
    ends = rows.groupBy("path").agg(
        F.max_by(
            "status", F.when(~F.col("late"), F.col("at"))
        ).alias("old"), F.min_by("status", F.when(F.col("late"), F.col("at"))).alias("first"), F.max_by("status", "at").alias("last"), F.max("late").alias("changed")
    )
    was, is_now = F.coalesce(F.col("old") != "deleted", F.col("first") != "added"), F.col("last") != "deleted"
    status = F.when(was & is_now, "modified").when(is_now, "added").when(was, "deleted")
    return ends.where("changed").select("path", status.alias("status")).where("status is not null")


def by_status(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


def hot_files(commits: DataFrame, files: DataFrame, until: str, days: int, limit: int) -> DataFrame:
    """(path, commits): paths in the most commits within the days before a moment."""
    end = F.lit(until).cast("timestamp_ntz")
    window = commits.where((F.col("ts") >= end - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= end)).select("hash")
    rows = files.join(window, "hash").groupBy("path").agg(F.countDistinct("hash").alias("commits"))
    return rows.orderBy(F.desc("commits"), "path").limit(limit)


def churn_by_author(lines: DataFrame, limit: int) -> DataFrame:
    """(author, lines, commits): who wrote most of the current lines; unknown authors under null."""
    rows = lines.select("blame_id", "author", "commit_hash").distinct().groupBy("author").agg(F.count("*").alias("lines"), F.countDistinct("commit_hash").alias("commits"))
    return rows.orderBy(F.desc("lines"), "author").limit(limit)
