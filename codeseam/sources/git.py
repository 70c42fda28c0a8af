"""Commit history of repositories as a data source: spark.read.format("git_history").option("paths", "/a,/b").load()."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, hash string, author string, seconds long, offset_minutes int, message string, path string, status string"
#: Names of the letters by which changes are reported.
STATUSES = {"A": "added", "D": "deleted", "M": "modified", "T": "typechange"}


#: Commits that one task reads.
COMMITS_PER_TASK = 5_000


def _git(path: str, *args: str) -> list[str]:
    return ["git", "-c", "safe.directory=*", "-C", path, *args]


class _Stretch(InputPartition):
    def __init__(self, path: str, skip: int) -> None:
        self.path, self.skip = path, skip


class _Reader(DataSourceReader):
    """A partition per repository and COMMITS_PER_TASK commits; a commit is compared with its first parent, without a search for renames."""

    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.since = options.get("since")

    def _span(self) -> list[str]:
        return [f"{self.since}..HEAD"] if self.since else ["HEAD"]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            n = int(subprocess.run(_git(path, "rev-list", "--count", "--first-parent", *self._span()), capture_output=True, check=True).stdout)
            out += [_Stretch(path, k) for k in range(0, n, COMMITS_PER_TASK)]
        return out or [_Stretch("", 0)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        if not partition.path:
            return
        form = f"--format={_MARK}%H%x1f%an%x1f%at%x1f%ai%x1f%s"
        args = ["log", "--first-parent", "-m", "--root", "--no-renames", "--name-status", "-z", form, f"--skip={partition.skip}", f"--max-count={COMMITS_PER_TASK}", *self._span()]
        with subprocess.Popen(_git(partition.path, *args), stdout=subprocess.PIPE) as log:
            for entry in _entries(log.stdout):
                yield from _changes(partition.path, entry)
        if log.returncode:
            raise RuntimeError(f"git log of {partition.path} failed")


_MARK = "\x1e"


def _entries(stream: BinaryIO) -> Iterator[str]:
    """The commits of a log, one at a time, as it is written."""
    left = b""
    while block := stream.read(1 << 16):
        *whole, left = (left + block).split(_MARK.encode())
        yield from (x.decode("utf-8", "replace") for x in whole if x)
    if left:
        yield left.decode("utf-8", "replace")


def _changes(repo: str, entry: str) -> Iterator[tuple]:
    head, *rest = entry.split("\0")
    sha, author, seconds, when, message = head.split("\x1f", 4)
    zone = when.split()[-1]
    offset = (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[3:5]))
    names = [x.strip("\n") for x in rest if x.strip("\n")]
    for letter, path in zip(names[::2], names[1::2]):
        yield repo, sha[:8], author, int(seconds), offset, message.strip("\n"), path, STATUSES.get(letter[:1], "unknown")


class GitHistory(DataSource):
    """Changed files of commits, newest first within a repository."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def git_history(spark: SparkSession, paths: list[str], since: str | None = None) -> DataFrame:
    """(repo, hash, author, seconds, offset_minutes, message, path, status) of every change; since: a revision to start after."""
    spark.dataSource.register(GitHistory)
    reader = spark.read.format("git_history").option("paths", ",".join(paths))
    return (reader.option("since", since) if since else reader).load()


BLAME = "repo string, path string, line_no int, author string, seconds long, hash string, content string, error string"


def git_blame(files: DataFrame, rev: str = "HEAD") -> DataFrame:
    """(repo, path, line_no, author, seconds, hash, content, error) of every line of files (repo, path); a file at a time.

    repo is the folder of the repository. A file that isn't there at rev has one row with an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for repo, path in zip(frame["repo"], frame["path"]):
                done = subprocess.run(_git(repo, "blame", "--line-porcelain", rev, "--", path), capture_output=True)
                rows = list(_blamed(done.stdout.decode("utf-8", "replace"))) if done.returncode == 0 else []
                error = None if done.returncode == 0 else "not found"
                rows = [(repo, path, *r, None) for r in rows] or ([(repo, path, None, None, None, None, None, error)] if error else [])
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLAME.split(", ")]).astype({"line_no": "Int32", "seconds": "Int64"})

    return files.select("repo", "path").distinct().mapInPandas(run, BLAME)


def _blamed(porcelain: str) -> Iterator[tuple]:
    """(line_no, author, seconds, hash, content): each line follows its commit's fields and a tab."""
    sha, line_no, author, seconds = "", 0, "", 0
    for line in porcelain.split("\n"):
        if line.startswith("\t"):
            yield line_no, author, seconds, sha[:8], line[1:]
        elif line.startswith("author "):
            author = line[7:]
        elif line.startswith("author-time "):
            seconds = int(line[12:])
        elif re.match(r"[0-9a-f]{40} \d+ \d+", line):
            sha, _, number, *_ = line.split(" ")
            line_no = int(number)


def git_changed(spark: SparkSession, paths: list[str], since: str) -> DataFrame:
    """(repo, path, status) of the files that differ between a revision and HEAD, without a search for renames."""
    schema = "repo string, path string, status string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for repo in frame["repo"]:
                out = subprocess.run(_git(repo, "diff", "--no-renames", "--name-status", "-z", since, "HEAD"), capture_output=True, check=True).stdout.decode("utf-8", "replace")
                names = [x for x in out.split("\0") if x]
                yield pd.DataFrame([(repo, p, STATUSES.get(x[:1], "unknown")) for x, p in zip(names[::2], names[1::2])], columns=["repo", "path", "status"])

    return spark.createDataFrame([(p,) for p in paths], "repo string").repartition(max(1, len(paths))).mapInPandas(run, schema)
