"""Scans of directory trees and their configuration."""

from __future__ import annotations

import codecs
import json
import os
import re
import tomllib
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.session import durable, parts_for

# Defaults of a scan.
SKIP_DIRS = frozenset({".git", "node_modules", "__pycache__", "target", "dist", "build", ".next", "vendor"})
NOISE_DIRS = frozenset({"Private", "Public", "Internal", "Source", "Src", "Include", "src", "lib"})
READ_CAP, SNIFF_BYTES = 512 * 1024, 8192


@dataclass(frozen=True)
class ScanConfig:
    """How a repository is scanned; no extensions means all text files."""

    root: str = "."
    scan_dirs: tuple[str, ...] = (".",)
    skip_dirs: frozenset[str] = SKIP_DIRS
    extensions: frozenset[str] = frozenset()
    noise_dirs: frozenset[str] = NOISE_DIRS
    semantic_model: str | None = None
    unknown: tuple[str, ...] = field(default=(), compare=False)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def parse_config(text: str, root: str = ".") -> ScanConfig:
    """A configuration in TOML: skip_dirs and noise_dirs add to the defaults, the others replace them; unknown keys warn."""
    given = tomllib.loads(text)
    known = {f.name for f in fields(ScanConfig)} - {"root", "unknown"}
    unknown = tuple(k for k in given if k not in known)
    for key in unknown:
        near = min(known, key=lambda k: edit_distance(key, k))
        warnings.warn(f"unknown key {key!r}" + (f", did you mean {near!r}?" if edit_distance(key, near) <= 3 else ""), stacklevel=2)
    bare = lambda names: frozenset(e.lstrip(".") for e in names)
    return ScanConfig(
        root, tuple(
            given.get("scan_dirs", (".",))
        ), SKIP_DIRS | set(given.get("skip_dirs", ())), bare(given.get("extensions", ())), NOISE_DIRS | set(given.get("noise_dirs", ())), given.get("semantic_model"), unknown
    )


def registry(text: str) -> dict[str, str]:
    """name -> root of [repos.<name>] sections; raises ValueError where a root is missing."""
    repos = tomllib.loads(text).get("repos", {})
    if missing := [n for n, r in repos.items() if not isinstance(r, dict) or "root" not in r]:
        raise ValueError(f"no root for {', '.join(missing)}")
    return {n: r["root"] for n, r in repos.items()}


_ENTRY = "path string, is_dir boolean, size long, mtime timestamp"
_TEXT = "path string, size long, mtime timestamp, content string"


def _lister(config: ScanConfig):
    """Lists directories (their paths below the root): what is pruned is neither listed nor read."""
    root, skip, extensions = os.path.abspath(config.root), config.skip_dirs, config.extensions

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for folder in frame["path"]:
                try:
                    entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
                except OSError:
                    continue  # gone, or not ours to read
                for e in entries:
                    if e.name.startswith("."):
                        continue
                    path = e.name if folder == "." else f"{folder}/{e.name}"
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in skip:
                            rows.append((path, True, None, None))
                    elif e.is_file() and (not extensions or e.name.rpartition(".")[2].lower() in extensions and "." in e.name):
                        stat = e.stat()
                        rows.append((path, False, stat.st_size, pd.Timestamp(stat.st_mtime_ns, unit="ns", tz="UTC")))
            yield _frame(rows, _ENTRY).astype({"size": "Int64"})

    return run


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return frame.astype({"mtime": "datetime64[us, UTC]"})


def read_text(path: str, sniff: bool) -> str | None:
    """The first READ_CAP bytes of a file, whole characters; None for a file that isn't text or can't be read."""
    try:
        with open(path, "rb") as f:
            data = f.read(READ_CAP + 1)
    except OSError:
        return None
    if sniff and b"\x00" in data[:SNIFF_BYTES]:
        return None
    try:
        return codecs.getincrementaldecoder("utf-8")().decode(data[:READ_CAP], final=len(data) <= READ_CAP)
    except UnicodeDecodeError:
        return None


def _reader(config: ScanConfig):
    root, sniff = os.path.abspath(config.root), not config.extensions

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):  # of capped texts no more than this many are held
                part = frame.iloc[at : at + 64]
                texts = [read_text(os.path.join(root, p), sniff) for p in part["path"]]
                part = part.assign(content=texts)[["path", "size", "mtime", "content"]]
                yield part[part["content"].notna()]

    return run


def _described(texts: DataFrame, repo: str, config: ScanConfig) -> DataFrame:
    category = C.category(F.col("path"), F.array(*map(F.lit, (d for d in config.scan_dirs if d != "."))).cast("array<string>"), F.array(*map(F.lit, sorted(config.noise_dirs))))
    return texts.select(
        F.lit(repo).alias("repo"), "path", "size", "mtime", C.extension(F.col("path")).alias("ext"), C.describe(F.col("path")).alias("desc"),
        category.alias("category"), "content", (F.col("size") > READ_CAP).alias("truncated")
    )


def scan(spark: SparkSession, repo: str, config: ScanConfig) -> DataFrame:
    """(repo, path, size, mtime, ext, desc, category, content, truncated) of the text files below the root.

    Directories are listed level by level, each level by all tasks; those of skip_dirs and those whose name begins with a
    dot are never listed, nor are such files. Left out are files with a NUL among the first bytes (unless extensions are
    given) or without valid UTF-8. Of a file at most READ_CAP bytes are read; truncated tells those that are larger. The
    root lies on a file system that all machines see under the same path.
    """
    root = os.path.abspath(config.root)
    there = [d for d in config.scan_dirs if os.path.isdir(os.path.join(root, d))]
    for d in set(config.scan_dirs) - set(there) - {"."}:
        warnings.warn(f"no directory {d!r} to scan", stacklevel=2)
    level = spark.createDataFrame([(d.strip("/"),) for d in there], "path string")
    files = spark.createDataFrame([], _ENTRY)
    n = len(there)
    while n:
        entries = durable(level.repartition(min(n, 1000)).mapInPandas(_lister(config), _ENTRY))
        files = files.unionByName(entries.where("not is_dir"))
        level = entries.where("is_dir").select("path")
        n = level.count()
    n_files = files.count()
    texts = files.dropDuplicates(["path"]).repartition(parts_for(n_files, 2_000)).mapInPandas(_reader(config), _TEXT) if n_files else spark.createDataFrame([], _TEXT)
    return _described(texts, repo, config)


def scan_file(spark: SparkSession, repo: str, config: ScanConfig, path: str) -> DataFrame:
    """The row that scan has for one file below the root; none where it is no file, or not one of the extensions, or no text."""
    full = os.path.join(os.path.abspath(config.root), path)
    wanted = not config.extensions or path.rpartition(".")[2].lower() in config.extensions
    rows = []
    if wanted and not path_is_bad(path) and os.path.isfile(full) and (text := read_text(full, not config.extensions)) is not None:
        stat = os.stat(full)
        rows.append((path, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), text))
    return _described(spark.createDataFrame(rows, _TEXT), repo, config)


def path_is_bad(path: str) -> bool:
    """Whether a path leaves its root: empty, absolute, or with a step upwards."""
    return not path or path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/")


def guarded(root: str, path: str) -> str:
    """The full path of a file below the root, links resolved; ValueError where it lies elsewhere."""
    full = os.path.realpath(os.path.join(root, path))
    if path_is_bad(path) or not full.startswith(os.path.realpath(root) + os.sep):
        raise ValueError("Invalid path")
    return full


def add_repo(registry_path: str, name: str, root: str) -> bool:
    """Add a repository to a registry file unless it is there; whether it was added. The file is replaced as a whole."""
    text = ""
    if os.path.exists(registry_path):
        with open(registry_path, encoding="utf-8") as f:
            text = f.read()
    if name in registry(text):
        return False
    if not re.fullmatch(r"[\w.-]+", name) or not os.path.isdir(root):
        raise ValueError(f"no repository {name!r} at {root!r}")
    entry = f"[repos.{json.dumps(name)}]\nroot = {json.dumps(os.path.abspath(root))}\n"
    with open(f"{registry_path}.new", "w", encoding="utf-8") as f:
        f.write((text.rstrip("\n") + "\n\n" if text.strip() else "") + entry)
    os.replace(f"{registry_path}.new", registry_path)
    return True
