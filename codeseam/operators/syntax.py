"""Tokens of source lines for display: keywords, types, strings, numbers, comments, directives."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Words that are shown as keywords and as types, in all languages together.
KEYWORDS = frozenset(
    "abstract as async await break case catch class const continue def default defer delete do elif else enum except export extends extern false finally fn for from func function go if impl implements import in "
    "interface is lambda let loop match mod module mut namespace new nil none not null or and override package pass private protected public pub raise return self sizeof static struct super switch template this throw trait true try "
    "type typedef typename union unless use using var virtual void where while with yield".split()
)
TYPES = frozenset("bool boolean byte char double error float float32 float64 i8 i16 i32 i64 int int8 int16 int32 int64 isize long never number object short size_t str string u8 u16 u32 u64 uint unsigned usize any auto".split())
HASH_COMMENTS = frozenset("py rb sh bash zsh yaml yml toml ini cfg conf env r pl ps1".split())
_PARTS = r"""(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<number>\b(?:0[xX][\da-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\b)|(?P<word>[^\W\d]\w*)"""
_SLASH = re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>^[ \t]*#[^\n]*)|" + _PARTS, re.S | re.M)
_HASH = re.compile(r"(?P<comment>\#[^\n]*)|(?P<directive>(?!))|" + _PARTS, re.S | re.M)


def tokens(text: str | None, ext: str | None) -> Iterator[tuple[int, int, int, str]]:
    """(line from 1, start in the line, length, kind) of what is to be coloured; a comment over several lines has one for each."""
    if not text:
        return
    line, begin, at = 1, 0, 0
    for m in (_HASH if (ext or "").lower() in HASH_COMMENTS else _SLASH).finditer(text):
        kind = m.lastgroup
        if kind == "word":
            kind = "keyword" if m[0] in KEYWORDS else "type" if m[0] in TYPES or m[0][0].isupper() and any(c.islower() for c in m[0]) else None
        if kind is None:
            continue
        line += text.count("\n", at, m.start())
        begin = text.rfind("\n", 0, m.start()) + 1
        at = m.start()
        for n, part in enumerate(m[0].split("\n")):
            if part:
                yield line + n, at - begin if n == 0 else 0, len(part), kind


def token_table(files: DataFrame) -> DataFrame:
    """(file_id, line_no, start, length, kind) for every coloured token of every file."""
    names = ["file_id", "line_no", "start", "length", "kind"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text, ext in zip(frame["file_id"], frame["content"], frame["ext"]):
                yield pd.DataFrame([(key, *t) for t in tokens(text, ext)], columns=names)

    return files.select("file_id", "content", "ext").mapInPandas(run, "file_id long, line_no int, start int, length int, kind string")
