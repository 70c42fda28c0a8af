"""Problem 5: cut items above a size limit at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where each level may cut: after the match. Sections, paragraphs, sentences (and lines), words; then any character.
LEVELS = tuple(
    re.compile(p)
    for p in (
        r"\n+(?=#{1,6} |(?:export |public |private |internal |static |pub |async )*(?:class|def|func|fn|function|impl|struct|interface|module)\b)|\f",
        r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+",
        r"(?<=[.!?])[ \t]+|[。！？]|(?:\r\n|\n|\r)",
        r"\s+",
    )
)
LINE_END = re.compile(r"\r\n|\n|\r")
#: The most characters that are kept together as one.
GRAPHEME = 32
PIECES = "piece_no int, n_pieces int, start_char int, start_line int, piece string"


def _joined(text: str, at: int) -> bool:
    """Whether a cut at this place would part what is one character to a reader: CR LF, marks, joiners, variants, tones, flags."""
    a, b = text[at - 1], text[at]
    if a == "\r" and b == "\n" or "\u200d" in (a, b) or "\ufe00" <= b <= "\ufe0f" or "\U0001f3fb" <= b <= "\U0001f3ff" or unicodedata.combining(b):
        return True
    flags = 0
    while flags < 256 and at - flags > 0 and "\U0001f1e6" <= text[at - flags - 1] <= "\U0001f1ff":
        flags += 1
    return flags % 2 == 1 and "\U0001f1e6" <= b <= "\U0001f1ff"


def _units(text: str, lo: int, hi: int, most: int, level: int, out: list[tuple[int, int]]) -> None:
    """Append (end, level) of units of at most `most` characters that cover text[lo:hi], from the highest level that does."""
    while hi - lo > most and level < len(LEVELS):
        ends = [m.end() for m in LEVELS[level].finditer(text, lo, hi) if lo < m.end() < hi]
        level += 1
        if ends:
            for end in [*ends, hi]:
                if end - lo > most:
                    _units(text, lo, end, most, level, out)
                    out[-1] = (end, level)
                else:
                    out.append((end, level))
                lo = end
            return
    while hi - lo > most:
        cut = lo + most
        while cut > lo + 1 and cut > lo + most - GRAPHEME and _joined(text, cut):
            cut -= 1
        out.append((cut if cut > lo + 1 and not _joined(text, cut) else lo + most, level + 1))
        lo = out[-1][0]
    out.append((hi, level + 1))


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces, none longer than limit, in characters; a text within the limit is one piece.

    Every piece but the first starts exactly `overlap` characters before the end of the one before (at most half of the
    limit); as many units are packed as fit, but within the last quarter of a piece the end of the highest level is taken:
    a section's end rather than a word after it. An empty text is one empty piece.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit // 2))
    units: list[tuple[int, int]] = []
    _units(text, 0, len(text), limit - overlap, 0, units)
    ends, levels = [e for e, _ in units], [v for _, v in units]
    pieces, start = [], 0
    while True:
        last = best = bisect_right(ends, start + limit) - 1
        while ends[last] < len(text) and best > 0 and ends[best - 1] > start + max(overlap, limit - limit // 4):
            best -= 1
            if levels[best] < levels[last]:
                last = best
        end = ends[last]
        pieces.append((start, end))
        if end == len(text):
            return pieces
        start = end - overlap


def _split_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out: dict[str, list] = {c: [] for c in ("item_id", "piece_no", "n_pieces", "start_char", "start_line", "piece")}
        for key, text, limit, overlap, line in zip(frame["item_id"], frame["body"], frame["most"], frame["shared"], frame["line"]):
            pieces = split_text(text, int(limit), int(overlap))
            breaks = [m.end() for m in LINE_END.finditer(text)]
            for n, (a, b) in enumerate(pieces):
                at = None if pd.isna(line) else int(line) + bisect_right(breaks, a)
                for c, v in zip(out, (key, n, len(pieces), a, at, text[a:b])):
                    out[c].append(v)
        yield pd.DataFrame(out).astype({"start_line": "Int32"})


def split_items(df: DataFrame, item: str, text: str, limits: DataFrame, on: str, limit: str, overlap: str, start_line: str) -> DataFrame:
    """(item, piece_no, n_pieces, start_char, start_line, piece) for every row of df.

    limits has one row per value of `on` with the limit and the overlap in characters (code points). A text that is null
    yields no piece; a row whose `on` has no limit stays in one piece. start_line is that of the piece, null where the
    item has none. Only texts above the limit leave the JVM. A row that occurs twice yields its pieces twice.
    """
    rules = limits.groupBy(F.col(on).alias("rule")).agg(F.max(limit).alias("most"), F.max(overlap).alias("shared"))
    rows = df.select(F.col(item).alias("item_id"), F.col(text).alias("body"), F.col(on).alias("rule"), F.col(start_line).cast("int").alias("line")).where("body is not null")
    rows = rows.join(rules, "rule", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    long = F.coalesce(F.length("body") > F.col("most"), F.lit(False))
    whole = rows.where(~long).select(
        "item_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), F.col("line").alias("start_line"),
        F.col("body").alias("piece")
    )
    kind = rows.schema["item_id"].dataType.simpleString()
    cut = rows.where(long).select("item_id", "body", "most", "shared", "line").mapInPandas(_split_batches, f"item_id {kind}, {PIECES}")
    return whole.unionByName(cut).withColumnRenamed("item_id", item)
