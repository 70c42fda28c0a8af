"""Fuzzy matching of names: character masks, scores of subsequences, and ranking of files and modules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions import columns as C

# Fixed values of the score.
MATCH, GAP_START, GAP_MORE = 16, -3, -1
AFTER_WHITE, AFTER_DELIMITER, AFTER_OTHER, CAMEL, CONSECUTIVE, FIRST_FACTOR = 10, 9, 8, 7, 4, 2
EXACT, PREFIX, PREFIX_SHARE, PREFIX_FROM = 10_000.0, 5_000.0, 1_000.0, 3
_LOW = -(2**30)
#: Characters that a name must have to be looked at.
MASKED = "abcdefghijklmnopqrstuvwxyz0123456789_-./"


def _kind(c: str) -> str:
    if "a" <= c <= "z":
        return "lower"
    if "A" <= c <= "Z":
        return "upper"
    if "0" <= c <= "9":
        return "digit"
    return "white" if c in " \t\n\r" else "delimiter" if c in "/_-.:;|>" else "other"


_EDGE = {"white": AFTER_WHITE, "delimiter": AFTER_DELIMITER, "other": AFTER_OTHER}


def _bonuses(text: str) -> list[int]:
    """What a match at each position is worth for standing at the start of a word."""
    out, before = [], "white"
    for kind in map(_kind, text):
        if before in _EDGE:
            out.append(_EDGE[before] if kind != before else 0)
        elif before == "lower":
            out.append(CAMEL if kind == "upper" else 0)
        else:
            out.append(AFTER_OTHER if before == "digit" and kind in ("lower", "upper") else 0)
        before = kind
    return out


def fuzzy_score(text: str, pattern: str, case_sensitive: bool = False) -> tuple[float, list[int]] | None:
    """Score and positions of the pattern as a subsequence of the text; None if it isn't one or isn't worth anything.

    An empty pattern scores 0. Positions count characters. Within the tightest window found from both ends a substring
    is taken as it is; otherwise the best alignment with affine gaps decides.
    """
    if not pattern:
        return 0.0, []
    fold = (lambda s: s) if case_sensitive else (lambda s: "".join(c.lower() if c.isascii() else c for c in s))
    t, p = fold(text), fold(pattern)
    end = -1
    for c in p:
        end = t.find(c, end + 1)
        if end < 0:
            return None
    start = end + 1
    for c in reversed(p):
        start = t.rfind(c, 0, start)
    bonus = _bonuses(text)
    at = t.find(p, start, end + 1)
    if at >= 0:
        rest = sum(max(b, CONSECUTIVE) for b in bonus[at + 1 : at + len(p)])
        return float(MATCH * len(p) + FIRST_FACTOR * bonus[at] + rest), list(range(at, at + len(p)))
    window = range(start, end + 1)
    scores: list[list[int]] = []
    taken: list[list[bool]] = []
    above, runs_above = None, None
    for i, c in enumerate(p):
        row, runs, took, gap, left = [], [], [], False, None
        for k, pos in enumerate(window):
            skip = _LOW if left is None else left + (GAP_MORE if gap else GAP_START)
            hit = t[pos] == c
            gap = not hit
            best, run = skip, 0
            if hit:
                run_before = runs_above[k - 1] if i and k else 0
                worth = MATCH + (max(bonus[pos], CONSECUTIVE) if run_before else bonus[pos]) + (bonus[pos] * (FIRST_FACTOR - 1) if i == 0 else 0)
                diagonal = 0 if i == 0 else above[k - 1] if k else _LOW
                if diagonal + worth >= skip:
                    best, run = diagonal + worth, run_before + 1
            row.append(best)
            runs.append(run)
            took.append(run > 0)
            left = best
        scores.append(row)
        taken.append(took)
        above, runs_above = row, runs
    k = max(range(len(above)), key=lambda j: (above[j], -j))
    if above[k] <= 0:
        return None
    found, i, score = [], len(p) - 1, above[k]
    while i >= 0 and k >= 0:
        if taken[i][k]:
            found.append(start + k)
            i -= 1
        k -= 1
    return (float(score), found[::-1]) if i < 0 else None


class Token:
    """One word of a query; case matters if it has a capital (with compat its lower case is looked for all the same)."""

    def __init__(self, word: str, compat: bool = False) -> None:
        self.case = any("A" <= c <= "Z" for c in word)
        self.low = word.lower()
        self.pattern = word if self.case and not compat else self.low


def score_file(tokens: list[Token], name: str, path: str, desc: str) -> float | None:
    """The sum over the words: exact or leading name, else fuzzy in the name (twice), the path, the description (half); None if one fits nowhere."""
    total = 0.0
    low = name.lower()
    stem = low.rsplit(".", 1)[0] if "." in low else low
    for token in tokens:
        if token.low in (stem, low):
            total += EXACT
        elif len(token.low) >= PREFIX_FROM and stem.startswith(token.low):
            total += PREFIX + PREFIX_SHARE * len(token.low) / len(stem)
        else:
            for text, weight in ((name, 2.0), (path, 1.0), (desc, 0.5)):
                got = fuzzy_score(text, token.pattern, token.case)
                if got:
                    total += got[0] * weight
                    break
            else:
                return None
    return total


def _may_hold(tokens: list[Token], *fields: Column) -> Column:
    """Every word's characters occur in one of the fields: what lacks one never reaches Python.

    The same test as with bit masks (functions.columns.bitmask), on the few characters of the words only.
    """
    holds = lambda t, f: reduce(lambda a, b: a & b, [F.contains(F.lower(f), F.lit(c)) for c in sorted(set(t.low) & set(MASKED))], F.lit(True))
    each = [reduce(lambda a, b: a | b, [holds(t, f) for f in fields]) for t in tokens]
    return reduce(lambda a, b: a & b, each)


def search_files(files: DataFrame, query: str, limit: int, compat: bool = False) -> DataFrame:
    """(repo, path, score), the best `limit` files by name; none for a blank query; ties in the order of repo and path."""
    tokens = [Token(w, compat) for w in query.split()]
    if not tokens:
        return files.select("repo", "path", F.lit(0.0).alias("score")).limit(0)
    # explode keeps the description a column: in a projection it would be worked out anew for each character that is tested.
    rows = files.select("repo", "path", "filename", F.explode(F.array(C.describe(F.col("path")))).alias("desc"))
    rows = rows.where(_may_hold(tokens, F.col("filename"), F.col("path"), F.col("desc")))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, paths, descs in batches:
            yield pd.Series([score_file(tokens, *x) for x in zip(names, paths, descs)], dtype="float64")

    scored = rows.select("repo", "path", F.round(score("filename", "path", "desc"), 6).alias("score")).where("score is not null and not isnan(score)")
    return scored.orderBy(F.desc("score"), "repo", "path").limit(limit)


def search_modules(modules: DataFrame, query: str, limit: int, compat: bool = False) -> DataFrame:
    """(id, name, file_count, score): modules by name (twice) or else by id, more for larger ones; as search_files."""
    tokens = [Token(w, compat) for w in query.split()]
    if not tokens:
        return modules.select("id", "name", "file_count", F.lit(0.0).alias("score")).limit(0)
    rows = modules.where(_may_hold(tokens, F.col("name"), F.col("id")))

    def one(name: str, ident: str) -> float | None:
        total = 0.0
        for t in tokens:
            got = [(w, s) for text, w in ((name, 2.0), (ident, 1.0)) if (s := fuzzy_score(text, t.pattern, t.case))]
            if not got:
                return None
            total += got[0][0] * got[0][1][0]
        return total

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, ids in batches:
            yield pd.Series([one(*x) for x in zip(names, ids)], dtype="float64")

    scored = rows.select("id", "name", "file_count", score("name", "id").alias("s")).where("s is not null and not isnan(s)")
    return scored.select("id", "name", "file_count", F.round(F.col("s") + 2 * F.log2(F.col("file_count") + 1.0), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def name_rank(files: DataFrame, word: str, limit: int | None) -> DataFrame:
    """(repo, path, score) by the exact and leading name alone, in built-in expressions; all in no order if limit is None."""
    low = word.lower()
    name = F.lower("filename")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    score = F.when((stem == low) | (name == low), EXACT).when(stem.startswith(low) & (F.lit(len(low)) >= PREFIX_FROM), PREFIX + PREFIX_SHARE * len(low) / F.length(stem))
    rows = files.select("repo", "path", F.round(score, 6).alias("score")).where("score is not null")
    return rows if limit is None else rows.orderBy(F.desc("score"), "repo", "path").limit(limit)


def highlights(files: DataFrame, query: str, limit: int, compat: bool = False) -> DataFrame:
    """search_files with name_indices and path_indices: which characters (from 0) of the name and the path the words match."""
    tokens = [Token(w, compat) for w in query.split()]

    def indices(text: str) -> list[int]:
        found: set[int] = set()
        for t in tokens:
            if got := fuzzy_score(text, t.pattern, t.case):
                found.update(got[1])
        return sorted(found)

    @F.pandas_udf("array<int>")
    def matched(texts: pd.Series) -> pd.Series:
        return texts.map(indices)

    best = search_files(files, query, limit, compat)
    names = files.select("repo", "path", "filename").dropDuplicates(["repo", "path"])
    rows = names.join(F.broadcast(best), ["repo", "path"])  # at most `limit`
    return rows.select("repo", "path", "score", matched("filename").alias("name_indices"), matched("path").alias("path_indices"))
