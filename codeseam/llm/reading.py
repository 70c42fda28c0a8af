"""Problem 8: the reading level of each document, comparable across languages, from a sample of rated documents.

The running text is taken out of its surroundings (code, tables, headings, links, comment marks, list marks), measured
by the distributions of its word and sentence lengths, vocabulary, clauses and cohesion, put on the scale of its own
language, and graded by gradient-boosted regression trees. Grades are calibrated on predictions of folds that share no
source with their training rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeseam.session import durable, small_side

#: At most so many rated documents train the trees (those of the smallest hashes); all documents are measured and graded.
TRAIN_ROWS = 20_000
#: A text of fewer words has no level.
MIN_WORDS = 5

# --- running text -----------------------------------------------------------------------------------------------------

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_COMMENT_MARK = re.compile(r"^[ \t]*(?://+!?|#+|\*+|--+|;+|%+|/\*+|\"\"\")(?:[ \t]|$)")
_CLOSE_MARK = re.compile(r"\*+/[ \t]*$")
_SKIPPED = re.compile(
    r"^\s*\||^\s*#{1,6}\s|^\s*(?:[-=*_]\s*){3,}$|^\s*\d{4}-\d\d-\d\d[T ]\d\d|^\s*(?:from|import|using|#include|#define|require|package|use)\b[^.!?]*[;'\">]?\s*$"
    r"|[;{}]\s*$|^\s*(?:if|for|while|return|def|class|fn|func|function|let|const|var|public|private|export|elif|else|switch|case|raise|throw)\b.*(?:[({:=].*|\breturn\b.*)$"
    r"|^\s*[\w.\[\]\"']+\s*(?:[-+*/|&]?=|:=|<-|->)\s*\S|^\s*[\w.:]+\([^)]*\)[;:]?\s*$|^\s*(?:return|break|continue|pass|end|else)\b[\w ]{0,12};?\s*$|^\s*<[^>]+>\s*$|^\s*[$>]\s+\w|::\w+\("
)
#: A line of nothing but words and the marks between sentences.
_PLAIN = re.compile(r"^[ \t]*(?!(?:from|import|using|require|package|use|return|break|continue|pass|end|else)\b)[^\W\d_]+[^\d_|#;{}<>=()\[\]\"$*@/\\`:]*$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,4}[.)]|\[[ xX]?\]|\[\w+\]:?|>|@\w+:?)\s+")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_ASIDE = re.compile(r"\([^()\n]{0,60}\)")
_CODE = re.compile(r"`[^`\n]*`")
#: A token (without blanks) that is no word: names of code, paths, links, tags, numbers and versions.
_NO_LETTER = re.compile(r"[\d_/\\<>{}=@#|]")
_INNER_DOT = re.compile(r"\.\w")


def _is_word(token: str) -> bool:
    return token.isalpha() or not (_NO_LETTER.search(token) or ("." in token and _INNER_DOT.search(token)))




def running_text(text: str) -> str:
    """The sentences of a text, one unit (paragraph or list item) to a line; '' where there are none."""
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    lines = text.split("\n")
    filled = [x for x in lines if x and not x.isspace()]
    marked = sum(1 for x in filled if _COMMENT_MARK.match(x))
    if marked and marked >= 0.6 * len(filled) and not sum(1 for x in filled if _ITEM.match(x) and x.lstrip()[0] in "-*+" and not x.startswith(" *")) > 0.5 * len(filled):
        lines = [_CLOSE_MARK.sub("", _COMMENT_MARK.sub("", x, count=1)) if _COMMENT_MARK.match(x) else x for x in lines]
    units: list[str] = []
    open_unit = False
    for line in lines:
        if not line or line.isspace():
            open_unit = False
            continue
        item = _ITEM.match(line)
        if item:
            line = line[item.end() :]
            open_unit = False
        if not _PLAIN.match(line) and _SKIPPED.search(line):
            open_unit = False
            continue
        if open_unit:
            units[-1] += " " + line.strip()
        else:
            units.append(line.strip())
            open_unit = True
    for n, unit in enumerate(units):
        if "](" in unit:
            unit = _LINK.sub(r"\1", unit)
        if "`" in unit:
            unit = _CODE.sub(" ", unit)
        if "(" in unit:
            unit = _ASIDE.sub(" ", unit)
        if _NO_LETTER.search(unit) or _INNER_DOT.search(unit):
            unit = " ".join(filter(_is_word, unit.split(" ")))
        units[n] = unit
    return "\n".join(units)


# --- measures ---------------------------------------------------------------------------------------------------------

#: Frequent words by which a language is told.
_MARKS = {
    "en": frozenset("the a an and of to is in on that it this with as for by from but so then our".split()),
    "de": frozenset("der die das ein eine und zu ist in den dem des mit von auf nicht aber also bei am im".split()),
    "fr": frozenset("le la les un une et des du de est dans que pour qui sur mais puis au aux sans donc".split()),
    "es": frozenset("el la los las un una y de del que en es por con para pero luego al se sin".split()),
}
#: Words that open a subordinate clause or a heavy connection.
_CLAUSES = frozenset(
    "whereas although though inasmuch insofar notwithstanding because while unless whereby wherein whether which that if since provided extent"
    " wohingegen obwohl insofern während weil dass falls sofern ungeachtet demgegenüber wodurch indem"
    " tandis quoique bien parce puisque nonobstant étant afin lorsque dont"
    " aunque mientras porque dado puesto siempre cuando cuyo pese".split()
)
FEATURES = (
    "words", "sentences", "word_mean", "word_sd", "word_p50", "word_p90", "word_max", "share_7", "share_10", "share_13",
    "sent_mean", "sent_sd", "sent_p50", "sent_p90", "sent_max", "chars_per_sentence", "ttr", "long_ttr", "clauses_per_sentence", "clause_sentences",
    "commas_per_sentence", "cohesion", "long_sentences", "long_per_sentence",
)


#: Marks that end a sentence, and marks between words.
_ENDS = (". ", "! ", "? ", "… ", ".\n", "!\n", "?\n", "…\n")
_BETWEEN = ("-", "'", "’", ",", ";", ":", '"', ".", "!", "?", "(", ")", "[", "]", "*", "+", "–", "—", "«", "»", "“", "”", "„", "¿", "¡", "~", "%", "&", "^", "$")


def language_of(seen: Counter) -> str | None:
    """The language whose frequent words make up most of the words; None where none is found."""
    counts = {k: sum([seen[w] for w in marks if w in seen]) for k, marks in _MARKS.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] else None


def _spread(values: list[int]) -> tuple[float, float]:
    n = len(values)
    mean = sum(values) / n
    return mean, max(0.0, sum([v * v for v in values]) / n - mean * mean) ** 0.5


def measure(text: str | None) -> tuple[str | None, list[float]] | None:
    """Language and FEATURES of a text's running text; None for texts of too few words."""
    if not text:
        return None
    prose = running_text(text).lower() + "\n"
    commas = prose.count(",")
    for mark in _ENDS:
        prose = prose.replace(mark, "\n")
    for mark in _BETWEEN:
        if mark in prose:
            prose = prose.replace(mark, " ")
    sentences = [w for w in map(str.split, prose.split("\n")) if len(w) >= 2]
    words = [w for s in sentences for w in s]
    n, m = len(words), len(sentences)
    if n < MIN_WORDS:
        return None
    size, per = sorted(map(len, words)), sorted(map(len, sentences))
    seen = Counter(words)
    long = [w for w in words if len(w) >= 10]
    clauses = [len([w for w in s if w in _CLAUSES]) for s in sentences] if not _CLAUSES.isdisjoint(seen) else [0] * m
    content = {w for w in seen if len(w) > 3}
    bags = [content.intersection(s) for s in sentences]
    links = [len(a & b) / min(len(a), len(b)) for a, b in zip(bags, bags[1:]) if a and b]
    (word_mean, word_sd), (sent_mean, sent_sd) = _spread(size), _spread(per)
    values = [
        log1p(n), log1p(m), word_mean, word_sd, float(size[n // 2]), float(
            size[min(n - 1, n * 9 // 10)]
        ), float(size[-1]), 1 - bisect_left(size, 7) / n, 1 - bisect_left(size, 10) / n, 1 - bisect_left(size, 13) / n,
        sent_mean, sent_sd, float(per[m // 2]), float(
            per[min(m - 1, m * 9 // 10)]
        ), float(per[-1]), sum(size) / m, len(seen) / n, len(set(long)) / max(1, len(long)), sum(clauses) / m, sum(map(bool, clauses)) / m,
        commas / m, sum(links) / len(links) if links else 0.0, 1 - bisect_right(per, 20) / m, len(long) / m,
    ]
    return language_of(seen), values


# --- trees ------------------------------------------------------------------------------------------------------------


class Trees:
    """Gradient-boosted regression trees on binned features, squared error, grown level by level.

    Each tree sees a random half of the rows and of the features.
    """

    def __init__(self, rounds: int = 160, depth: int = 3, rate: float = 0.08, least: int = 8, bins: int = 32, seed: int = 7, part: float = 0.5) -> None:
        self.rounds, self.depth, self.rate, self.least, self.bins, self.seed, self.part = rounds, depth, rate, least, bins, seed, part

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Trees:
        w = np.ones(len(y)) if w is None else w
        rng = np.random.default_rng(self.seed)
        self.base = float(np.average(y, weights=w))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)])
        n_features = max(1, round(self.part * len(codes)))
        now = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.rounds):
            rows = np.flatnonzero(rng.random(len(y)) < self.part)
            some = np.sort(rng.choice(len(codes), n_features, replace=False))
            tree = self._grow(codes[np.ix_(some, rows)], some, (y - now)[rows], w[rows])
            self.trees.append(tree)
            now += self.rate * self._apply(tree, x)
        return self

    def _grow(self, codes: np.ndarray, names: np.ndarray, residual: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, bins, n_features = 2 ** (self.depth + 1) - 1, self.bins, len(codes)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(codes.shape[1], dtype=np.int64)
        wr = w * residual
        value[0] = wr.sum() / max(w.sum(), 1e-9)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            live = np.flatnonzero(at >= first)
            # Sums of all features, nodes and bins in one pass.
            key = ((np.arange(n_features)[:, None] * width + (at[live] - first)) * bins + codes[:, live]).ravel()
            sums = lambda v: np.bincount(key, np.tile(v[live], n_features), n_features * width * bins).reshape(n_features, width, bins).cumsum(2)
            s, k = sums(wr), sums(w)
            left_k, right_k, left_s, right_s = k[..., :-1], k[..., -1:] - k[..., :-1], s[..., :-1], s[..., -1:] - s[..., :-1]
            gain = left_s**2 / np.maximum(left_k, 1e-9) + right_s**2 / np.maximum(right_k, 1e-9) - s[..., -1:] ** 2 / np.maximum(k[..., -1:], 1e-9)
            gain[(left_k < self.least) | (right_k < self.least)] = -1
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            for j, top in enumerate(best.argmax(1)):
                node = first + j
                mine = at == node
                if best[j, top] <= 1e-9:
                    at[mine] = -1
                    continue
                f, b = divmod(int(top), bins - 1)
                feature[node], cut[node] = names[f], self.cuts[names[f]][b]
                right = codes[f] > b
                at[mine & ~right], at[mine & right] = 2 * node + 1, 2 * node + 2
                for child, rows in ((2 * node + 1, mine & ~right), (2 * node + 2, mine & right)):
                    value[child] = wr[rows].sum() / max(w[rows].sum(), 1e-9)
        return feature, cut, value

    def _apply(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]), at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._apply(tree, x)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function of x nearest to y (pool adjacent violators), to be read by interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, k, at = blocks.pop()
            u, j, bt = blocks[-1]
            blocks[-1] = [(u * j + v * k) / (j + k), j + k, (bt * j + at * k) / (j + k)]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Grader:
    """Trees and the calibration of their predictions; held holds the grade of each training row by trees and a calibration
    that saw no row of its source (NaN where too few were left to learn from)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, groups: np.ndarray, folds: int = 5) -> None:
        held = np.full(len(y), np.nan)
        names = np.unique(groups)
        fold_of = {g: k % folds for k, g in enumerate(names[np.argsort([-(groups == g).sum() for g in names], kind="stable")])}
        fold = np.array([fold_of[g] for g in groups])
        for k in range(folds):
            test = fold == k
            if test.any() and (~test).sum() >= 20:
                held[test] = Trees().fit(x[~test], y[~test]).predict(x[test])
        ok = ~np.isnan(held)
        self.trees = Trees().fit(x, y)
        self.knots = isotonic(held[ok], y[ok]) if ok.sum() >= 50 else (np.array([1.0, 5.0]), np.array([1.0, 5.0]))
        self.held = np.full(len(y), np.nan)
        for k in range(folds):
            test, rest = ok & (fold == k), ok & (fold != k)
            if test.any() and rest.sum() >= 50:
                self.held[test] = np.clip(np.interp(held[test], *isotonic(held[rest], y[rest])), 1, 5)

    def calibrate(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, *self.knots)

    def grade(self, x: np.ndarray) -> np.ndarray:
        return self.calibrate(self.trees.predict(x))


# --- on tables --------------------------------------------------------------------------------------------------------

_MEASURED = "doc_id long, language string, " + ", ".join(f"{f} double" for f in FEATURES)


def _measure_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "language", *FEATURES]
    for frame in frames:
        rows = []
        for key, text in zip(frame["doc_id"], frame["body"]):
            if got := measure(text):
                rows.append((key, got[0], *got[1]))
        yield pd.DataFrame(rows, columns=names)


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, language, FEATURES) of every document with running text, once per doc_id, kept in the shared folder."""
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body"))
    return durable(rows.mapInPandas(_measure_batches, _MEASURED).dropDuplicates(["doc_id"]))


def scales(measures: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """language -> (mean, standard deviation) of the FEATURES over all documents; a row for each of a few languages."""
    known = F.coalesce(F.col("language"), F.lit(""))
    rows = measures.groupBy(known.alias("language")).agg(*(F.avg(f).alias(f"a_{f}") for f in FEATURES), *(F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES)).collect()
    return {r["language"]: (np.array([r[f"a_{f}"] for f in FEATURES]), np.maximum(np.array([r[f"s_{f}"] for f in FEATURES]), 1e-6)) for r in rows}


def _inputs(frame: pd.DataFrame, scale: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Features as measured and on the scale of their language, side by side."""
    raw = frame[list(FEATURES)].to_numpy(dtype=float)
    z = np.zeros_like(raw)
    languages = frame["language"].fillna("").to_numpy()
    for name in np.unique(languages):
        mean, sd = scale[name]
        mine = languages == name
        z[mine] = (raw[mine] - mean) / sd
    return np.hstack([z, raw[:, 10:15], raw[:, 18:24]])


#: Rated documents below which nothing is learnt.
LEAST_RATED = 10


def rated_rows(measures: DataFrame, labels: DataFrame, documents: DataFrame, rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """The measures of rated documents with their mean rating (null ratings left out) and source: at most `rows` of them, by hash."""
    from codeseam.llm.mixing import source_key

    rated = labels.where("doc_id is not null and reading_band is not null").groupBy("doc_id").agg(F.avg("reading_band").alias("band"))
    rated = small_side(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    source = documents.select("doc_id", source_key(F.col("source")).alias("group"))
    frame = measures.join(rated, "doc_id").join(source, "doc_id").toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    return frame.reset_index(drop=True)


def train(frame: pd.DataFrame, scale: dict[str, tuple[np.ndarray, np.ndarray]]) -> Grader:
    return Grader(_inputs(frame, scale), frame["band"].to_numpy(dtype=float), frame["group"].fillna("").to_numpy())


def graded(measures: DataFrame, grader: Grader, scale: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc_id, language, grade, band): the calibrated grade from 1 to 5 and the band nearest to it."""

    def grade(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                g = np.clip(grader.grade(_inputs(frame, scale)), 1, 5).round(4)
                yield pd.DataFrame({"doc_id": frame["doc_id"], "language": frame["language"], "grade": g, "band": np.floor(g + 0.5).astype("int32")})

    return measures.mapInPandas(grade, "doc_id long, language string, grade double, band int")


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, language, grade, band) of every document with running text; see the functions above.

    Documents without doc_id or running text have no level. With no documents the result is empty; with fewer than
    LEAST_RATED rated ones grade and band are null.
    """
    measures = measured(documents)
    scale = scales(measures)
    frame = rated_rows(measures, labels, documents) if scale else pd.DataFrame()
    if len(frame) < LEAST_RATED:
        return measures.select("doc_id", "language", F.lit(None).cast("double").alias("grade"), F.lit(None).cast("int").alias("band"))
    return graded(measures, train(frame, scale), scale)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(held_out, name, rated, mean_error, within_half): how near grades come to ratings of documents that weren't learnt from.

    held_out 'source': each source graded by trees and a calibration without it and the other sources of its fold;
    'language': each language graded by what was learnt from the others; 'all': all sources. A name without grade has nulls.
    """
    schema = "held_out string, name string, rated long, mean_error double, within_half double"
    measures = measured(documents)
    scale = scales(measures)
    frame = rated_rows(measures, labels, documents) if scale else pd.DataFrame()
    if len(frame) < LEAST_RATED:
        return documents.sparkSession.createDataFrame([], schema)
    y, groups, languages = frame["band"].to_numpy(dtype=float), frame["group"].fillna("").to_numpy(), frame["language"].fillna("").to_numpy()
    x = _inputs(frame, scale)
    held = Grader(x, y, groups).held
    found = [("all", "", np.ones(len(y), dtype=bool), held), *(("source", g, groups == g, held) for g in np.unique(groups))]
    for name in np.unique(languages):
        rest = languages != name
        by_others = np.full(len(y), np.nan)
        if rest.sum() >= LEAST_RATED:
            by_others[~rest] = np.clip(Grader(x[rest], y[rest], groups[rest]).grade(x[~rest]), 1, 5)
        found.append(("language", name, ~rest, by_others))
    rows = []
    for kind, name, mine, grades in found:
        error = np.abs(grades - y)[mine & ~np.isnan(grades)]
        rows.append((kind, str(name), int(mine.sum()), float(error.mean().round(4)) if len(error) else None, float((error <= 0.5).mean().round(4)) if len(error) else None))
    return documents.sparkSession.createDataFrame(rows, schema)
