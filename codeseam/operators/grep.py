"""Content search: line matching, relevance of files, context lines, and term statistics."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.session import distinct_rows, durable

#: Texts above this many bytes don't enter the term statistics (but are counted as documents).
MAX_TERM_BYTES = 256 * 1024
WORD_BREAK = r"[^\p{L}\p{N}_]+"
MODES = ("any", "all", "exact", "regex")
#: Bytes that are shown of a line.
SNIPPET_BYTES = 200


def terms_of(query: str) -> list[str]:
    return [t.lower() for t in query.split()]


def line_match(line: Column, query: str, mode: str) -> Column:
    """Whether a line matches: any term, all terms on the line, the exact phrase, or a regular expression; case is ignored.

    Raises ValueError for an empty query, an unknown mode or a pattern that isn't valid.
    """
    if not query.strip() or mode not in MODES:
        raise ValueError("empty query" if not query.strip() else f"match mode {mode}")
    low = F.lower(line)
    if mode == "regex":
        _check_pattern(query)
        return line.rlike("(?i)" + query)
    if mode == "exact":
        return F.contains(low, F.lit(query.lower()))
    hits = [F.contains(low, F.lit(t)) for t in terms_of(query)]
    return reduce(lambda a, b: a & b if mode == "all" else a | b, hits)


def _check_pattern(pattern: str) -> None:
    """Raises ValueError for a pattern that isn't valid where it will run: in Java, which knows other constructs than Python."""
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile("(?i)" + pattern)
    except (IllegalArgumentException, Py4JJavaError) as e:
        raise ValueError(f"invalid pattern: {str(e).splitlines()[0]}") from e


def words(text: Column) -> Column:
    """The different words of a text: letters, digits and _, at least two bytes, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), WORD_BREAK)), lambda w: F.octet_length(w) >= 2)


def term_doc_freq(files: DataFrame, text: str = "content") -> DataFrame:
    """(term, df): the number of files that hold each word; a file_id that occurs twice counts once."""
    small = distinct_rows(files.select("file_id", text), "file_id").where(F.octet_length(text) <= MAX_TERM_BYTES).select(words(F.col(text)).alias("w"))
    return small.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.lit(1.0), F.log((n + 1) / (df + 1)) + 1)


def holds_word(text: Column, term: str) -> Column:
    """Whether a text has the term among its words, without finding all of them: as array_contains(words(text), term)."""
    if len(term.encode()) < 2 or re.search(r"[^\w]", term):
        return F.lit(False)
    low, one = F.lower(text), r"[\p{L}\p{N}_]"
    return F.contains(low, F.lit(term)) & low.rlike(f"(?<!{one}){re.escape(term)}(?!{one})")


def _weights(counts: DataFrame, n_terms: int) -> DataFrame:
    """One row: idfs, the weight of each term, from n and how many files hold each; one that none holds counts as if in all."""
    each = [idf(F.when(F.col(f"d{k}") == 0, F.col("n")).otherwise(F.col(f"d{k}")), F.col("n")) for k in range(n_terms)]
    return counts.select(F.array(*each).alias("idfs"))


def relevance(matches: Column, total_lines: Column, name: Column, ext: Column, terms: list[str], seen: Column, first: Column, idfs: Column) -> Column:
    """How well a file fits: frequency and rarity, density, name, kind and position, times the coverage of the terms."""
    mean = F.aggregate(idfs, F.lit(0.0), lambda a, x: a + x) / F.size(idfs)
    named = reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(t)) for t in terms])
    density = matches / F.greatest(F.lit(1.0), F.sqrt(total_lines.cast("double")))
    position = F.when((total_lines > 30) & (first < 30), 3.0 * (1.0 - first / 30.0)).otherwise(0.0)
    base = matches / (matches + 1.5) * 15.0 * mean + F.when(named, 15.0).otherwise(0.0) + F.when(ext.isin(list(C.DEFINITION_EXTS)), 5.0).otherwise(0.0) + density + position
    if len(terms) <= 1:
        return base
    total = F.aggregate(idfs, F.lit(0.0), lambda a, x: a + x)
    found = F.aggregate(F.slice(F.array_sort(idfs), F.lit(1), F.greatest(seen, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    cover = F.when(total > 0, found / total).otherwise(1.0)
    return base * (0.3 + 0.7 * cover * cover)


def _holds(term: str):
    return lambda hit: F.contains(F.lower(hit["line"]), F.lit(term))


def _may_match(query: str, mode: str) -> Column:
    """A test of the whole text that no text with a matching line fails; cheap, and before anything is split into lines."""
    text = F.col("content")
    if mode != "regex":
        return line_match(text, query, "exact" if mode == "exact" else "any")
    return F.lit(True) if re.search(r"\\[AzZG]", query) else text.rlike("(?im)" + query)


def _with_hits(files: DataFrame, query: str, mode: str) -> DataFrame:
    """files with __lines and hits, an array of (idx, line) from 0, perhaps empty.

    Empty ones are left to the caller to drop after a shuffle: a filter here would have Spark find the lines twice.
    """
    line_match(F.lit(""), query, mode)  # refuses what isn't valid
    rows = files.where(_may_match(query, mode)).withColumn("__lines", C.lines(F.col("content")))
    return rows.withColumn("hits", F.filter(F.transform("__lines", lambda x, i: F.struct(i.alias("idx"), x.alias("line"))), lambda s: line_match(s["line"], query, mode)))


def matching_lines(files: DataFrame, query: str, mode: str) -> DataFrame:
    """(file_id, repo, path, filename, ext, hits, n_lines) of files with a hit, each once; only matching lines leave a task."""
    rows = _with_hits(files, query, mode).select("file_id", "repo", "path", "filename", "ext", "hits", F.greatest(F.size("__lines"), F.lit(1)).alias("n_lines"))
    return rows.dropDuplicates(["file_id"]).where(F.size("hits") > 0)


def _scanned(files: DataFrame, query: str, mode: str, terms: list[str]) -> DataFrame:
    """What a search needs of every file, in one reading of the texts: matches, best snippet, and which terms it holds."""
    line_match(F.lit(""), query, mode)  # refuses what isn't valid
    lines = C.lines(F.col("content"))
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("idx"), x.alias("line"))), lambda s: line_match(s["line"], query, mode))
    none = F.array().cast("array<struct<idx:int,line:string>>")
    rows = files.select("file_id", "repo", "path", "filename", "ext", F.when(
        _may_match(query, mode), numbered
    ).otherwise(none).alias("hits"), F.greatest(F.size(lines), F.lit(1)).alias("n_lines"),
                        *(((F.octet_length("content") <= MAX_TERM_BYTES) & holds_word(F.col("content"), t)).alias(f"h{k}") for k, t in enumerate(terms)))
    seen = sum((F.exists("hits", _holds(t)).cast("int") for t in terms), F.lit(0))
    in_line = lambda h: sum((F.contains(F.lower(h["line"]), F.lit(t)).cast("int") for t in terms), F.lit(0))
    best = F.array_max(F.transform("hits", lambda h: F.struct(in_line(h).alias("n"), (-h["idx"]).alias("minus"), h["line"].alias("line"))))
    return rows.select("file_id", "repo", "path", "filename", "ext", F.size("hits").alias("match_count"), F.get(
        F.col("hits"), F.lit(0)
    )["idx"].alias("first_line"), "n_lines", seen.alias("terms_matched"),
                       (-best["minus"] + 1).alias("best_line"), C.cut_line(best["line"], SNIPPET_BYTES).alias("snippet"), *(f"h{k}" for k in range(len(terms)))).dropDuplicates(["file_id"])


def grep(files: DataFrame, query: str, mode: str = "all", limit: int | None = 50, snippets: bool = False) -> DataFrame:
    """(repo, path, match_count, first_line, terms_matched, score), the best `limit` files, all in no order if None; ties in the order of repo and path.

    With snippets also best_line and snippet: the matching line with most of the terms, the first of these. Texts are
    read once; what is kept of them, a short row for each file, serves the weights of the terms and the scores.
    """
    if len(terms_of(query)) < 2 and mode == "all":
        mode = "any"
    terms = terms_of(query)
    rows = durable(_scanned(files, query, mode, terms))
    weights = _weights(rows.agg(F.count("*").alias("n"), *(F.count_if(f"h{k}").alias(f"d{k}") for k in range(len(terms)))), len(terms))
    scored = rows.where("match_count > 0").crossJoin(F.broadcast(weights))  # one row
    score = relevance(F.col("match_count"), F.col("n_lines"), F.col("filename"), F.col("ext"), terms, F.col("terms_matched"), F.col("first_line"), F.col("idfs"))
    more = ["best_line", "snippet"] if snippets else []
    out = scored.select("repo", "path", "match_count", "first_line", "terms_matched", F.round(score, 6).alias("score"), *more)
    return out if limit is None else out.orderBy(F.desc("score"), "repo", "path").limit(limit)


def first_matches(files: DataFrame, query: str, mode: str, per_file: int, width: int = 200) -> DataFrame:
    """(repo, path, line_no, line): the first per_file matching lines of each file, cut to a width."""
    hits = matching_lines(files, query, mode).select("repo", "path", F.explode(F.slice("hits", 1, per_file)).alias("h"))
    return hits.select("repo", "path", (F.col("h.idx") + 1).alias("line_no"), C.cut_line(F.col("h.line"), width).alias("line"))


def context_lines(files: DataFrame, query: str, mode: str, around: int) -> DataFrame:
    """(repo, path, block, line_no, is_match, line): matching lines with neighbours; blocks that touch are one."""
    rows = _with_hits(files, query, mode).withColumn("at", F.transform("hits", lambda h: h["idx"]))
    numbered = F.transform("__lines", lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    near = F.filter(numbered, lambda s: F.exists("at", lambda i: F.abs(i - s["pos"]) <= around))
    rows = rows.select("file_id", "repo", "path", "at", near.alias("near")).dropDuplicates(["file_id"]).select("file_id", "repo", "path", "at", F.explode("near").alias("n"))
    w = Window.partitionBy("file_id").orderBy("n.pos")
    starts = F.when(F.col("n.pos") - F.lag("n.pos").over(w) == 1, 0).otherwise(1)
    blocks = rows.withColumn("starts", starts).withColumn("block", F.sum("starts").over(w))
    return blocks.select("repo", "path", "block", (F.col("n.pos") + 1).alias("line_no"), F.array_contains("at", F.col("n.pos")).alias("is_match"), F.col("n.line").alias("line"))


def match_totals(files: DataFrame, query: str, mode: str, limit: int) -> DataFrame:
    """One row: matches in the files that are returned under the limit, and in all files."""
    rows = durable(grep(files, query, mode, None))
    everything = rows.agg(F.sum("match_count").alias("all_matches"), F.count("*").alias("all_files"))
    shown = rows.orderBy(F.desc("score"), "repo", "path").limit(limit).agg(F.sum("match_count").alias("shown_matches"), F.count("*").alias("shown_files"))
    return shown.crossJoin(F.broadcast(everything))  # one row each
