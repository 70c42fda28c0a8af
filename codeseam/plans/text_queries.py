"""Queries over files, lines and terms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.operators import grep as G
from codeseam.operators import stats, views
from codeseam.session import table
from codeseam.sources import corpus

TERMS = "graph session"
PATTERN = r"cache_[a-z]+\(|verify[A-Z]\w+"
PHRASE = "see the note on retries"

FILES = r"""files AS (
  SELECT DISTINCT file_id, repo, path, regexp_extract(path, '([^/]*)$', 1) AS filename, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\.([^.]*)$', 1)) AS ext, size, mtime, content
  FROM (SELECT file_id, repo, replace(rel_path, '\', '/') AS path, size, mtime, content FROM source_files WHERE content IS NOT NULL AND rel_path IS NOT NULL))"""
CATEGORISED = FILES + r""",
cfg AS (SELECT DISTINCT ON (repo) repo, scan_dirs, noise_dirs FROM scan_configs),
cat0 AS (SELECT f.*, coalesce(scan_dirs, []) AS sd, coalesce(noise_dirs, []) AS nd FROM files f LEFT JOIN cfg USING (repo)),
cat1 AS (SELECT *, list_filter(sd, lambda x: starts_with(path, x || '/'))[1] AS pre FROM cat0),
cat2 AS (SELECT *, string_split(CASE WHEN pre IS NOT NULL THEN substr(path, length(pre) + 2) ELSE path END, '/') AS parts FROM cat1),
cat3 AS (SELECT *, list_filter(parts[1:len(parts)-1], lambda x: NOT list_contains(nd, x)) AS dirs FROM cat2),
categorised AS (SELECT file_id, repo, path, filename, ext, size, mtime, content, CASE WHEN len(dirs) = 0 THEN 'Other' ELSE array_to_string(dirs[1:5], ' > ') END AS category FROM cat3)"""
LINES = FILES + r""",
bodies AS (SELECT file_id, repo, path, filename, ext, string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n') AS ls FROM files WHERE content <> ''),
lines AS (SELECT file_id, repo, path, filename, ext, len(ls) AS n_lines, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS idx FROM bodies)"""


def _in_list(groups: dict, column: str, default: str) -> str:
    cases = " ".join(f"WHEN {column} IN ({', '.join(repr(x) for x in members.split())}) THEN {value!r}" for value, members in groups.items())
    return f"CASE {cases} ELSE {default} END"


# --- columns ----------------------------------------------------------------------------------------------------------


def describe_files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select("file_id", C.describe(F.col("path")).alias("description"), C.stem(F.col("path")).alias("stem"), C.directory(F.col("path")).alias("dir"))


def category_path(spark: SparkSession, d: str) -> DataFrame:
    return corpus.categorised(spark, d).select("file_id", "category")


def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return corpus.files(spark, d).select(
        "file_id", "ext", C.lookup(F.col("ext"), C.FAMILIES, "unknown").alias("family"),
        F.col("ext").isin(list(C.DEFINITION_EXTS)).alias("is_definition"), C.embeddable(p, F.col("bytes")).alias("is_embeddable")
    )


def char_bitmask(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select("file_id", C.bitmask(F.col("filename")).alias("name_mask"), C.bitmask(F.col("path")).alias("path_mask"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", C.tokens(t).alias("tokens"), C.read_tokens(t).alias("read_tokens"), C.token_level(C.tokens(t) * 20).alias("level"),
        C.snippet(t).alias("snippet")
    )


def line_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blame_lines").where("content is not null").select("blame_id", C.cut_line(F.col("content"), 40).alias("line")).distinct()


def path_header(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select("file_id", C.path_header(F.col("path")).alias("header"))


def path_guard(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("file_id") % 7 == 0, F.concat(F.lit("/"), F.col("path"))).when(
        F.col("file_id") % 7 == 1, F.concat(F.lit("../"), F.col("path"))
    ).when(F.col("file_id") % 7 == 2, F.lit("")).otherwise(F.col("path"))
    return corpus.files(spark, d).select("file_id", C.path_error(raw).alias("error"))


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Queries without the known extensions of file names in them, word by word."""
    known = [e for group in C.HINTS.values() for e in group.split() if e not in {"props", "targets"}]
    word = lambda w: F.when(
        F.regexp_extract(w, r"\.([^.]*)$", 1).isin(known) & (F.length(F.regexp_replace(w, r"\.[^.]*$", "")) > 0), F.regexp_replace(w, r"\.[^.]*$", "")
    ).otherwise(w)
    words = F.filter(F.split(F.concat("raw_query", F.when(F.col("query_id") % 3 == 0, ".py").otherwise(" .md x.zip")), r"\s+"), lambda w: w != "")
    return table(spark, d, "find_queries").where("raw_query is not null").select("query_id", F.array_join(F.transform(words, word), " ").alias("stripped"))


def color_slots(spark: SparkSession, d: str) -> DataFrame:
    return corpus.categorised(spark, d).select("category").distinct().select("category", C.color_slot(F.split("category", " > ")[0]).alias("slot"))


def static_importance(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select("file_id", F.round(C.importance(F.col("path"), F.col("bytes")), 6).alias("importance"))


def query_importance(spark: SparkSession, d: str) -> DataFrame:
    terms = G.terms_of(TERMS)
    score = C.query_importance(F.col("path"), F.col("content"), terms) + C.importance(F.col("path"), F.col("bytes"))
    return corpus.once(corpus.file_rows(spark, d).select("file_id", F.round(score, 6).alias("importance")))


# --- filters ----------------------------------------------------------------------------------------------------------


def ext_filter(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).where(F.col("ext").isin("py", "rs", "h")).select("file_id", "ext")


def path_prefix(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).where(F.col("path").startswith("src/")).select("file_id", "path")


def module_subtree(spark: SparkSession, d: str) -> DataFrame:
    """Files of the category named after each repository's first one, and of those below it."""
    rows = corpus.categorised(spark, d).select("file_id", "repo", "category")
    first = rows.groupBy("repo").agg(F.min("category").alias("first")).select("repo", F.split("first", " > ")[0].alias("module"))
    return rows.join(first, "repo").where(C.in_module(F.col("category"), F.col("module"))).select("file_id", "module", "category")


def category_prefix(spark: SparkSession, d: str) -> DataFrame:
    return corpus.categorised(spark, d).where(F.col("category").startswith("tas")).select("file_id", "category")


def keyword_haystack(spark: SparkSession, d: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "path", C.describe(F.col("path")), "category"))
    return corpus.categorised(spark, d).where(F.contains(hay, F.lit("cache")) & F.contains(hay, F.lit("core"))).select("file_id", "path")


def module_list(spark: SparkSession, d: str) -> DataFrame:
    modules = stats.modules(corpus.categorised(spark, d)).where(F.col("id").startswith("tas"))
    return modules.orderBy("id").limit(40).select("id", "name", "file_count")


# --- grep -------------------------------------------------------------------------------------------------------------


def grep_any_topk(spark: SparkSession, d: str) -> DataFrame:
    return G.grep(corpus.file_rows(spark, d), TERMS, "any", 50)


def grep_all_topk(spark: SparkSession, d: str) -> DataFrame:
    return G.grep(corpus.file_rows(spark, d), TERMS, "all", 50)


def grep_exact(spark: SparkSession, d: str) -> DataFrame:
    return G.grep(corpus.file_rows(spark, d), PHRASE, "exact", 100)


def grep_regex(spark: SparkSession, d: str) -> DataFrame:
    return G.grep(corpus.file_rows(spark, d), PATTERN, "regex", 100)


def grep_files_only(spark: SparkSession, d: str) -> DataFrame:
    return G.matching_lines(corpus.file_rows(spark, d), TERMS, "any").select("repo", "path", F.size("hits").alias("match_count"))


def grep_max_per_file(spark: SparkSession, d: str) -> DataFrame:
    return G.first_matches(corpus.file_rows(spark, d), TERMS, "any", 8, 40)


def grep_context(spark: SparkSession, d: str) -> DataFrame:
    return G.context_lines(corpus.file_rows(spark, d), PHRASE, "exact", 2)


def grep_total_matches(spark: SparkSession, d: str) -> DataFrame:
    return G.match_totals(corpus.file_rows(spark, d), TERMS, "any", 50)


def term_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return G.term_doc_freq(corpus.file_rows(spark, d))


def term_idf_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.file_rows(spark, d)
    n = corpus.files(spark, d).agg(F.count("*").alias("n"))
    weighted = G.term_doc_freq(rows).where("df >= 3").crossJoin(F.broadcast(n))  # one row
    return weighted.select("term", "df", F.round(G.idf(F.col("df"), F.col("n")), 6).alias("idf")).orderBy(F.desc("idf"), "term").limit(100)


def read_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3 to 5 of every file, numbered and right-aligned."""
    few = F.transform(F.slice(C.lines(F.col("content")), 3, 3), lambda x, i: F.concat(F.lpad((i + 3).cast("string"), 5, " "), F.lit(" | "), x))
    return corpus.once(corpus.file_rows(spark, d).select("file_id", few.alias("few"))).select("file_id", F.explode("few").alias("numbered"))


def batch_read(spark: SparkSession, d: str) -> DataFrame:
    """The files of all search results, with their size and lines, or why there is none."""
    rows = corpus.file_rows(spark, d).select("repo", "path", "bytes", F.size(C.lines(F.col("content"))).alias("n_lines"))
    rows = rows.groupBy("repo", "path").agg(F.max("bytes").alias("bytes"), F.max("n_lines").alias("n_lines"))
    wanted = table(spark, d, "find_results").select("repo", F.translate("rel_path", "\\", "/").alias("path")).distinct()
    return wanted.join(rows, ["repo", "path"], "left").select("repo", "path", "bytes", "n_lines", F.when(F.col("bytes").isNull(), "not found").alias("error"))


# --- statistics -------------------------------------------------------------------------------------------------------


def search_modules(spark: SparkSession, d: str) -> DataFrame:
    return stats.modules(corpus.categorised(spark, d))


def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.totals(corpus.categorised(spark, d))


def stats_lang_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return stats.languages(corpus.files(spark, d), 8)


def stats_size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return stats.size_buckets(corpus.files(spark, d))


def stats_top_files(spark: SparkSession, d: str) -> DataFrame:
    return stats.largest(corpus.files(spark, d), 20)


def facets(spark: SparkSession, d: str) -> DataFrame:
    return stats.facets(corpus.categorised(spark, d))


def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.status(corpus.categorised(spark, d))


def subtree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.subtrees(corpus.categorised(spark, d))


def tri_state_selection(spark: SparkSession, d: str) -> DataFrame:
    return stats.selection(corpus.categorised(spark, d).withColumn("selected", F.col("ext").isin("py", "rs")))


def group_best(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "find_results").dropDuplicates(["result_id"])
    return stats.group_best(rows, "category", "grep_count")


def selection_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: paths selected by one rule, added by another, in both, and left after removal."""
    return stats.selections(corpus.files(spark, d), F.col("ext") == "py", F.col("path").startswith("src/"))


def prompt_sink(spark: SparkSession, d: str) -> DataFrame:
    """Paths by repository and category as texts of at most 200 paths, ready to be pasted."""
    return views.path_prompts(corpus.categorised(spark, d))


def content_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The same with the texts of all files, fifty a piece."""
    return views.content_prompts(corpus.distinct_file_rows(spark, d), 50).select("repo", "piece", "files", F.length("text").alias("chars"), F.md5("text").alias("digest"))


QUERIES = (
    describe_files, category_path, file_kinds, char_bitmask, token_estimate, line_truncate, path_header, path_guard, query_tokens, color_slots, static_importance, query_importance, ext_filter, path_prefix, module_subtree,
    category_prefix, keyword_haystack, module_list, grep_any_topk, grep_all_topk, grep_exact, grep_regex, grep_files_only, grep_max_per_file, grep_context, grep_total_matches, term_doc_freq, term_idf_topk, read_lines, batch_read,
    search_modules, stats_totals, stats_lang_breakdown, stats_size_buckets, stats_top_files, facets, status_rollup, subtree_rollup, tri_state_selection, group_best, selection_algebra, prompt_sink, content_prompt,
)

# --- SQL --------------------------------------------------------------------------------------------------------------

_STEM = r"regexp_replace(filename, '\.[^.]*$', '')"
_PATH_EXT = r"regexp_extract(filename, '\.([^.]*)$', 1)"
_WORDS = r"trim(translate(regexp_replace(regexp_replace({stem}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '_-', '  '))".format(stem=_STEM)
_HINT = _in_list(C.HINTS, _PATH_EXT, "''")
_DESC = f"CASE WHEN {_HINT} = '' THEN {_WORDS} ELSE {_WORDS} || ' (' || {_HINT} || ')' END"
_BYTES = "octet_length(encode({}))"
_BONUS = " + ".join(f"CASE WHEN contains(upper({_STEM}), '{k}') THEN {v} ELSE 0.0 END" for k, v in C.NAME_BONUS.items())
_WEIGHT = "CASE " + " ".join(f"WHEN {_PATH_EXT} IN ({', '.join(repr(x) for x in m.split())}) THEN {w}" for w, m in C.EXT_WEIGHTS.items()) + " ELSE 0.08 END"
_IMPORTANCE = f"(({_WEIGHT}) + least(0.2, {_BONUS}) + CASE WHEN {_BYTES.format('content')} < 5000 THEN 0.05 WHEN {_BYTES.format('content')} < 20000 THEN 0.02 ELSE 0.0 END)"
_EXTS = ", ".join(repr(x) for x in C.EMBEDDABLE)
_MASK = lambda c: " + ".join(f"CASE WHEN contains(lower({c}), '{ch}') THEN {1 << n} ELSE 0 END" for n, ch in enumerate("abcdefghijklmnopqrstuvwxyz0123456789_-./"))
_KNOWN = ", ".join(repr(e) for g in C.HINTS.values() for e in g.split() if e not in {"props", "targets"})
_TERM_SETS = r""",
docs AS (SELECT file_id, list_filter(list_distinct(string_split_regex(lower(content), '[^\p{L}\p{N}_]+')), lambda w: octet_length(encode(w)) >= 2) AS w FROM files WHERE octet_length(encode(content)) <= 262144),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM docs) GROUP BY term),
n AS (SELECT count(*) AS n FROM files)"""


def _grep_sql(match: str, terms: list[str], limit: int) -> str:
    seen = " + ".join(f"CASE WHEN bool_or(contains(lower(line), '{t}')) THEN 1 ELSE 0 END" for t in terms)
    idfs = ", ".join(f"greatest(1.0, ln((n + 1) / (coalesce((SELECT df FROM df WHERE term = '{t}'), n) + 1)) + 1)" for t in terms)
    named = " OR ".join(f"contains(lower(filename), '{t}')" for t in terms)
    defs = ", ".join(repr(x) for x in C.DEFINITION_EXTS)
    cover = "(CASE WHEN list_sum(i.w) > 0 THEN coalesce(list_sum(list_sort(i.w)[1:terms_matched]), 0) / list_sum(i.w) ELSE 1.0 END)"
    factor = "1.0" if len(terms) <= 1 else f"(0.3 + 0.7 * {cover} * {cover})"
    return LINES + _TERM_SETS + f""",
i AS (SELECT [{idfs}] AS w FROM n),
hits AS (SELECT repo, path, filename, ext, n_lines, count(*) AS match_count, min(idx) AS first_line, {seen} AS terms_matched FROM lines WHERE {match} GROUP BY file_id, repo, path, filename, ext, n_lines),
scored AS (SELECT repo, path, match_count, first_line, terms_matched,
  round((match_count / (match_count + 1.5) * 15.0 * list_avg(i.w) + CASE WHEN {named} THEN 15.0 ELSE 0.0 END + CASE WHEN ext IN ({defs}) THEN 5.0 ELSE 0.0 END
   + match_count / greatest(1.0, sqrt(n_lines::DOUBLE)) + CASE WHEN n_lines > 30 AND first_line < 30 THEN 3.0 * (1.0 - first_line / 30.0) ELSE 0.0 END) * {factor}, 6) AS score FROM hits, i)
SELECT * FROM scored ORDER BY score DESC, repo, path LIMIT {limit}"""


_ANY = "(contains(lower(line), 'graph') OR contains(lower(line), 'session'))"
_ALL = "(contains(lower(line), 'graph') AND contains(lower(line), 'session'))"
_EXACT = f"contains(lower(line), '{PHRASE}')"
_ANCESTORS = "unnest(list_transform(range(1, len(string_split(category, ' > ')) + 1), lambda n: array_to_string(string_split(category, ' > ')[1:n], ' > '))) AS node"

SQL = {
    "describe_files": f"WITH {FILES} SELECT file_id, {_DESC} AS description, {_STEM} AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files",
    "category_path": f"WITH {CATEGORISED} SELECT file_id, category FROM categorised",
    "file_kinds": f"""WITH {FILES} SELECT file_id, ext, {_in_list(C.FAMILIES, 'ext', "'unknown'")} AS family, ext IN ({', '.join(repr(x) for x in C.DEFINITION_EXTS)}) AS is_definition,
        {_PATH_EXT} IN ({_EXTS}) AND NOT regexp_matches('/' || lower(path), '/({'|'.join(C.EMBED_SKIP_DIRS)})/') AND {_BYTES.format('content')} <= 524288 AS is_embeddable FROM files""",
    "char_bitmask": f"WITH {FILES} SELECT file_id, {_MASK('filename')} AS name_mask, {_MASK('path')} AS path_mask FROM files",
    "token_estimate": f"SELECT doc_id, ceil({_BYTES.format('text')} / 3)::BIGINT AS tokens, floor({_BYTES.format('text')} / 4)::BIGINT AS read_tokens, CASE WHEN ceil({_BYTES.format('text')} / 3) * 20 > 100000 THEN 'danger' WHEN ceil({_BYTES.format('text')} / 3) * 20 > 50000 THEN 'warn' ELSE 'ok' END AS level, substr(text, 1, 200) AS snippet FROM documents WHERE text IS NOT NULL",
    "line_truncate": "SELECT DISTINCT blame_id, CASE WHEN strlen(content) > 40 THEN substr(content, 1, list_max(list_filter(range(0, 41), lambda n: strlen(substr(content, 1, n)) <= 40))) || '...' ELSE content END AS line FROM blame_lines WHERE content IS NOT NULL",
    "path_header": f"""WITH {FILES}, p AS (SELECT file_id, filename, list_filter(string_split(path, '/'), lambda x: x <> filename AND x NOT IN ({', '.join(repr(x) for x in C.CONTEXT_NOISE)})) AS parts FROM files)
        SELECT file_id, CASE WHEN len(parts) = 0 THEN '// File: ' || filename ELSE '// File: ' || filename || ' (' || array_to_string(parts[greatest(len(parts) - 2, 1):len(parts)], ' > ') || ')' END AS header FROM p""",
    "path_guard": f"WITH {FILES} SELECT file_id, CASE WHEN file_id % 7 = 0 THEN 'absolute' WHEN file_id % 7 = 1 THEN 'parent' WHEN file_id % 7 = 2 THEN 'empty' WHEN contains(path, '..') THEN 'parent' WHEN starts_with(path, '/') THEN 'absolute' END AS error FROM files",
    "query_tokens": rf"""SELECT query_id, array_to_string(list_transform(list_filter(string_split_regex(raw_query || CASE WHEN query_id % 3 = 0 THEN '.py' ELSE ' .md x.zip' END, '\s+'), lambda w: w <> ''),
        lambda w: CASE WHEN regexp_extract(w, '\.([^.]*)$', 1) IN ({_KNOWN}) AND length(regexp_replace(w, '\.[^.]*$', '')) > 0 THEN regexp_replace(w, '\.[^.]*$', '') ELSE w END), ' ') AS stripped FROM find_queries WHERE raw_query IS NOT NULL""",
    "color_slots": f"""WITH {CATEGORISED}, c AS (SELECT DISTINCT category, string_split(category, ' > ')[1] AS top FROM categorised),
        h AS (SELECT category, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(top, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: ((a * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM c)
        SELECT category, (abs(h) % 8)::INT AS slot FROM h""",
    "static_importance": f"WITH {FILES} SELECT file_id, round({_IMPORTANCE}, 6) AS importance FROM files",
    "query_importance": f"""WITH {FILES} SELECT file_id, round({' + '.join(f"CASE WHEN contains(lower(path), '{t}') THEN 10.0 ELSE 0.0 END + CASE WHEN contains(lower(substr(content, 1, 4000)), '{t}') THEN 3.0 ELSE 0.0 END" for t in TERMS.split())} + {_IMPORTANCE}, 6) AS importance
        FROM files""",
    "ext_filter": f"WITH {FILES} SELECT file_id, ext FROM files WHERE ext IN ('py', 'rs', 'h')",
    "path_prefix": f"WITH {FILES} SELECT file_id, path FROM files WHERE starts_with(path, 'src/')",
    "module_subtree": f"""WITH {CATEGORISED}, f AS (SELECT repo, string_split(min(category), ' > ')[1] AS module FROM categorised GROUP BY repo)
        SELECT file_id, module, category FROM categorised JOIN f USING (repo) WHERE category = module OR starts_with(category, module || ' > ')""",
    "category_prefix": f"WITH {CATEGORISED} SELECT file_id, category FROM categorised WHERE starts_with(category, 'tas')",
    "keyword_haystack": f"WITH {CATEGORISED}, h AS (SELECT file_id, path, lower(path || ' ' || {_DESC} || ' ' || category) AS hay FROM categorised) SELECT file_id, path FROM h WHERE contains(hay, 'cache') AND contains(hay, 'core')",
    "module_list": f"WITH {CATEGORISED} SELECT category AS id, string_split(category, ' > ')[-1] AS name, count(*) AS file_count FROM categorised WHERE starts_with(category, 'tas') GROUP BY category ORDER BY id LIMIT 40",
    "grep_any_topk": "WITH " + _grep_sql(_ANY, TERMS.split(), 50),
    "grep_all_topk": "WITH " + _grep_sql(_ALL, TERMS.split(), 50),
    "grep_exact": "WITH " + _grep_sql(_EXACT, PHRASE.split(), 100),
    "grep_regex": "WITH " + _grep_sql(f"regexp_matches(line, '(?i){PATTERN}')", [PATTERN.lower()], 100),
    "grep_files_only": f"WITH {LINES} SELECT repo, path, count(*) AS match_count FROM lines WHERE {_ANY} GROUP BY file_id, repo, path",
    "grep_max_per_file": f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS k FROM lines WHERE {_ANY}) SELECT repo, path, idx + 1 AS line_no, CASE WHEN strlen(line) > 40 THEN substr(line, 1, list_max(list_filter(range(0, 41), lambda n: strlen(substr(line, 1, n)) <= 40))) || '...' ELSE line END AS line FROM r WHERE k <= 8",
    "grep_context": f"""WITH {LINES}, m AS (SELECT *, max(CASE WHEN {_EXACT} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines),
        k AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY file_id ORDER BY idx) = 1 THEN 0 ELSE 1 END AS s FROM m WHERE near = 1)
        SELECT repo, path, sum(s) OVER (PARTITION BY file_id ORDER BY idx) AS block, idx + 1 AS line_no, {_EXACT} AS is_match, line FROM k""",
    "grep_total_matches": f"""SELECT s.shown_matches, s.shown_files, a.all_matches, a.all_files FROM (SELECT sum(match_count) AS shown_matches, count(*) AS shown_files FROM (WITH {_grep_sql(_ANY, TERMS.split(), 50)})) s,
        (SELECT sum(m) AS all_matches, count(*) AS all_files FROM (WITH {LINES} SELECT file_id, count(*) AS m FROM lines WHERE {_ANY} GROUP BY file_id)) a""",
    "term_doc_freq": f"WITH {FILES}{_TERM_SETS} SELECT term, df FROM df",
    "term_idf_topk": f"WITH {FILES}{_TERM_SETS} SELECT term, df, round(greatest(1.0, ln((n + 1) / (df + 1)) + 1), 6) AS idf FROM df, n WHERE df >= 3 ORDER BY idf DESC, term LIMIT 100",
    "read_lines": f"WITH {LINES} SELECT file_id, lpad((idx + 1)::VARCHAR, 5, ' ') || ' | ' || line AS numbered FROM lines WHERE idx BETWEEN 2 AND 4",
    "batch_read": rf"""WITH {LINES}, r AS (SELECT repo, path, max({_BYTES.format('content')}) AS bytes FROM files GROUP BY repo, path), l AS (SELECT repo, path, max(n_lines) AS n_lines FROM lines GROUP BY repo, path)
        SELECT w.repo, w.path, bytes, CASE WHEN bytes IS NULL THEN NULL ELSE coalesce(n_lines, 0) END AS n_lines, CASE WHEN bytes IS NULL THEN 'not found' END AS error
        FROM (SELECT DISTINCT repo, replace(rel_path, '\', '/') AS path FROM find_results) w LEFT JOIN r USING (repo, path) LEFT JOIN l USING (repo, path)""",
    "search_modules": f"WITH {CATEGORISED} SELECT category AS id, lower(category) AS id_lower, string_split(category, ' > ')[-1] AS name, count(*) AS file_count FROM categorised GROUP BY category",
    "stats_totals": f"WITH {CATEGORISED} SELECT count(*) AS files, sum({_BYTES.format('content')}) AS bytes, ceil(sum({_BYTES.format('content')}) / 40)::BIGINT AS loc, count(DISTINCT string_split(category, ' > ')[1]) AS modules FROM categorised",
    "stats_lang_breakdown": f"WITH {FILES} SELECT ext, count(*) AS files, sum({_BYTES.format('content')}) AS bytes FROM files WHERE ext <> '' GROUP BY ext ORDER BY files DESC, ext LIMIT 8",
    "stats_size_buckets": f"WITH {FILES} SELECT CASE WHEN {_BYTES.format('content')} < 1000 THEN '<1K' WHEN {_BYTES.format('content')} < 10000 THEN '<10K' WHEN {_BYTES.format('content')} < 100000 THEN '<100K' WHEN {_BYTES.format('content')} < 1000000 THEN '<1M' ELSE '>=1M' END AS bucket, count(*) AS files FROM files GROUP BY 1",
    "stats_top_files": f"WITH {FILES} SELECT repo, path, {_BYTES.format('content')} AS bytes FROM files ORDER BY bytes DESC, repo, path LIMIT 20",
    "facets": f"WITH {CATEGORISED} SELECT 'ext' AS facet, ext AS value, count(*) AS files FROM categorised WHERE ext <> '' GROUP BY ext UNION ALL SELECT 'category', category, count(*) FROM categorised WHERE category <> '' GROUP BY category",
    "status_rollup": f"WITH {CATEGORISED} SELECT repo, count(*) AS files, count(DISTINCT category) AS modules FROM categorised GROUP BY ROLLUP (repo)",
    "subtree_rollup": f"WITH {CATEGORISED} SELECT node, count(*) AS files, count(DISTINCT nullif(ext, '')) AS exts FROM (SELECT ext, {_ANCESTORS} FROM categorised) GROUP BY node",
    "tri_state_selection": f"WITH {CATEGORISED} SELECT node, count(*) AS files, count(*) FILTER (WHERE sel) AS selected, CASE WHEN bool_and(sel) THEN 'all' WHEN bool_or(sel) THEN 'some' ELSE 'none' END AS state FROM (SELECT ext IN ('py', 'rs') AS sel, {_ANCESTORS} FROM categorised) GROUP BY node",
    "group_best": "SELECT category, count(*) AS members, max(grep_count) AS best FROM (SELECT DISTINCT result_id, category, grep_count FROM find_results) GROUP BY category",
    "selection_algebra": f"""WITH {FILES}, s AS (SELECT DISTINCT repo, path, ext = 'py' AS a, starts_with(path, 'src/') AS b FROM files)
        SELECT repo, count(*) FILTER (WHERE a OR b) AS n_union, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_left FROM s GROUP BY repo""",
    "prompt_sink": f"""WITH {CATEGORISED}, p AS (SELECT repo, category, path, (row_number() OVER (PARTITION BY repo, category ORDER BY path) - 1) // 200 AS piece FROM (SELECT DISTINCT repo, category, path FROM categorised))
        SELECT repo, category, piece, '## ' || category || chr(10) || string_agg('- ' || path, chr(10) ORDER BY path) AS text FROM p GROUP BY repo, category, piece""",
    "content_prompt": f"""WITH {FILES}, p AS (SELECT repo, path, content, (row_number() OVER (PARTITION BY repo ORDER BY path, file_id) - 1) // 50 AS piece, file_id FROM files),
        t AS (SELECT repo, piece, count(*) AS files, string_agg('// File: ' || path || chr(10) || content, chr(10) || chr(10) ORDER BY path, file_id) AS text FROM p GROUP BY repo, piece)
        SELECT repo, piece, files, length(text) AS chars, md5(text) AS digest FROM t""",
}


def typed(sql: str, columns: str, kind: str) -> str:
    """The SQL with some columns cast, where DuckDB's type of a count, sum or literal isn't Spark's."""
    return "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS {kind}) AS {c}" for c in columns.split()) + f") FROM ({sql})"


for _name, _columns, _kind in (
    ("static_importance", "importance", "DOUBLE"), ("query_importance", "importance", "DOUBLE"), (
        "grep_any_topk", "match_count first_line", "INT"
    ), ("grep_all_topk", "match_count first_line", "INT"), ("grep_exact", "match_count first_line", "INT"),
    (
        "grep_regex", "match_count first_line", "INT"
    ), ("grep_files_only", "match_count", "INT"), ("grep_max_per_file", "line_no", "INT"), ("grep_context", "line_no", "INT"), ("grep_context", "block", "BIGINT"), (
        "grep_total_matches", "shown_matches all_matches", "BIGINT"
    ),
    ("batch_read", "bytes n_lines", "INT"), ("stats_totals", "bytes", "BIGINT"), ("stats_lang_breakdown", "bytes", "BIGINT"), ("stats_top_files", "bytes", "INT"), (
        "selection_algebra", "n_union n_both n_left", "BIGINT"
    ), ("content_prompt", "chars", "INT"),
):
    SQL[_name] = typed(SQL[_name], _columns, _kind)
