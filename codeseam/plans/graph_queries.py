"""Queries over search, vectors, graphs, budgets, history and increments, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.operators import budget, fuzzy, graph, history, incremental, ranking, stats, stubs, treemap
from codeseam.operators import grep as G
from codeseam.plans.text_queries import _ANY, _BYTES, _IMPORTANCE, CATEGORISED, FILES, LINES, TERMS, _grep_sql, typed
from codeseam.session import table
from codeseam.sources import corpus

WORD, FUZZY = "cache", "rtgrph"
ROOTS = ("region:0",)
SELECTED = ("s1", "s2", "s3", "s4")
HISTORY_PATH, SINCE = "part/7", "1998-01-01 00:00:00"

# --- names and hybrid search ------------------------------------------------------------------------------------------


def name_rank(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.name_rank(corpus.files(spark, d), WORD, 60)


def fuzzy_file_search(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.search_files(corpus.files(spark, d), FUZZY, 30)


def fuzzy_module_search(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.search_modules(stats.modules(corpus.categorised(spark, d)), "tas co", 20)


def hybrid_find(spark: SparkSession, d: str) -> DataFrame:
    return ranking.find(fuzzy.name_rank(corpus.files(spark, d), WORD, None), G.grep(corpus.file_rows(spark, d), TERMS, "any", None), 2, 60)


def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    """The name and content scores of all stored results, combined per query."""
    rows = table(spark, d, "find_results").dropDuplicates(["result_id"]).select("result_id", "query_id", "name_score", "grep_score", "total_terms")
    return ranking.hybrid(rows, ["query_id"], "name_score", "grep_score", "total_terms").select("result_id", "combined", "match")


def result_facets(spark: SparkSession, d: str) -> DataFrame:
    """Results per query by extension, at most six extensions each."""
    rows = table(spark, d, "find_results").dropDuplicates(["result_id"]).where("ext is not null and ext <> ''").groupBy(
        "query_id", F.lower("ext").alias("ext")
    ).agg(F.count("*").alias("results"))
    top = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("results"), "ext")))
    return top.where("n <= 6").select("query_id", "ext", "results")


def _query(spark: SparkSession, d: str, vec_id: int) -> DataFrame:
    return corpus.chunks(spark, d).where(F.col("start_line") == vec_id).select(F.col("embedding").alias("query"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.nearest(corpus.chunks(spark, d), _query(spark, d, 7), 20, None)


def vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    return ranking.nearest(corpus.chunks(spark, d), _query(spark, d, 7), None)


def vector_rerank(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rerank(corpus.chunks(spark, d), _query(spark, d, 7), ["engine", "label", "src"], 10)


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus.chunks(spark, d)
    lists = [ranking.nearest(chunks, _query(spark, d, v), 40, None).select(F.concat_ws("#", "file_path", "start_line").alias("key"), F.col("cosine").alias("score")) for v in (7, 8)]
    return ranking.reciprocal_ranks(lists, "key", "score", 50)


# --- graphs -----------------------------------------------------------------------------------------------------------


def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return graph.extract_imports(corpus.file_rows(spark, d)).select("repo", "src", "target").distinct()


def _imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files whose names are cut to their last word, so that imports of such words find them."""
    rows = corpus.files(spark, d)
    name = F.concat(F.regexp_extract(F.regexp_replace("filename", r"\.[^.]*$", ""), r"([^_]*)$", 1), F.lit("."), "ext")
    cut = rows.withColumn("path", F.lower(F.concat(C.directory(F.col("path")), F.lit("/"), name))).withColumn("filename", C.filename(F.col("path")))
    return graph.extract_imports(corpus.file_rows(spark, d)), cut.dropDuplicates(["repo", "path"])


def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    imports, files = _imports(spark, d)
    return graph.resolve_imports(imports, files)


def cross_repo_edges(spark: SparkSession, d: str) -> DataFrame:
    imports, files = _imports(spark, d)
    return graph.cross_repo_edges(graph.resolve_imports(imports, files), files)


def direct_imports(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(corpus.fk_edges(spark, d), "nation:3")


def impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(corpus.fk_edges(spark, d), list(ROOTS), 5)


def impact_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return impact(spark, d).groupBy("depth").agg(F.count("*").alias("files"))


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From one order to each region: one of them can be reached."""
    return graph.shortest_paths(corpus.fk_edges(spark, d), "orders:1", [f"region:{r}" for r in range(5)])


def dep_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(corpus.module_deps(spark, d))


def shared_deps(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared(corpus.module_deps(spark, d), list(SELECTED))


def reverse_deps(spark: SparkSession, d: str) -> DataFrame:
    return graph.reverse_index(corpus.module_deps(spark, d))


def dep_expansion(spark: SparkSession, d: str) -> DataFrame:
    deps = corpus.module_deps(spark, d)
    return graph.expand(deps, deps.where(F.col("module").isin(list(SELECTED))).select("module"))


def dep_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree over deps in which every part is in turn a module of the supplier of its number."""
    deps = corpus.module_deps(spark, d)
    back = deps.where("kind = 'private'").select(F.col("dep").alias("module"), F.concat(F.lit("s"), F.substring("dep", 2, 9)).alias("dep"), "kind").distinct()
    return graph.levels(deps.where("module in ('s1','s2','s3')").unionByName(back), "s1", 2)


def longest_module(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.categorised(spark, d).select("file_id", "repo", "category")
    modules = rows.where("file_id % 3 = 0").select(F.col("category").alias("module_category")).distinct().select(F.col("module_category").alias("module"), "module_category")
    modules = modules.unionByName(
        rows.where("file_id % 2 = 0").select(F.split("category", " > ")[0].alias("module_category")).distinct().select(F.col("module_category").alias("module"), "module_category")
    ).distinct()
    return graph.longest_module(rows, modules)


# --- budgets ----------------------------------------------------------------------------------------------------------


def attention_order(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.files(spark, d).select("file_id", "repo", F.round(C.importance(F.col("path"), F.col("bytes")), 6).alias("importance"))
    return graph.attention_order(rows, "repo", "importance", "file_id").select("file_id", "place")


def water_fill(spark: SparkSession, d: str) -> DataFrame:
    return budget.fill_requests(budget.requests_of(corpus.files(spark, d)), 4_000)


def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    packed = budget.pack_requests(budget.requests_of(corpus.distinct_file_rows(spark, d)), 4_000, TERMS)
    return packed.withColumn("importance", F.round("importance", 6))


def budget_summary(spark: SparkSession, d: str) -> DataFrame:
    return budget.summary(budget_pack(spark, d), 4_000)


def greedy_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.files(spark, d).select(
        "repo", "file_id", F.round(C.importance(F.col("path"), F.col("bytes")), 6).alias("importance"),
        F.ceil(F.col("bytes") / 3).cast("long").alias("tokens")
    )
    return budget.greedy(rows, "repo", 3_000)


def seen_penalty(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.files(spark, d).select("file_id", C.importance(F.col("path"), F.col("bytes")).alias("importance"))
    seen = table(spark, d, "events").where("event_type = 'click'").select((F.col("user_id") % 100).alias("file_id")).distinct().withColumn("seen", F.lit(True))
    return rows.join(seen, "file_id", "left").select("file_id", F.round(budget.seen_penalty(F.col("importance"), F.coalesce("seen", F.lit(False))), 6).alias("importance"))


def selected_meter(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the selected files of each repository against a budget."""
    rows = corpus.files(spark, d).where("ext in ('py', 'rs')").groupBy("repo").agg(F.ceil(F.sum("bytes") / 3).cast("long").alias("tokens"))
    ratio = F.col("tokens") / 5_000
    return rows.select("repo", "tokens", F.when(ratio > 0.9, "danger").when(ratio > 0.6, "warn").otherwise("ok").alias("level"))


# --- stubs ------------------------------------------------------------------------------------------------------------


def stub_fallback(spark: SparkSession, d: str) -> DataFrame:
    return corpus.distinct_file_rows(spark, d).select("file_id", stubs.head_stub(F.col("content")).alias("stub"))


def stub_yaml(spark: SparkSession, d: str) -> DataFrame:
    return corpus.distinct_file_rows(spark, d).where("ext in ('yaml', 'yml')").select("file_id", stubs.yaml_stub(F.col("content")).alias("stub"))


def stub_ini(spark: SparkSession, d: str) -> DataFrame:
    return corpus.distinct_file_rows(spark, d).where("ext = 'ini'").select("file_id", stubs.stub_column(F.col("content"), F.col("ext")).alias("stub"))


def stub_all(spark: SparkSession, d: str) -> DataFrame:
    return corpus.distinct_file_rows(spark, d).select("file_id", stubs.stub_column(F.col("content"), F.col("ext")).alias("stub"))


def stub_blocks(spark: SparkSession, d: str) -> DataFrame:
    return stubs.block_table(corpus.distinct_file_rows(spark, d))


def stub_chunks(spark: SparkSession, d: str) -> DataFrame:
    return stubs.chunk_table(corpus.distinct_file_rows(spark, d), 1_500)


# --- history ----------------------------------------------------------------------------------------------------------


def blame(spark: SparkSession, d: str) -> DataFrame:
    return history.blame(table(spark, d, "blame_lines"), "harbor-mono", 2, 30)


def file_history(spark: SparkSession, d: str) -> DataFrame:
    return history.file_history(corpus.commits(spark, d), corpus.commit_files(spark, d), HISTORY_PATH, 100)


def changed_since(spark: SparkSession, d: str) -> DataFrame:
    return history.changed_since(corpus.commits(spark, d), corpus.commit_files(spark, d), SINCE)


def changed_by_status(spark: SparkSession, d: str) -> DataFrame:
    return history.by_status(changed_since(spark, d))


def hot_files(spark: SparkSession, d: str) -> DataFrame:
    return history.hot_files(corpus.commits(spark, d), corpus.commit_files(spark, d), SINCE, 365, 50)


def churn_by_author(spark: SparkSession, d: str) -> DataFrame:
    return history.churn_by_author(table(spark, d, "blame_lines"), 20)


def epoch_dates(spark: SparkSession, d: str) -> DataFrame:
    days = (F.col("event_id") * 7 % 30_000).cast("int")
    seconds = F.col("event_id") * 86_399 + 59
    return table(spark, d, "events").select(
        "event_id", history.civil_date(days).cast("string").alias("day"), history.commit_time(seconds, (F.col("event_id") % 5 - 2) * 30).alias("time")
    )


# --- increments -------------------------------------------------------------------------------------------------------


def upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("doc_id % 4 <> 3").select("doc_id", "n_chars", "doc_kind")
    changes = table(spark, d, "documents").where("doc_id % 4 >= 2").select(
        "doc_id", (F.col("n_chars") + 1).alias("n_chars"), "doc_kind", (F.col("doc_id") % 8 == 2).alias("deleted")
    )
    return incremental.upsert(rows, changes, ["doc_id"])


def latest_entry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("repo", "file_path", "chunk_id", "file_size", "embedded_at")
    return incremental.latest(rows, ["repo", "file_path"], ["embedded_at", "chunk_id"]).select("repo", "file_path", "chunk_id", "file_size")


def cache_state(spark: SparkSession, d: str) -> DataFrame:
    cached = incremental.latest(
        table(spark, d, "chunks").select("repo", F.translate("file_path", "\\", "/").alias("path"), "file_size", "mtime", "embedded_at", "chunk_id"),
        ["repo", "path"], ["embedded_at", "chunk_id"]
    )
    current = corpus.files(spark, d).select("repo", "path", F.col("size").alias("file_size"), "mtime")
    return incremental.cache_state(cached, current, ["repo", "path"], ["file_size", "mtime"])


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return incremental.session_summary(corpus.session_reads(spark, d))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return incremental.sessions(corpus.session_reads(spark, d), "30 minutes")


def debounce(spark: SparkSession, d: str) -> DataFrame:
    return incremental.debounce(table(spark, d, "events").select((F.col("user_id") % 50).alias("key"), "ts"), "key", "10 minutes")


def json_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key"), F.get_json_object("props", "$.k").cast("long").alias("v"))
    return rows.groupBy("key").agg(F.count("*").alias("events"), F.sum("v").alias("total"))


# --- treemap ----------------------------------------------------------------------------------------------------------


def treemap_values(spark: SparkSession, d: str) -> DataFrame:
    return treemap.values(corpus.categorised(spark, d))


def treemap_layout(spark: SparkSession, d: str) -> DataFrame:
    return treemap.layout(treemap.values(corpus.categorised(spark, d)), 1200.0, 800.0, 3)


QUERIES = (
    name_rank, fuzzy_file_search, fuzzy_module_search, hybrid_find, hybrid_scores, result_facets, vector_topk, vector_threshold, vector_rerank, rank_fusion, extract_imports, import_resolution, cross_repo_edges, direct_imports, impact, impact_by_depth,
    shortest_path, dep_degree, shared_deps, reverse_deps, dep_expansion, dep_tree, longest_module, attention_order, water_fill, budget_pack, budget_summary, greedy_cap, seen_penalty, selected_meter, stub_fallback, stub_yaml, stub_ini, stub_all,
    stub_blocks, stub_chunks, blame, file_history, changed_since, changed_by_status, hot_files, churn_by_author, epoch_dates, upsert_delete, latest_entry, cache_state, session_summary, session_windows, debounce, json_keys, treemap_values, treemap_layout,
)

# --- SQL --------------------------------------------------------------------------------------------------------------

_STEM_LOW = r"regexp_replace(lower(filename), '\.[^.]*$', '')"
_NAME = f"CASE WHEN {_STEM_LOW} = '{WORD}' OR lower(filename) = '{WORD}' THEN 10000.0 WHEN starts_with({_STEM_LOW}, '{WORD}') THEN 5000.0 + 1000.0 * {len(WORD)} / length({_STEM_LOW}) END"
_CHUNKS = "chunks0 AS (SELECT 'src/engine/label_' || label || CASE WHEN vec_id % 3 = 0 THEN '.h' ELSE '.cpp' END AS file_path, vec_id AS start_line, embedding::DOUBLE[] AS e FROM embeddings)"
_NEAR = lambda v: f"(SELECT file_path, start_line, round(list_dot_product(e, (SELECT e FROM chunks0 WHERE start_line = {v})), 6) AS cosine FROM chunks0)"
_ADJUSTED = "round(cosine * CASE WHEN regexp_extract(file_path, '([^.]*)$', 1) IN ('h', 'hpp', 'hxx') THEN 1.15 ELSE 1.0 END * (1 + 0.15 * (CASE WHEN contains(lower(file_path), 'engine') THEN 1 ELSE 0 END + CASE WHEN contains(lower(file_path), 'label') THEN 1 ELSE 0 END)), 6)"
_PATTERNS = graph.IMPORTS
_EXTRACT = FILES + ",\nimports AS (SELECT DISTINCT repo, path AS src, ext, target FROM (" + " UNION ALL ".join(
    "SELECT repo, path, ext, unnest(regexp_extract_all(content, '{}', 1)) AS target FROM files WHERE ext IN ({})".format(
        p.replace("'", "''"), ", ".join(repr(e) for e in exts.split())
    ) for exts, p in _PATTERNS
) + ") WHERE target <> '')"
_RESOLVE = _EXTRACT + r""",
named AS (SELECT repo, lower(regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || regexp_extract(regexp_replace(filename, '\.[^.]*$', ''), '([^_]*)$', 1) || '.' || ext) AS dst FROM files),
paths AS (SELECT DISTINCT repo, dst, regexp_extract(dst, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(dst, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM named),
asked AS (SELECT DISTINCT repo, src, target, regexp_extract(target, '([^/]*)$', 1) AS name, regexp_extract(target, '([^/.]*)$', 1) AS stem FROM imports),
by_name AS (SELECT a.repo, src, target, arg_min(dst, (CASE WHEN ends_with(dst, target) THEN 0 ELSE 1 END, dst)) AS d1 FROM asked a JOIN paths p ON a.repo = p.repo AND a.name = p.name GROUP BY ALL),
by_stem AS (SELECT a.repo, src, target, min(dst) AS d2 FROM asked a JOIN paths p ON a.repo = p.repo AND a.stem = p.stem GROUP BY ALL),
resolved AS (SELECT repo, src, target, stem, CASE WHEN coalesce(d1, d2) <> src THEN coalesce(d1, d2) END AS dst FROM asked LEFT JOIN by_name USING (repo, src, target) LEFT JOIN by_stem USING (repo, src, target))"""
_EDGES = """edges AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders
  UNION SELECT 'lineitem:' || l_orderkey || '.' || l_linenumber, 'orders:' || l_orderkey FROM lineitem)"""
_IMPACT = _EDGES + """, walk AS (SELECT 'region:0' AS node, 0 AS depth UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.depth < 5),
impact AS (SELECT node, min(depth) AS depth FROM walk WHERE node <> 'region:0' GROUP BY node)"""
_DEPS = "deps AS (SELECT DISTINCT 's' || l_suppkey AS module, 'p' || l_partkey AS dep, CASE WHEN l_returnflag = 'N' THEN 'public' ELSE 'private' END AS kind FROM lineitem)"
_SEL = ", ".join(repr(s) for s in SELECTED)
_COMMITS = "commits AS (SELECT o_orderkey AS hash, 'a' || o_custkey AS author, o_orderdate AS ts FROM orders), cfiles AS (SELECT l_orderkey AS hash, 'part/' || l_partkey AS path, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS status FROM lineitem)"
#: A path is there at a moment if its last change until then isn't its deletion, or, without one, if its next change doesn't add it.
_CHANGED = f"""c AS (SELECT path, status, ts, hash, row_number() OVER (PARTITION BY path ORDER BY ts DESC, hash DESC, status DESC) AS newest FROM cfiles JOIN commits USING (hash)),
late AS (SELECT path, arg_min(status, (ts, hash, status)) AS first FROM c WHERE ts > TIMESTAMP '{SINCE}' GROUP BY path),
early AS (SELECT path, arg_max(status, (ts, hash, status)) AS old FROM c WHERE ts <= TIMESTAMP '{SINCE}' GROUP BY path),
ends AS (SELECT path, coalesce(old <> 'deleted', first <> 'added') AS was, status <> 'deleted' AS now FROM late JOIN c USING (path) LEFT JOIN early USING (path) WHERE newest = 1),
changed AS (SELECT path, CASE WHEN was AND now THEN 'modified' WHEN now THEN 'added' ELSE 'deleted' END AS status FROM ends WHERE was OR now)"""
_READS = "reads AS (SELECT user_id AS session_id, 'f' || (props::JSON->>'$.k') AS path, floor(value)::BIGINT AS tokens, ts FROM events)"
_ANC = "list_transform(range(1, len(string_split(category, ' > ')) + 1), lambda n: array_to_string(string_split(category, ' > ')[1:n], ' > '))"


def _sessions(source: str, keys: str, gap: str, out: str) -> str:
    return f"""m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) + INTERVAL '{gap}' THEN 0 ELSE 1 END AS fresh FROM {source}),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT {keys}, {out} FROM s GROUP BY {keys}, n"""


SQL = {
    "name_rank": f"WITH {FILES} SELECT repo, path, round({_NAME}, 6) AS score FROM files WHERE {_NAME} IS NOT NULL ORDER BY score DESC, repo, path LIMIT 60",
    "hybrid_find": f"""WITH n AS (WITH {FILES} SELECT repo, path, round({_NAME}, 6) AS score FROM files WHERE {_NAME} IS NOT NULL), g AS (WITH {_grep_sql(_ANY, TERMS.split(), 100000)}),
        j AS (SELECT coalesce(n.repo, g.repo) AS repo, coalesce(n.path, g.path) AS path, coalesce(n.score, 0.0) AS name_score, coalesce(g.score, 0.0) AS content_score FROM n FULL JOIN g ON n.repo = g.repo AND n.path = g.path),
        m AS (SELECT greatest(max(name_score), 1.0) AS mn, greatest(max(content_score), 1.0) AS mc FROM j)
        SELECT repo, path, name_score, content_score, round((name_score / mn * 0.4 + content_score / mc * 0.6) * CASE WHEN name_score > 0 AND content_score > 0 THEN 1.25 ELSE 1.0 END, 6) AS combined,
          CASE WHEN name_score > 0 AND content_score > 0 THEN 'both' WHEN name_score > 0 THEN 'name' WHEN content_score > 0 THEN 'content' ELSE 'none' END AS match FROM j, m ORDER BY combined DESC, repo, path LIMIT 60""",
    "hybrid_scores": """WITH r AS (SELECT DISTINCT result_id, query_id, total_terms, greatest(CASE WHEN name_score IS NULL OR isnan(name_score) THEN 0 ELSE name_score END, 0.0) AS n, greatest(CASE WHEN grep_score IS NULL OR isnan(grep_score) THEN 0 ELSE grep_score END, 0.0) AS c FROM find_results),
        m AS (SELECT query_id, greatest(max(n), 1.0) AS mn, greatest(max(c), 1.0) AS mc FROM r GROUP BY query_id)
        SELECT result_id, round((n / mn * CASE WHEN total_terms > 1 THEN 0.4 ELSE 0.6 END + c / mc * CASE WHEN total_terms > 1 THEN 0.6 ELSE 0.4 END) * CASE WHEN n > 0 AND c > 0 THEN 1.25 ELSE 1.0 END, 6) AS combined,
          CASE WHEN n > 0 AND c > 0 THEN 'both' WHEN n > 0 THEN 'name' WHEN c > 0 THEN 'content' ELSE 'none' END AS match FROM r JOIN m USING (query_id)""",
    "result_facets": """WITH r AS (SELECT query_id, lower(ext) AS ext, count(*) AS results FROM (SELECT DISTINCT result_id, query_id, ext FROM find_results WHERE ext IS NOT NULL AND ext <> '') GROUP BY ALL)
        SELECT query_id, ext, results FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY results DESC, ext) AS n FROM r) WHERE n <= 6""",
    "vector_topk": f"WITH {_CHUNKS} SELECT * FROM {_NEAR(7)} ORDER BY cosine DESC, file_path, start_line LIMIT 20",
    "vector_threshold": f"WITH {_CHUNKS} SELECT * FROM {_NEAR(7)} WHERE cosine >= 0.25",
    "vector_rerank": f"""WITH {_CHUNKS}, few AS (SELECT * FROM {_NEAR(7)} WHERE cosine >= 0.25 ORDER BY cosine DESC, file_path, start_line LIMIT 60), s AS (SELECT file_path, start_line, {_ADJUSTED} AS score FROM few)
        SELECT file_path, start_line, score FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, start_line) AS r FROM s) WHERE r = 1 ORDER BY score DESC, file_path LIMIT 10""",
    "rank_fusion": f"""WITH {_CHUNKS}, l AS ({" UNION ALL ".join(f"SELECT key, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, key)) AS part FROM (SELECT file_path || '#' || start_line AS key, cosine AS score FROM {_NEAR(v)} ORDER BY cosine DESC, file_path, start_line LIMIT 40)" for v in (7, 8))})
        SELECT key, round(sum(part), 9) AS fused, count(*) AS n_lists FROM l GROUP BY key ORDER BY fused DESC, key LIMIT 50""",
    "extract_imports": f"WITH {_EXTRACT} SELECT DISTINCT repo, src, target FROM imports",
    "import_resolution": f"WITH {_RESOLVE} SELECT repo, src, target, dst FROM resolved",
    "cross_repo_edges": f"""WITH {_RESOLVE}, there AS (SELECT repo, stem, min(dst) AS dst FROM paths GROUP BY repo, stem)
        SELECT DISTINCT r.repo AS from_repo, r.src AS from_file, t.repo AS to_repo, t.dst AS to_file FROM resolved r JOIN there t ON r.stem = t.stem AND r.repo <> t.repo WHERE r.dst IS NULL""",
    "direct_imports": f"WITH {_EDGES} SELECT 'imports' AS direction, dst AS node FROM edges WHERE src = 'nation:3' UNION SELECT 'imported_by', src FROM edges WHERE dst = 'nation:3'",
    "impact": f"WITH RECURSIVE {_IMPACT} SELECT node, depth FROM impact",
    "impact_by_depth": f"WITH RECURSIVE {_IMPACT} SELECT depth, count(*) AS files FROM impact GROUP BY depth",
    "shortest_path": f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'orders:1' AS node, 'orders:1' AS path, 0 AS hops UNION ALL SELECT e.dst, w.path || ' -> ' || e.dst, hops + 1 FROM w JOIN edges e ON e.src = w.node WHERE hops < 12)
        SELECT node AS goal, path, hops::INT AS hops FROM w WHERE starts_with(node, 'region:')""",
    "dep_degree": f"""WITH {_DEPS}, e AS (SELECT module AS node, 1 AS o, 0 AS i FROM deps UNION ALL SELECT dep, 0, 1 FROM deps), c AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM e GROUP BY node)
        SELECT *, round(greatest(1.5, CASE WHEN out_degree + in_degree <= 25 THEN 0.8 * sqrt(out_degree + in_degree) ELSE 4 + 1.5 * log2((out_degree + in_degree) / 25) END), 6) AS radius FROM c""",
    "shared_deps": f"WITH {_DEPS} SELECT dep, count(DISTINCT module) AS modules FROM deps WHERE module IN ({_SEL}) AND dep NOT IN ({_SEL}) GROUP BY dep HAVING count(DISTINCT module) >= 2 ORDER BY modules DESC, dep LIMIT 15",
    "reverse_deps": f"WITH {_DEPS} SELECT DISTINCT dep, module FROM deps",
    "greedy_cap": f"""WITH RECURSIVE {FILES}, o AS (SELECT repo, file_id, ceil({_BYTES.format('content')} / 3)::BIGINT AS tokens, row_number() OVER (PARTITION BY repo ORDER BY round({_IMPORTANCE}, 6) DESC, file_id) AS k FROM files),
        w AS (SELECT repo, file_id, tokens, k, tokens AS used, true AS taken FROM o WHERE k = 1
          UNION ALL SELECT o.repo, o.file_id, o.tokens, o.k, CASE WHEN used + o.tokens <= 3000 THEN used + o.tokens ELSE used END, used + o.tokens <= 3000 FROM w JOIN o ON o.repo = w.repo AND o.k = w.k + 1)
        SELECT repo, file_id, tokens FROM w WHERE taken""",
    "dep_expansion": f"WITH {_DEPS} SELECT DISTINCT m AS module FROM (SELECT dep AS m FROM deps WHERE module IN ({_SEL}) UNION SELECT module FROM deps WHERE dep IN ({_SEL})) WHERE m NOT IN ({_SEL})",
    "dep_tree": f"""WITH {_DEPS}, g AS (SELECT * FROM deps WHERE module IN ('s1', 's2', 's3') UNION ALL SELECT DISTINCT dep, 's' || substr(dep, 2), kind FROM deps WHERE kind = 'private'),
        d1 AS (SELECT dep AS node, 1 AS depth, max(kind) AS kind FROM g WHERE module = 's1' AND dep <> 's1' GROUP BY dep), d2 AS (SELECT g.dep AS node, 2 AS depth, max(g.kind) AS kind FROM g JOIN d1 ON g.module = d1.node WHERE g.dep <> 's1' AND g.dep NOT IN (SELECT node FROM d1) GROUP BY g.dep)
        SELECT 's1' AS node, 0 AS depth, 'root' AS kind UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2""",
    "longest_module": f"""WITH {CATEGORISED}, mods AS (SELECT DISTINCT category AS m FROM categorised WHERE file_id % 3 = 0 UNION SELECT DISTINCT string_split(category, ' > ')[1] FROM categorised WHERE file_id % 2 = 0)
        SELECT file_id, arg_max(m, length(m)) AS module FROM categorised JOIN mods ON category = m OR starts_with(category, m || ' > ') GROUP BY file_id""",
    "attention_order": f"""WITH {FILES}, r AS (SELECT file_id, row_number() OVER (PARTITION BY repo ORDER BY round({_IMPORTANCE}, 6) DESC, file_id) - 1 AS r, count(*) OVER (PARTITION BY repo) AS n FROM files)
        SELECT file_id, (CASE WHEN n < 3 OR r < n // 3 THEN r WHEN r < 2 * (n // 3) THEN r + n - 2 * (n // 3) ELSE r - n // 3 END)::INT AS place FROM r""",
    "seen_penalty": f"WITH {FILES}, seen AS (SELECT DISTINCT user_id % 100 AS file_id FROM events WHERE event_type = 'click') SELECT file_id, round({_IMPORTANCE} * CASE WHEN file_id IN (SELECT file_id FROM seen) THEN 0.3 ELSE 1.0 END, 6) AS importance FROM files",
    "selected_meter": f"WITH {FILES}, t AS (SELECT repo, ceil(sum({_BYTES.format('content')}) / 3)::BIGINT AS tokens FROM files WHERE ext IN ('py', 'rs') GROUP BY repo) SELECT repo, tokens, CASE WHEN tokens / 5000 > 0.9 THEN 'danger' WHEN tokens / 5000 > 0.6 THEN 'warn' ELSE 'ok' END AS level FROM t",
    "stub_fallback": f"WITH {LINES}, b AS (SELECT file_id, string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE idx < 100) AS body, max(n_lines) AS n FROM lines GROUP BY file_id) SELECT f.file_id, coalesce(body, '') || CASE WHEN n > 100 THEN chr(10) || '// ... (truncated at 100 lines)' || chr(10) ELSE chr(10) END AS stub FROM files f LEFT JOIN b USING (file_id)",
    "stub_yaml": rf"WITH {LINES} SELECT f.file_id, coalesce(string_agg(line || chr(10), '' ORDER BY idx) FILTER (WHERE NOT regexp_matches(line, '^( [^ ]| $|    |\t\t)')), '') AS stub FROM files f LEFT JOIN lines USING (file_id) WHERE f.ext IN ('yaml', 'yml') GROUP BY f.file_id",
    "stub_ini": rf"""WITH {LINES}, k AS (SELECT *, trim(line) AS t FROM lines WHERE ext = 'ini'), s AS (SELECT *, sum(CASE WHEN starts_with(t, '[') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY idx) AS section, t <> '' AND NOT regexp_matches(t, '^[;#\[]') AS entry FROM k),
        e AS (SELECT *, sum(CASE WHEN entry THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, section ORDER BY idx) AS n FROM s)
        SELECT file_id, string_agg(CASE WHEN entry AND n = 6 THEN '; ... (more entries)' ELSE line END || chr(10), '' ORDER BY idx) AS stub FROM e WHERE NOT entry OR n <= 6 GROUP BY file_id""",
    "blame": "SELECT DISTINCT blame_id, replace(rel_path, '\\', '/') AS path, line_no, author, strftime(committed_at, '%Y-%m-%d %H:%M') AS time, substr(commit_hash, 1, 8) AS hash, content FROM blame_lines WHERE repo = 'harbor-mono' AND line_no BETWEEN 2 AND 30",
    "file_history": f"WITH {_COMMITS}, t AS (SELECT DISTINCT hash FROM cfiles WHERE path = '{HISTORY_PATH}'), n AS (SELECT hash, count(DISTINCT path) AS files_changed FROM cfiles WHERE hash IN (SELECT hash FROM t) GROUP BY hash), p AS (SELECT hash, list_sort(list(DISTINCT path))[1:50] AS paths FROM cfiles WHERE hash IN (SELECT hash FROM t) GROUP BY hash) SELECT hash, author, ts, files_changed, p.paths FROM commits JOIN n USING (hash) JOIN p USING (hash) ORDER BY ts DESC, hash LIMIT 100",
    "changed_since": f"WITH {_COMMITS}, {_CHANGED} SELECT path, status FROM changed",
    "changed_by_status": f"WITH {_COMMITS}, {_CHANGED} SELECT status, count(*) AS files, min(path) AS first_path FROM changed GROUP BY status",
    "hot_files": f"WITH {_COMMITS} SELECT path, count(DISTINCT hash) AS commits FROM cfiles JOIN commits USING (hash) WHERE ts >= TIMESTAMP '{SINCE}' - INTERVAL 365 DAY AND ts <= TIMESTAMP '{SINCE}' GROUP BY path ORDER BY commits DESC, path LIMIT 50",
    "churn_by_author": "SELECT author, count(*) AS lines, count(DISTINCT commit_hash) AS commits FROM (SELECT DISTINCT blame_id, author, commit_hash FROM blame_lines) GROUP BY author ORDER BY lines DESC, author NULLS FIRST LIMIT 20",
    "epoch_dates": "SELECT event_id, (DATE '1970-01-01' + (event_id * 7 % 30000)::INT)::VARCHAR AS day, strftime(make_timestamp((event_id * 86399 + 59 + (event_id % 5 - 2) * 30 * 60) * 1000000), '%Y-%m-%d %H:%M') AS time FROM events",
    "upsert_delete": "SELECT doc_id, n_chars, doc_kind FROM documents WHERE doc_id % 4 < 2 UNION ALL SELECT doc_id, n_chars + 1, doc_kind FROM documents WHERE doc_id % 4 >= 2 AND doc_id % 8 <> 2",
    "latest_entry": "SELECT repo, file_path, arg_max(chunk_id, (embedded_at, chunk_id)) AS chunk_id, (arg_max({'s': file_size}, (embedded_at, chunk_id))).s AS file_size FROM chunks GROUP BY repo, file_path",
    "cache_state": f"""WITH {FILES}, c AS (SELECT repo, replace(file_path, '\\', '/') AS path, arg_max({{'s': file_size, 'm': mtime}}, (embedded_at, chunk_id)) AS x FROM chunks GROUP BY ALL)
        SELECT f.repo, f.path, CASE WHEN c.path IS NULL THEN 'missing' WHEN x.s IS NOT DISTINCT FROM f.size AND x.m IS NOT DISTINCT FROM f.mtime THEN 'hit' ELSE 'stale' END AS state FROM files f LEFT JOIN c ON f.repo = c.repo AND f.path = c.path""",
    "session_summary": f"WITH {_READS} SELECT session_id, count(DISTINCT path) AS files_read, sum(tokens)::BIGINT AS tokens_served, min(ts) AS started_at, max(ts) AS last_read FROM reads GROUP BY session_id",
    "session_windows": f"WITH {_READS}, " + _sessions("reads", "session_id", "30 minutes", "min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS reads, sum(tokens)::BIGINT AS tokens"),
    "debounce": "WITH ev AS (SELECT user_id % 50 AS key, ts FROM events), " + _sessions("ev", "key", "10 minutes", "min(ts) AS start, max(ts) AS last, count(*) AS events"),
    "json_keys": "SELECT 'k' AS key, count(*) AS events, sum((props::JSON->>'$.k')::BIGINT)::BIGINT AS total FROM events WHERE props IS NOT NULL",
    "treemap_values": f"WITH {CATEGORISED}, n AS (SELECT node, count(*) AS files FROM (SELECT unnest({_ANC}) AS node FROM categorised) GROUP BY node) SELECT node, array_to_string(string_split(node, ' > ')[1:len(string_split(node, ' > ')) - 1], ' > ') AS parent, len(string_split(node, ' > '))::INT AS depth, files, round(cbrt(files), 6) AS value FROM n",
}
SQL["seen_penalty"] = typed(SQL["seen_penalty"], "importance", "DOUBLE")
