"""Queries of those who explore a corpus: modules and their neighbours, subtrees, snippets, tokens, namespaces, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.functions import encoder, tokenizers
from codeseam.operators import fuzzy, graph, history, incremental, stats, syntax, treemap, views
from codeseam.operators import grep as G
from codeseam.plans.graph_queries import _DEPS, _EXTRACT, _READS, SELECTED
from codeseam.plans.text_queries import _ANY, CATEGORISED, FILES, LINES, TERMS, typed
from codeseam.plans.view_queries import _ANC
from codeseam.session import shared_folder, table
from codeseam.sources import corpus, manifests
from codeseam.streaming import watch

NOW = "2024-01-15 00:00:00"


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """Each category as a module named after its last part."""
    rows = corpus.categorised(spark, d).select("category").distinct()
    return rows.select(F.element_at(F.split("category", " > "), -1).alias("module"), F.col("category").alias("module_category"))


def subtree_extensions(spark: SparkSession, d: str) -> DataFrame:
    return stats.subtree_extensions(corpus.categorised(spark, d))


def file_order(spark: SparkSession, d: str) -> DataFrame:
    return stats.ordered(corpus.categorised(spark, d))


def display_paths(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select("file_id", C.display_path(F.col("repo"), F.col("path"), F.lit(True)).alias("shown"))


def dep_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every module; suppliers belong to the group of their nation's number."""
    places = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("module"), F.concat(F.lit("n"), "s_nationkey", F.lit(" > x")).alias("module_category"))
    rows = graph.adjacency(corpus.module_deps(spark, d), places)
    return rows.groupBy("node", "group").agg(F.count_if(F.col("kind") == "public").alias("public"), F.count_if(F.col("kind") == "private").alias("private"))


def dep_tree_reverse(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(corpus.module_deps(spark, d), "p5", 1, reverse=True)


def module_lookup(spark: SparkSession, d: str) -> DataFrame:
    return graph.lookup(corpus.categorised(spark, d), _modules(spark, d).where("length(module) % 2 = 0"))


def selection_closure(spark: SparkSession, d: str) -> DataFrame:
    """Files of the module core and of its neighbours: each module depends on that of its first part."""
    modules = _modules(spark, d)
    deps = modules.select("module", F.split("module_category", " > ")[0].alias("dep"), F.lit("public").alias("kind")).where("module <> dep").distinct()
    return graph.closure(deps, modules, corpus.categorised(spark, d), "core")


def dep_search_set(spark: SparkSession, d: str) -> DataFrame:
    return views.search_set(_modules(spark, d), "Cor")


def treemap_damped(spark: SparkSession, d: str) -> DataFrame:
    return treemap.damped(corpus.categorised(spark, d))


def namespace_edges(spark: SparkSession, d: str) -> DataFrame:
    """`using` lines against namespaces named by the first import of each file."""
    rows = corpus.distinct_file_rows(spark, d).where("ext = 'cs'").select(
        "repo", "path", "ext",
        F.concat("content", F.lit("\nnamespace Acme."), F.initcap(F.regexp_extract("path", "([a-z]+)[^/]*$", 1)), F.lit("\n")).alias("content")
    )
    return graph.namespace_edges(graph.extract_imports(rows), rows)


def import_sources(spark: SparkSession, d: str) -> DataFrame:
    return stats.import_sources(graph.extract_imports(corpus.file_rows(spark, d)))


def import_graph(spark: SparkSession, d: str) -> DataFrame:
    """All edges between files: at home, by namespace, in other repositories."""
    return graph.all_edges(corpus.distinct_file_rows(spark, d))


def dep_connections(spark: SparkSession, d: str) -> DataFrame:
    deps = corpus.module_deps(spark, d)
    return graph.connections(deps.unionByName(deps.select(F.col("dep").alias("module"), F.col("module").alias("dep"), "kind")), list(SELECTED))


def grep_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Of each matching file the line that holds most of the terms."""
    return G.grep(corpus.file_rows(spark, d), TERMS, "any", None, snippets=True).select("repo", "path", "match_count", "best_line")


def name_highlights(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.highlights(corpus.files(spark, d), "cache", 40)


def syntax_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Coloured tokens of all files by kind."""
    return syntax.token_table(corpus.distinct_file_rows(spark, d)).groupBy("kind").agg(F.count("*").alias("tokens"), F.countDistinct("file_id").alias("files"))


def module_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 modules under a prefix, with how many there are in all."""
    rows = stats.modules(corpus.categorised(spark, d)).where(F.col("id").startswith("ta")).select("id", "file_count")
    return rows.orderBy("id").limit(20).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def active_sessions(spark: SparkSession, d: str) -> DataFrame:
    return incremental.active(corpus.session_reads(spark, d), NOW, "30 days")


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = [tokenizers.count_tokens(F.col("text"), n).alias(n.replace("-", "_")) for n in ("bytes-3", "bytes-4")]
    return table(spark, d, "documents").select("doc_id", *counts)


def file_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all embeddable files; their length is checked here."""
    rows = corpus.distinct_file_rows(spark, d).where(C.embeddable(F.col("path"), F.col("bytes")))
    v = rows.select("file_id", encoder.encode(F.col("content"), "hash-96").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return v.select("file_id", F.size("v").alias("dim"), (F.abs(norm - 1) < 1e-4).alias("unit"))


def manifest_deps(spark: SparkSession, d: str) -> DataFrame:
    """The dependencies of modules, written as manifests of five formats and read again."""
    deps = corpus.module_deps(spark, d).groupBy("module", "dep").agg(F.max("kind").alias("kind"))  # a manifest names each once
    sides = deps.groupBy("module").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("dep")))).alias(k) for k in ("public", "private")))
    join = lambda side, form, sep: F.array_join(F.transform(side, lambda x: F.format_string(form, x)), sep)
    keys = lambda side: F.to_json(F.map_from_arrays(side, F.transform(side, lambda x: F.lit("1"))))
    texts = (
        F.format_string('{"name": "%s", "dependencies": %s, "devDependencies": %s}', "module", keys("public"), keys("private")),
        F.format_string(
            '[package]\nname = "%s"\n\n[dependencies]\n%s\n\n[dev-dependencies]\n%s\n', "module", join("public", '%s = "1"', "\n"),
            join("private", '%s = { version = "1" }', "\n")
        ),
        F.format_string("project(%s)\ntarget_link_libraries(%s PUBLIC %s PRIVATE %s)\n", "module", "module", join("public", "x::%s", " "), join("private", "%s", "\n  ")),
        F.format_string('PublicDependencyModuleNames.AddRange(new string[] { %s });\nPrivateDependencyModuleNames.AddRange(new string[] { %s });\n', join("public", '"%s"', ", "), join("private", '"%s"', ", ")),
        F.format_string("module x.test/%s\n\nrequire (\n%s\n)\n", "module", join(F.concat("public", "private"), "\tx.test/a/%s v1.0.0", "\n")),
    )
    names = ("package.json", "Cargo.toml", "CMakeLists.txt", None, "go.mod")
    kind = F.substring("module", 2, 9).cast("int") % 5
    pick = lambda options: F.coalesce(*(F.when(kind == k, o) for k, o in enumerate(options)))
    name = pick([F.lit(n) if n else F.concat("module", F.lit(".Build.cs")) for n in names])
    files = sides.select(F.lit("r").alias("repo"), F.concat_ws("/", "module", name).alias("path"), pick(texts).alias("content"), F.lit("x").alias("category"))
    return manifests.edges(manifests.modules(files)).select("module", "dep", "kind")


def change_table(spark: SparkSession, d: str) -> DataFrame:
    """A file table after the events in two batches, the later ones first."""
    rows = table(spark, d, "events").select(
        F.concat(F.lit("r"), F.col("user_id") % 7).alias("repo"), F.concat(
            F.lit("f"), F.col("user_id") % 400
        ).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("size"),
        F.concat(F.lit("text "), "event_id").alias("content"), (F.col("event_type") == "click").alias("deleted"), "event_id",
    )
    folder = shared_folder(spark, "files")
    for version, parity in enumerate((1, 0)):
        watch.apply_changes(spark, rows.where(F.col("event_id") % 2 == parity).drop("event_id"), folder, version, buckets=8, keep_deleted_days=100_000)
    return watch.current(spark, folder)[0].select("repo", "path", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "size")


def blame_drift(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.distinct_file_rows(spark, d).select("repo", "path", F.posexplode(C.lines(F.col("content"))).alias("at", "line"))
    return history.blame_drift(table(spark, d, "blame_lines"), lines.select("repo", "path", (F.col("at") + 1).alias("line_no"), "line"))


QUERIES = (
    blame_drift, manifest_deps, change_table, subtree_extensions, file_order, display_paths, dep_adjacency, dep_tree_reverse, module_lookup, selection_closure, dep_search_set, treemap_damped, namespace_edges, import_sources, import_graph, dep_connections, grep_snippets,
    name_highlights, syntax_kinds, module_page, active_sessions, token_counts, file_vectors,
)

_MODS = "mods AS (SELECT DISTINCT string_split(category, ' > ')[-1] AS module, category AS module_category FROM categorised)"
_TERM_COUNT = " + ".join(f"CASE WHEN contains(lower(line), '{t}') THEN 1 ELSE 0 END" for t in TERMS.split())
_EMBEDDABLE = ", ".join(repr(x) for x in C.EMBEDDABLE)
SQL = {
    "blame_drift": rf"""WITH {LINES}, b AS (SELECT DISTINCT blame_id, repo, replace(rel_path, '\', '/') AS path, line_no, regexp_replace(content, '\r$', '') AS content FROM blame_lines WHERE repo IS NOT NULL AND rel_path IS NOT NULL AND line_no IS NOT NULL)
        SELECT b.repo, b.path, count(*) AS lines, count(*) FILTER (WHERE content = line) AS same, count(*) FILTER (WHERE line IS NOT NULL AND content IS DISTINCT FROM line) AS differ, count(*) FILTER (WHERE line IS NULL) AS gone
        FROM b LEFT JOIN lines l ON b.repo = l.repo AND b.path = l.path AND b.line_no = l.idx + 1 GROUP BY b.repo, b.path""",
    "manifest_deps": f"WITH {_DEPS}, o AS (SELECT module, dep, max(kind) AS kind FROM deps GROUP BY ALL) SELECT module, dep, CASE WHEN substr(module, 2)::INT % 5 = 4 THEN 'public' ELSE kind END AS kind FROM o",
    "change_table": """WITH e AS (SELECT 'r' || (user_id % 7) AS repo, 'f' || (user_id % 400) AS path, ts, floor(value)::BIGINT AS size, event_type = 'click' AS deleted FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY ts DESC, deleted DESC, size DESC) AS k FROM e) SELECT repo, path, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, size FROM n WHERE k = 1 AND NOT deleted""",
    "subtree_extensions": f"""WITH {CATEGORISED}, r AS (SELECT ext, unnest({_ANC}) AS node FROM categorised WHERE ext <> ''), c AS (SELECT node, ext, count(*) AS files FROM r GROUP BY node, ext)
        SELECT node, ext, files FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY files DESC, ext) AS n FROM c) WHERE n <= 5""",
    "file_order": f"WITH {CATEGORISED} SELECT file_id, repo, row_number() OVER (PARTITION BY repo ORDER BY category, path, file_id) - 1 AS place FROM categorised",
    "display_paths": f"WITH {FILES} SELECT file_id, '[' || repo || '] ' || path AS shown FROM files",
    "dep_adjacency": f"""WITH {_DEPS}, one AS (SELECT module, dep, max(kind) AS kind FROM deps GROUP BY ALL), b AS (SELECT module AS node, dep AS neighbour, kind FROM one UNION ALL SELECT dep, module, kind FROM one),
        g AS (SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS "group" FROM supplier)
        SELECT node, coalesce("group", '') AS "group", count(*) FILTER (WHERE kind = 'public') AS public, count(*) FILTER (WHERE kind = 'private') AS private FROM b LEFT JOIN g USING (node) GROUP BY ALL""",
    "dep_tree_reverse": typed(f"WITH {_DEPS} SELECT 'p5' AS node, 0 AS depth, 'root' AS kind UNION ALL SELECT module, 1, max(kind) FROM deps WHERE dep = 'p5' GROUP BY module", "depth", "INT"),
    "module_lookup": f"""WITH {CATEGORISED}, {_MODS}, m AS (SELECT * FROM mods WHERE length(module) % 2 = 0), c AS (SELECT DISTINCT category FROM categorised)
        SELECT category, coalesce((SELECT min(module) FROM m WHERE lower(module) = lower(string_split(category, ' > ')[-1])), (SELECT min(module) FROM m WHERE module_category = category)) AS module FROM c""",
    "selection_closure": f"""WITH {CATEGORISED}, {_MODS}, d AS (SELECT DISTINCT module, string_split(module_category, ' > ')[1] AS dep FROM mods WHERE module <> string_split(module_category, ' > ')[1]),
        w AS (SELECT 'core' AS module UNION SELECT dep FROM d WHERE module = 'core' UNION SELECT module FROM d WHERE dep = 'core'), c AS (SELECT DISTINCT module_category AS mc FROM mods WHERE module IN (SELECT module FROM w))
        SELECT DISTINCT repo, path FROM categorised JOIN c ON category = mc OR starts_with(category, mc || ' > ')""",
    "dep_search_set": f"WITH {CATEGORISED}, {_MODS} SELECT DISTINCT module FROM mods WHERE contains(lower(module), 'cor') OR contains(lower(module_category), 'cor')",
    "treemap_damped": f"""WITH {CATEGORISED}, own AS (SELECT category, count(*) AS n FROM categorised GROUP BY category), nodes AS (SELECT DISTINCT unnest({_ANC}) AS node FROM own),
        p AS (SELECT node, array_to_string(string_split(node, ' > ')[1:len(string_split(node, ' > ')) - 1], ' > ') AS parent FROM nodes), s AS (SELECT parent, count(*) AS siblings FROM p GROUP BY parent),
        v AS (SELECT category, n, CASE WHEN siblings >= 2 THEN cbrt(n) ELSE n::DOUBLE END AS v FROM own JOIN p ON category = node JOIN s USING (parent)), u AS (SELECT n, v, unnest({_ANC}) AS node FROM v)
        SELECT node, parent, len(string_split(node, ' > '))::INT AS depth, sum(n)::BIGINT AS files, round(sum(v), 6) AS value FROM u JOIN p USING (node) GROUP BY node, parent""",
    "namespace_edges": rf"""WITH {FILES}, cs AS (SELECT DISTINCT repo, path, content || chr(10) || 'namespace Acme.' || upper(regexp_extract(path, '([a-z]+)[^/]*$', 1)[1]) || lower(regexp_extract(path, '([a-z]+)[^/]*$', 1)[2:]) || chr(10) AS content FROM files WHERE ext = 'cs'),
        sp AS (SELECT repo, path AS dst, regexp_extract(content, '(?m)^namespace\s+([\w.]+)', 1) AS space FROM cs),
        us AS (SELECT DISTINCT repo, path AS src, unnest(regexp_extract_all(content, '(?m)^using\s+(?:static\s+)?([\w.]+)\s*;', 1)) AS target FROM cs),
        k AS (SELECT * FROM us WHERE string_split(target, '.')[1] NOT IN ('System', 'Microsoft')),
        e AS (SELECT k.repo, src, target, dst FROM k JOIN sp ON k.repo = sp.repo AND target = space),
        b AS (SELECT k.repo, src, dst FROM k JOIN sp ON k.repo = sp.repo AND starts_with(space, target || '.') WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo = k.repo AND e.src = k.src AND e.target = k.target))
        SELECT DISTINCT repo, src, dst FROM (SELECT repo, src, dst FROM e UNION ALL SELECT * FROM b) WHERE src <> dst""",
    "import_sources": f"WITH {_EXTRACT} SELECT repo, count(DISTINCT (repo, src)) AS sources, count(DISTINCT target) AS targets FROM imports GROUP BY ROLLUP (repo)",
    "grep_snippets": typed(f"""WITH {LINES}, m AS (SELECT *, {_TERM_COUNT} AS k FROM lines WHERE {_ANY})
        SELECT repo, path, count(*) AS match_count, arg_max(idx, (k, -idx)) + 1 AS best_line FROM m GROUP BY file_id, repo, path""", "match_count best_line", "INT"),
    "module_page": f"WITH {CATEGORISED}, m AS (SELECT category AS id, count(*) AS file_count FROM categorised WHERE starts_with(category, 'ta') GROUP BY category) SELECT id, file_count, (SELECT count(*) FROM m) AS total FROM m ORDER BY id LIMIT 20",
    "active_sessions": f"""WITH {_READS}, s AS (SELECT session_id, count(DISTINCT path) AS files_read, sum(tokens)::BIGINT AS tokens_served, min(ts) AS started_at, max(ts) AS last_read FROM reads WHERE ts <= TIMESTAMP '{NOW}' GROUP BY session_id)
        SELECT * FROM s WHERE last_read >= TIMESTAMP '{NOW}' - INTERVAL '30 days'""",
    "token_counts": "SELECT doc_id, coalesce(ceil(strlen(text) / 3), 0)::BIGINT AS bytes_3, coalesce(floor(strlen(text) / 4), 0)::BIGINT AS bytes_4 FROM documents",
    "file_vectors": f"""WITH {FILES} SELECT file_id, 96 AS dim, true AS unit FROM files WHERE regexp_extract(regexp_extract(path, '([^/]*)$', 1), '\\.([^.]*)$', 1) IN ({_EMBEDDABLE})
        AND NOT regexp_matches('/' || lower(path), '/({'|'.join(C.EMBED_SKIP_DIRS)})/') AND strlen(content) <= 524288""",
}
