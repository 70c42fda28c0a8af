"""Queries of viewers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.functions.encoder import encode
from codeseam.operators import incremental, views
from codeseam.plans.graph_queries import _DEPS
from codeseam.plans.text_queries import CATEGORISED, FILES, typed
from codeseam.session import small_side, table
from codeseam.sources import corpus

PALETTE = {"py": (53, 114, 165), "rs": (222, 165, 132), "js": (241, 224, 90), "go": (0, 173, 216)}


def cluster_bounds(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return views.cluster_bounds(points, "p_brand")


def dep_highlight(spark: SparkSession, d: str) -> DataFrame:
    return views.highlight(corpus.module_deps(spark, d), "p5")


def category_colors(spark: SparkSession, d: str) -> DataFrame:
    return views.blended(corpus.categorised(spark, d), PALETTE)


def selected_modules(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.categorised(spark, d).withColumn("selected", F.col("file_id") % 5 == 0)
    modules = rows.where("file_id % 2 = 0").select(F.col("category").alias("module"), F.col("category").alias("module_category")).distinct()
    return views.selected_modules(rows, modules)


def related_headers(spark: SparkSession, d: str) -> DataFrame:
    """Files as of the modules p0 to p96; hits are the results of one query."""
    rows = corpus.files(spark, d).select("file_id", "ext", F.concat(F.lit("p"), F.col("file_id") % 97).alias("module"))
    scores = rows.where("file_id % 11 = 0").select("file_id", (F.col("file_id") % 13 + 1.0).alias("score"))
    deps = corpus.module_deps(spark, d).select(F.concat(F.lit("p"), F.substring("module", 2, 9).cast("int") % 97).alias("module"), "dep", "kind").distinct()
    return views.related_headers(rows, scores, deps)


def chunk_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("snippet is not null").select("chunk_id", views.preview(F.col("snippet")).alias("preview")).distinct()


def cache_identity(spark: SparkSession, d: str) -> DataFrame:
    remote = F.when(F.length("repo") % 2 == 0, F.concat(F.lit("git@git.test:Team/"), "repo", F.lit(".git"))).otherwise(F.concat(F.lit("https://me:pw@git.test/Team/"), "repo"))
    return table(spark, d, "scan_configs").select("repo", views.cache_identity(remote).alias("identity"))


def flat_tree(spark: SparkSession, d: str) -> DataFrame:
    return views.flat_tree(corpus.categorised(spark, d))


def index_increment(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of those files only that the cache lacks or holds in an older state."""
    rows = corpus.distinct_file_rows(spark, d)
    cached = rows.where("file_id % 3 = 0").select("repo", "path", (F.col("size") + F.when(F.col("file_id") % 2 == 0, 1).otherwise(0)).alias("size"), "mtime")
    state = incremental.cache_state(cached, rows.select("repo", "path", "size", "mtime"), ["repo", "path"], ["size", "mtime"])
    todo = rows.join(small_side(state.where("state <> 'hit'").select("repo", "path")), ["repo", "path"], "left_semi").where(C.embeddable(F.col("path"), F.col("bytes")))
    return todo.select("repo", "path", encode(F.concat_ws("\n", C.path_header(F.col("path")), "content"), "hash-96").alias("embedding"))


def mask_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Files whose names hold all letters of a pattern, whatever their order."""
    mask = sum(1 << (ord(c) - 97) for c in set("rtgph"))
    return corpus.files(spark, d).where(C.bitmask(F.col("filename")).bitwiseAND(F.lit(mask)) == mask).select("file_id", "filename")


def config_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of configuration files near to a known one, by edit distance up to 3."""
    keys = corpus.file_rows(spark, d).where("ext in ('toml', 'ini', 'yaml')").select(
        F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^([a-z_]+)\s*[=:]"), F.lit(1))).alias("key")
    ).distinct()
    distance = F.levenshtein("key", F.lit("cache_graph"))
    return keys.select("key", distance.alias("distance")).where("distance <= 3")


QUERIES = (
    cluster_bounds, dep_highlight, category_colors, selected_modules, related_headers, chunk_preview, cache_identity, flat_tree, index_increment,
    mask_prefilter, config_keys
)

_ANC = "list_transform(range(1, len(string_split(category, ' > ')) + 1), lambda n: array_to_string(string_split(category, ' > ')[1:n], ' > '))"
_COLOR = lambda k: "CASE ext " + " ".join(f"WHEN '{e}' THEN {v[k]}" for e, v in PALETTE.items()) + " END"
SQL = {
    "cluster_bounds": """WITH p AS (SELECT p_brand, p_size::DOUBLE AS x, p_retailprice AS y FROM part), c AS (SELECT p_brand, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY p_brand)
        SELECT p_brand, round(cx, 6) AS x, round(cy, 6) AS y, round(max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) + 20, 6) AS radius FROM p JOIN c USING (p_brand) GROUP BY p_brand, cx, cy""",
    "dep_highlight": f"WITH {_DEPS} SELECT DISTINCT node, 'neighbour' AS role FROM (SELECT dep AS node FROM deps WHERE module = 'p5' UNION SELECT module FROM deps WHERE dep = 'p5') WHERE node <> 'p5' UNION ALL SELECT 'p5', 'focus'",
    "category_colors": typed(
        f"WITH {CATEGORISED}, r AS (SELECT unnest({_ANC}) AS node, ext FROM categorised) SELECT node, round(128 * 0.65 + avg({_COLOR(0)}) * 0.35, 4) AS red, round(128 * 0.65 + avg({_COLOR(1)}) * 0.35, 4) AS green, round(128 * 0.65 + avg({_COLOR(2)}) * 0.35, 4) AS blue FROM r WHERE ext IN ('py', 'rs', 'js', 'go') GROUP BY node",
        "red green blue", "DOUBLE",
    ),
    "selected_modules": f"WITH {CATEGORISED}, up AS (SELECT DISTINCT unnest({_ANC}) AS m FROM categorised WHERE file_id % 5 = 0) SELECT DISTINCT category AS module FROM categorised WHERE file_id % 2 = 0 AND category IN (SELECT m FROM up)",
    "related_headers": f"""WITH {FILES}, {_DEPS}, d AS (SELECT DISTINCT 'p' || (substr(module, 2)::INT % 97) AS module, dep FROM deps), f AS (SELECT file_id, ext, 'p' || (file_id % 97) AS module FROM files), s AS (SELECT file_id, module, (file_id % 13 + 1)::DOUBLE AS score FROM f WHERE file_id % 11 = 0),
        n AS (SELECT DISTINCT m FROM (SELECT dep AS m FROM d WHERE module IN (SELECT module FROM s) UNION SELECT module FROM d WHERE dep IN (SELECT module FROM s)) WHERE m NOT IN (SELECT module FROM s))
        SELECT file_id, round((SELECT max(score) FROM s) * 0.3::DOUBLE, 6) AS score FROM f WHERE ext = 'h' AND module IN (SELECT m FROM n) AND file_id NOT IN (SELECT file_id FROM s)""",
    "chunk_preview": r"SELECT DISTINCT chunk_id, list_filter(string_split_regex(regexp_replace(snippet, '\r?\n$', ''), '\r?\n'), lambda x: trim(x) <> '' AND NOT starts_with(x, '// File:'))[1] AS preview FROM chunks WHERE snippet IS NOT NULL",
    "cache_identity": "SELECT repo, 'git.test_team_' || lower(repo) AS identity FROM scan_configs",
    "flat_tree": f"WITH {CATEGORISED}, n AS (SELECT repo, node, count(*) AS files FROM (SELECT repo, unnest({_ANC}) AS node FROM categorised) GROUP BY repo, node) SELECT repo, node, len(string_split(node, ' > '))::INT AS depth, files, (row_number() OVER (PARTITION BY repo ORDER BY array_to_string(string_split(node, ' > '), chr(1))) - 1)::INT AS place FROM n",
    "mask_prefilter": f"WITH {FILES} SELECT file_id, filename FROM files WHERE " + " AND ".join(f"contains(lower(filename), '{c}')" for c in "rtgph"),
    "config_keys": rf"WITH {FILES}, k AS (SELECT DISTINCT unnest(regexp_extract_all(content, '(?m)^([a-z_]+)\s*[=:]', 1)) AS key FROM files WHERE ext IN ('toml', 'ini', 'yaml')) SELECT key, levenshtein(key, 'cache_graph')::INT AS distance FROM k WHERE levenshtein(key, 'cache_graph') <= 3",
}
