"""The queries of the eight problems, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.llm import fusion, mixing, neighbors, packing, provenance, reading, secrets, splitting, tokens
from codeseam.session import distinct_rows, durable, small_side, table

SCORES = ("name_score", "grep_score", "grep_count", "terms_matched")


def p1_order(spark: SparkSession, d: str) -> DataFrame:
    """All results of every query in one order."""
    return fusion.ranking(table(spark, d, "find_results"), "query_id", "result_id", SCORES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.top(p1_order(spark, d), "query_id", table(spark, d, "find_queries"), "want_k").select("query_id", "result_id")


def p2_places(spark: SparkSession, d: str) -> DataFrame:
    """Where secrets stand, in files and in blamed lines; rows delivered twice count once."""
    return secrets.places_in_files(table(spark, d, "source_files")).unionByName(secrets.places_in_lines(table(spark, d, "blame_lines"))).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_places(spark, d).select("origin", "record_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every file and every blamed line with its secrets masked; origin and record_id as in p2_found."""
    files = distinct_rows(table(spark, d, "source_files").select("file_id", "rel_path", "content"), "file_id")
    texts = secrets.redacted(files, "file_id", "rel_path", "content").select(F.lit("file").alias("origin"), F.col("file_id").alias("record_id"), "content", "n_secrets")
    lines = secrets.redacted_lines(table(spark, d, "blame_lines")).select(F.lit("blame").alias("origin"), F.col("blame_id").alias("record_id"), "content", "n_secrets")
    return texts.unionByName(lines)


#: Cells that a vector visits: all vectors as they are held against each other, and those few that ask for their ten best.
PROBES_ALL, PROBES_FEW = 5, 40


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.valid_vectors(table(spark, d, "chunks"), table(spark, d, "model_configs"), "chunk_id", "model_name", "embedding")


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    """p3_nearest by comparing all with all: what recall is measured against."""
    edges = neighbors.search_exact(_vectors(spark, d), 10, asking_every=50)
    return neighbors.best_of(edges, 10).select(F.col("id").alias("chunk_id"), F.col("other").alias("similar_id"), F.round("similarity", 6).alias("similarity"), "rank")


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """One row: how many of the ten nearest of the asking chunks p3_nearest finds."""
    found = p3_nearest(spark, d).select("chunk_id", "similar_id", F.lit(1).alias("found"))
    rows = p3_exact(spark, d).join(found, ["chunk_id", "similar_id"], "left")
    return rows.agg(F.count("*").alias("nearest"), F.count("found").alias("found"), F.round(F.count("found") / F.count("*"), 4).alias("recall"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """As pairs count from 0.80 only, the ten best of a chunk among those decide."""
    edges = neighbors.search(_vectors(spark, d), 10, PROBES_ALL, at_least=0.80)
    return neighbors.mutual(edges, 10).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks of every chunk whose id is divisible by 50, among all chunks."""
    edges = neighbors.search(_vectors(spark, d), 10, PROBES_FEW, asking_every=50)
    return neighbors.best_of(edges, 10).select(F.col("id").alias("chunk_id"), F.col("other").alias("similar_id"), "similarity", "rank")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "source_files"), table(spark, d, "upstream_files"), table(spark, d, "scan_configs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_reasons(spark, d).select("file_id")


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    """Files copied from published libraries or between repositories, with the share of their lines in the original."""
    found = provenance.copies(provenance.line_index(table(spark, d, "source_files"), table(spark, d, "upstream_files")))
    return found.select("id", "owner", F.round("containment", 6).alias("containment"))


def _pieces(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    return splitting.split_items(
        chunks, "chunk_id", "text", table(spark, d, "model_configs").withColumnRenamed("model_name", "model"), "model", "max_chunk_chars",
        "overlap_chars", "start_line"
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").withColumnRenamed("model_name", "model")
    return _pieces(spark, d, chunks).where("n_pieces > 1").select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of every chunk, a chunk delivered twice once."""
    chunks = table(spark, d, "chunks").withColumnRenamed("model_name", "model")
    return _pieces(spark, d, distinct_rows(chunks.select("chunk_id", "text", "model", "start_line"), "chunk_id"))


def _capacity(spark: SparkSession, d: str, name: str) -> int:
    """One row of a table of two: a parameter of the query."""
    return int(table(spark, d, "pack_specs").where(F.col("spec_name") == name).agg(F.max("capacity_tokens")).first()[0])


def _windows(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, int]:
    capacity = _capacity(spark, d, name)
    return packing.pack_windows(mixing.sized_documents(table(spark, d, "documents")), capacity), capacity


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The texts that lie in several of the packed containers, held against every public tokenizer."""
    packed, capacity = _windows(spark, d, "window_small")
    divided = durable(packing.divided(packed))
    texts = table(spark, d, "documents").select("doc_id", "text").join(small_side(divided), "doc_id", "left_semi")
    return tokens.above_in_all(texts, "text", capacity).select("doc_id").distinct()


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d, "window_small")[0]


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(*_windows(spark, d, "window_wide"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).where("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, d, "documents"))
    return mixing.mix(sized, mixing.plan_mix(sized, table(spark, d, "mix_targets")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, d, "documents"))
    plan = mixing.plan_mix(sized, table(spark, d, "mix_targets"))
    return mixing.shares(mixing.mix(sized, plan), plan)


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).where("band = 5").select("doc_id")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, language and band."""
    source = table(spark, d, "documents").select("doc_id", mixing.source_key(F.col("source")).alias("source")).dropDuplicates(["doc_id"])
    return p8_levels(spark, d).join(source, "doc_id").groupBy("source", "language", "band").agg(F.count("*").alias("n_docs"), F.round(F.avg("grade"), 3).alias("mean_grade"))


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    """Errors of grades on held-out sources and languages."""
    return reading.quality(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_order, p2_found, p2_places, p2_redacted, p3_found, p3_nearest, p3_exact, p3_recall, p4_found, p4_reasons, p4_copies, p5_found, p5_pieces, p6_found, p6_windows, p6_fill, p7_found, p7_mix, p7_shares, p8_found, p8_levels, p8_profile, p8_quality)}


_FUSED = """
WITH items AS (
  SELECT query_id, result_id, {maxima} FROM (
    SELECT query_id, result_id, {usable} FROM find_results WHERE query_id IS NOT NULL AND result_id IS NOT NULL)
  GROUP BY query_id, result_id),
ranked AS (SELECT query_id, result_id, {ranks} FROM items),
fused AS (SELECT query_id, result_id, round({total}, 12) AS fused FROM ranked)
""".format(
    maxima=", ".join(f"max({s}) AS {s}" for s in SCORES),
    usable=", ".join(f"CASE WHEN isnan({s}::DOUBLE) OR {s} <= 0 THEN NULL ELSE {s}::DOUBLE END AS {s}" for s in SCORES),
    ranks=", ".join(f"CASE WHEN {s} IS NULL THEN 0.0 ELSE 1 / (60.0 + rank() OVER (PARTITION BY query_id ORDER BY {s} DESC NULLS LAST)) END AS r_{s}" for s in SCORES),
    total=" + ".join(f"r_{s}" for s in SCORES),
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _FUSED + """
SELECT query_id, result_id FROM (
  SELECT f.query_id, f.result_id, want_k, row_number() OVER (PARTITION BY f.query_id ORDER BY fused DESC, result_id) AS n
  FROM fused f JOIN (SELECT query_id, max(want_k) AS want_k FROM find_queries GROUP BY query_id) q USING (query_id))
WHERE n <= want_k""",
        "p1_order": _FUSED + "SELECT query_id, result_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, result_id) AS position FROM fused",
        "p3_exact": """
WITH c AS (SELECT DISTINCT chunk_id, model_name, embedding::DOUBLE[] AS e FROM chunks JOIN model_configs USING (model_name)
  WHERE chunk_id IS NOT NULL AND len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT chunk_id, model_name, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM c),
s AS (SELECT q.chunk_id, o.chunk_id AS similar_id, round(list_dot_product(q.e, o.e), 9) AS similarity FROM u q JOIN u o ON q.model_name = o.model_name AND q.chunk_id <> o.chunk_id WHERE q.chunk_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY similarity DESC, similar_id)::INT AS rank FROM s)
SELECT chunk_id, similar_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10""",
        "p5_found": "SELECT DISTINCT chunk_id FROM chunks JOIN model_configs USING (model_name) WHERE length(text) > max_chunk_chars",
    }
