"""Hybrid ranking: names with content, keywords with vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reranking.
NOISY_LIBS = ("boost", "icu4c", "imgui", "embree", "directshow", "vulkan", "zlib", "freetype", "openssl", "libpng", "metricsdiscovery")
OUTSIDE, FIRST_PARTY = ("/thirdparty/", "/external/", "/intermediate/"), ("/engine/source/runtime/", "/engine/source/editor/", "/engine/plugins/")
MIN_COSINE, OVERSAMPLE, RRF_K = 0.25, 6, 60


def hybrid(rows: DataFrame, group: Sequence[str], name: str, content: str, terms: str) -> DataFrame:
    """rows with combined and match: both scores against the largest of their group (of all without a group), weighted, a quarter more for both.

    A score that is null or NaN counts as 0. Several terms give the content 0.6, one term gives the name 0.6. The
    largest scores come from an aggregate joined back, not from a window over the group.
    """
    clean = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.col(c).cast("double"))
    base = rows.withColumn("__n", F.greatest(clean(name), F.lit(0.0))).withColumn("__c", F.greatest(clean(content), F.lit(0.0)))
    most = base.groupBy(*group).agg(F.greatest(F.max("__n"), F.lit(1.0)).alias("__mn"), F.greatest(F.max("__c"), F.lit(1.0)).alias("__mc"))
    wn = F.when(F.col(terms) > 1, 0.4).otherwise(0.6)
    score = F.col("__n") / F.col("__mn") * wn + F.col("__c") / F.col("__mc") * (1 - wn)
    both = (F.col("__n") > 0) & (F.col("__c") > 0)
    label = F.when(both, "both").when(F.col("__n") > 0, "name").when(F.col("__c") > 0, "content").otherwise("none")
    placed = base.join(most, list(group)) if group else base.crossJoin(F.broadcast(most))  # without a group `most` is one row
    out = placed.withColumn("combined", F.round(score * F.when(both, 1.25).otherwise(1.0), 6)).withColumn("match", label)
    return out.drop("__n", "__c", "__mn", "__mc")


def find(names: DataFrame, contents: DataFrame, n_terms: int, limit: int) -> DataFrame:
    """(repo, path, name_score, content_score, combined, match): both sides by path, the best `limit`."""
    rows = names.select("repo", "path", F.col("score").alias("name_score")).join(
        contents.select("repo", "path", F.col("score").alias("content_score")), ["repo", "path"], "full_outer"
    )
    rows = rows.fillna(0.0, ["name_score", "content_score"]).withColumn("terms", F.lit(n_terms))
    scored = hybrid(rows, [], "name_score", "content_score", "terms").select("repo", "path", "name_score", "content_score", "combined", "match")
    return scored.orderBy(F.desc("combined"), "repo", "path").limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(chunks: DataFrame, query: DataFrame, limit: int | None, at_least: float | None = MIN_COSINE) -> DataFrame:
    """(file_path, start_line, cosine) of the chunks most like the one query vector (a row with `query`), in unit length; all in no order if limit is None."""
    scored = chunks.crossJoin(F.broadcast(query.select("query").limit(1))).select(
        "file_path", "start_line", F.round(dot(F.col("embedding"), F.col("query")), 6).alias("cosine")
    )  # one row
    scored = scored if at_least is None else scored.where(F.col("cosine") >= at_least)
    return scored if limit is None else scored.orderBy(F.desc("cosine"), "file_path", "start_line").limit(limit)


def adjusted(cosine: Column, path: Column, terms: list[str]) -> Column:
    """The cosine less for code from outside, more for headers, terms in the path and the engine's own source."""
    low = F.lower(path)
    any_of = lambda words: F.coalesce(F.greatest(*(F.contains(low, F.lit(w)) for w in words)), F.lit(False))
    hits = sum((F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0) for t in terms if len(t) >= 4), F.lit(0))
    score = cosine * F.when(any_of(OUTSIDE), 0.3).otherwise(1.0) * F.when(any_of(NOISY_LIBS), 0.2).otherwise(1.0)
    score = score * F.when(F.regexp_extract(path, r"([^.]*)$", 1).isin("h", "hpp", "hxx"), 1.15).otherwise(1.0) * (1 + 0.15 * hits)
    return score * F.when(any_of(FIRST_PARTY), 1.1).otherwise(1.0)


def rerank(chunks: DataFrame, query: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(file_path, start_line, score): oversampled by cosine, reranked by path, one chunk per file."""
    few = nearest(chunks, query, limit * OVERSAMPLE).withColumn("score", F.round(adjusted(F.col("cosine"), F.col("file_path"), terms), 6))
    best = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "start_line"))
    one = few.withColumn("r", best).where("r = 1").select("file_path", "start_line", "score")
    return one.orderBy(F.desc("score"), "file_path").limit(limit)


def reciprocal_ranks(lists: Sequence[DataFrame], key: str, score: str, limit: int, k: int = RRF_K) -> DataFrame:
    """(key, fused, n_lists) of short ranked lists (each already cut by a limit): the sum of 1 / (k + rank), the best `limit`."""
    ranked = [x.select(key, (1.0 / (k + F.row_number().over(Window.orderBy(F.desc(score), key)))).alias("part")) for x in lists]
    rows = ranked[0]
    for other in ranked[1:]:
        rows = rows.unionByName(other)
    fused = rows.groupBy(key).agg(F.round(F.sum("part"), 9).alias("fused"), F.count("*").alias("n_lists"))
    return fused.orderBy(F.desc("fused"), key).limit(limit)
