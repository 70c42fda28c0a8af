"""Counts and roll-ups over files (with their bytes) and their categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.session import numbered


def modules(files: DataFrame) -> DataFrame:
    """(id, id_lower, name, file_count): one module per category."""
    rows = files.groupBy(F.col("category").alias("id")).agg(F.count("*").alias("file_count"))
    return rows.select("id", F.lower("id").alias("id_lower"), F.element_at(F.split("id", " > "), -1).alias("name"), "file_count")


def totals(files: DataFrame) -> DataFrame:
    """One row: files, bytes, lines of code (a line for every 40 bytes begun), top-level modules."""
    top = F.split("category", " > ")[0]
    size = F.sum("bytes")
    return files.agg(F.count("*").alias("files"), size.alias("bytes"), F.ceil(size / 40).cast("long").alias("loc"), F.countDistinct(top).alias("modules"))


def languages(files: DataFrame, most: int) -> DataFrame:
    rows = files.where("ext <> ''").groupBy("ext").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return rows.orderBy(F.desc("files"), "ext").limit(most)


def size_buckets(files: DataFrame) -> DataFrame:
    b = F.col("bytes")
    bucket = F.when(b < 1_000, "<1K").when(b < 10_000, "<10K").when(b < 100_000, "<100K").when(b < 1_000_000, "<1M").otherwise(">=1M")
    return files.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"))


def largest(files: DataFrame, most: int) -> DataFrame:
    return files.select("repo", "path", "bytes").orderBy(F.desc("bytes"), "repo", "path").limit(most)


def facets(files: DataFrame) -> DataFrame:
    """(facet, value, files) by extension and by category, in one pass."""
    sets = files.groupingSets([["ext"], ["category"]], "ext", "category").agg(F.grouping("ext").alias("by_category"), F.count("*").alias("files"))
    value = F.when(F.col("by_category") == 1, F.col("category")).otherwise(F.col("ext"))
    return sets.select(F.when(F.col("by_category") == 1, "category").otherwise("ext").alias("facet"), value.alias("value"), "files").where("value <> ''")


def status(files: DataFrame) -> DataFrame:
    """(repo, files, modules) with a total whose repo is null."""
    return files.rollup("repo").agg(F.count("*").alias("files"), F.countDistinct("category").alias("modules"))


def subtrees(files: DataFrame) -> DataFrame:
    """(node, files, exts) for every category and every category above one."""
    rows = files.select(F.nullif(F.col("ext"), F.lit("")).alias("ext"), F.explode(C.ancestors(F.col("category"))).alias("node"))
    return rows.groupBy("node").agg(F.count("*").alias("files"), F.countDistinct("ext").alias("exts"))


def subtree_extensions(files: DataFrame, most: int = 5) -> DataFrame:
    """(node, ext, files): the extensions of each subtree with most files."""
    rows = files.where("ext <> ''").select("ext", F.explode(C.ancestors(F.col("category"))).alias("node")).groupBy("node", "ext").agg(F.count("*").alias("files"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("files"), "ext"))  # of extensions, not of files
    return rows.withColumn("place", place).where(F.col("place") <= most).select("node", "ext", "files")


def ordered(files: DataFrame) -> DataFrame:
    """(file_id, repo, place): files of each repository by category, path and id."""
    rows = files.select("file_id", "repo", F.struct("category", "path", "file_id").alias("key"))
    return numbered(rows, "repo", [("key", False)], "place").select("file_id", "repo", "place")


def import_sources(imports: DataFrame) -> DataFrame:
    """(repo, sources, targets) of files that import anything and of what is imported, with a total whose repo is null."""
    return imports.rollup("repo").agg(F.countDistinct("repo", "src").alias("sources"), F.countDistinct("target").alias("targets"))


def selection(files: DataFrame) -> DataFrame:
    """(node, files, selected, state): whether all, some or none of a subtree's files are selected."""
    rows = files.select("selected", F.explode(C.ancestors(F.col("category"))).alias("node"))
    state = F.when(F.bool_and("selected"), "all").when(F.bool_or("selected"), "some").otherwise("none")
    return rows.groupBy("node").agg(F.count("*").alias("files"), F.count_if("selected").alias("selected"), state.alias("state"))


def group_best(rows: DataFrame, group: str, score: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("members"), F.max(score).alias("best"))


def selections(files: DataFrame, first: Column, second: Column) -> DataFrame:
    """(repo, n_union, n_both, n_left): paths selected by either rule, by both, and by the first but not the second, each once."""
    rows = files.groupBy("repo", "path").agg(F.max(first).alias("a"), F.max(second).alias("b"))
    return rows.groupBy("repo").agg(
        F.count_if(F.col("a") | F.col("b")).alias("n_union"), F.count_if(F.col("a") & F.col("b")).alias("n_both"),
        F.count_if(F.col("a") & ~F.col("b")).alias("n_left")
    )
