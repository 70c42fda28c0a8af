"""The cache of chunk vectors: appended Parquet, partitioned by model; of several entries of a file the newest counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.functions import encoder
from codeseam.operators import incremental, stubs
from codeseam.session import durable, small_side

KEYS = ["model_name", "repo", "path"]


def append(vectors: DataFrame, folder: str) -> None:
    """Add entries (model_name, repo, path, start_line, size, mtime, embedding); written_at is set."""
    vectors.withColumn("written_at", F.current_timestamp()).write.mode("append").partitionBy("model_name").parquet(folder)


def load(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    """The entries of each file's last writing; of one model only its partition is read."""
    rows = spark.read.parquet(folder)
    rows = rows if model is None else rows.where(F.col("model_name") == model)
    newest = F.max("written_at").over(Window.partitionBy(*KEYS))
    return rows.withColumn("newest", newest).where("written_at = newest").drop("newest", "written_at")


def status(cached: DataFrame, current: DataFrame) -> DataFrame:
    """(repo, state, files, percent): how much of each repository is cached as it is now, stale or missing."""
    files = cached.groupBy("repo", "path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    states = incremental.cache_state(files, current.select("repo", "path", "size", "mtime"), ["repo", "path"], ["size", "mtime"])
    counts = states.groupBy("repo", "state").agg(F.count("*").alias("files"))
    totals = counts.groupBy("repo").agg(F.sum("files").alias("all_files"))
    return counts.join(totals, "repo").select("repo", "state", "files", F.round(100 * F.col("files") / F.col("all_files"), 1).alias("percent"))


def write_metadata(cached: DataFrame, folder: str, remotes: dict[str, str] | None = None) -> None:
    """Chunks and files by model and repository, as JSON with the time of writing and the repositories' remotes where they are known."""
    rows = cached.groupBy("model_name", "repo").agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"))
    remote = F.element_at(F.create_map(*(F.lit(x) for pair in remotes.items() for x in pair)), F.col("repo")) if remotes else F.lit(None).cast("string")
    rows.withColumns({"built": F.unix_timestamp(), "remote": remote}).coalesce(1).write.mode("overwrite").json(folder)


def refresh(files: DataFrame, folder: str, model: str, chunk_bytes: int = 1_500) -> DataFrame:
    """Bring the cache of a model up to date with files (file_id, repo, path, ext, size, mtime, content) and return the states.

    (repo, path, state) as of before: hit files are left alone, those that are stale or missing are cut into chunks,
    encoded and appended. Which files these are is told from sizes and times; only their texts are read.
    """
    spark = files.sparkSession
    try:
        cached = load(spark, folder, model).groupBy("repo", "path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))
    except AnalysisException:  # nothing is cached yet
        cached = files.select("repo", "path", "size", "mtime").limit(0)
    wanted = files.where(C.embeddable(F.col("path"), F.octet_length("content")))
    states = durable(incremental.cache_state(cached, wanted.select("repo", "path", "size", "mtime").distinct(), ["repo", "path"], ["size", "mtime"]))
    todo = wanted.join(small_side(states.where("state <> 'hit'").select("repo", "path")), ["repo", "path"], "left_semi")
    chunks = stubs.chunk_table(todo, chunk_bytes).join(todo.select("file_id", "repo", "path", "size", "mtime"), "file_id")
    append(chunks.select(F.lit(model).alias("model_name"), "repo", "path", "start_line", "size", "mtime", encoder.encode(F.col("text"), model).alias("embedding")), folder)
    return states


def write_responses(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables as JSON under their names, written once for viewers that ask for the same again and again."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
