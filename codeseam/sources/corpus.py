"""Logical tables of a code corpus, as views over the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.session import distinct_rows, small_side, table


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    """Scanned files with their text, as they were delivered: file_id, repo, path (with /), filename, ext (lower case), size, mtime, bytes, content.

    Files without text or path are left out. A file may occur twice; see distinct_file_rows.
    """
    path = F.translate(F.col("rel_path"), "\\", "/")
    rows = table(spark, d, "source_files").where("content is not null and rel_path is not null").select("file_id", "repo", path.alias("path"), "size", "mtime", "content")
    return rows.select(
        "file_id", "repo", "path", C.filename(F.col("path")).alias("filename"), F.lower(C.extension(F.col("path"))).alias("ext"), "size", "mtime",
        F.octet_length("content").alias("bytes"), "content"
    )


def distinct_file_rows(spark: SparkSession, d: str) -> DataFrame:
    """file_rows with each file once; which rows stay is decided by ids, and only the texts of files delivered twice are shuffled."""
    return distinct_rows(file_rows(spark, d), "file_id")


def once(rows: DataFrame) -> DataFrame:
    """One row for each file."""
    return rows.dropDuplicates(["file_id"])


def files(spark: SparkSession, d: str) -> DataFrame:
    """One row per scanned file, without its text."""
    return once(file_rows(spark, d).drop("content"))


def categorised(spark: SparkSession, d: str) -> DataFrame:
    """files with their category under the scan configuration of their repository."""
    configs = small_side(table(spark, d, "scan_configs").select("repo", "scan_dirs", "noise_dirs").dropDuplicates(["repo"]))
    return files(spark, d).join(configs, "repo", "left").withColumn("category", C.category(F.col("path"), F.col("scan_dirs"), F.col("noise_dirs"))).drop("scan_dirs", "noise_dirs")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per vector of the embeddings table, as a chunk of a file named after its label."""
    return table(spark, d, "embeddings").select(
        F.concat(
            F.lit("src/engine/label_"), F.col("label").cast("string"), F.when(F.col("vec_id") % 3 == 0, ".h").otherwise(".cpp")
        ).alias("file_path"), F.col("vec_id").alias("start_line"), F.col("embedding").cast("array<double>").alias("embedding")
    )


def module_deps(spark: SparkSession, d: str) -> DataFrame:
    """(module, dep, kind): packages and what they depend on, public or private, from orders of parts by suppliers."""
    kind = F.when(F.col("l_returnflag") == "N", "public").otherwise("private")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("module"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dep"), kind.alias("kind")
    ).distinct()


def fk_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): a graph of imports, each row of a table importing what it refers to."""
    edge = lambda name, a, k, b, r: table(spark, d, name).select(F.concat(F.lit(f"{a}:"), F.col(k)).alias("src"), F.concat(F.lit(f"{b}:"), F.col(r)).alias("dst"))
    return (
        edge("nation", "nation", "n_nationkey", "region", "n_regionkey")
        .unionByName(edge("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(edge("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(edge("orders", "orders", "o_orderkey", "customer", "o_custkey"))
        .unionByName(
            table(spark, d, "lineitem").select(
                F.concat(F.lit("lineitem:"), F.col("l_orderkey"), F.lit("."), F.col("l_linenumber")).alias("src"),
                F.concat(F.lit("orders:"), F.col("l_orderkey")).alias("dst")
            )
        )
    )


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("hash"), F.concat(F.lit("a"), F.col("o_custkey")).alias("author"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("message")
    )


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "deleted").otherwise("modified")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.concat(F.lit("part/"), F.col("l_partkey")).alias("path"), status.alias("status"))


def session_reads(spark: SparkSession, d: str) -> DataFrame:
    """(session_id, path, tokens, ts) of reads in sessions, from events."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("path"),
        F.floor(F.col("value")).cast("long").alias("tokens"), "ts"
    )
