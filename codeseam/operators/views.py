"""What a viewer of the corpus asks for: clusters, highlights, colours, related files, previews, flat trees, cache keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.operators import graph
from codeseam.session import numbered, small_side


def cluster_bounds(points: DataFrame, group: str) -> DataFrame:
    """(group, x, y, radius): the centre of each group's points and the farthest of them, with a margin of 20."""
    centre = points.groupBy(group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    far = points.join(centre, group).groupBy(group, "cx", "cy").agg(F.max(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))).alias("far"))
    return far.select(group, F.round("cx", 6).alias("x"), F.round("cy", 6).alias("y"), F.round(F.col("far") + 20, 6).alias("radius"))


def highlight(deps: DataFrame, focus: str) -> DataFrame:
    """(node, role): the focus and its neighbours in either direction."""
    near = deps.where(F.col("module") == focus).select(F.col("dep").alias("node")).unionByName(deps.where(F.col("dep") == focus).select(F.col("module").alias("node")))
    return near.distinct().where(F.col("node") != focus).withColumn("role", F.lit("neighbour")).unionByName(
        deps.sparkSession.createDataFrame([(focus, "focus")], "node string, role string")
    )


def search_set(modules: DataFrame, term: str) -> DataFrame:
    """(module) of the modules whose name or category holds a term, whatever its case; all for an empty one."""
    low = F.lit(term.lower())
    return modules.where(F.contains(F.lower("module"), low) | F.contains(F.lower("module_category"), low)).select("module").distinct()


def blended(files: DataFrame, palette: dict[str, tuple[int, int, int]], base: int = 128, mix: float = 0.35) -> DataFrame:
    """(node, red, green, blue): colours of the extensions below each category, weighted by files, mixed into a base."""
    rows = files.select(F.explode(C.ancestors(F.col("category"))).alias("node"), "ext").where(F.col("ext").isin(list(palette)))
    part = lambda k: F.create_map(*(F.lit(x) for e, v in palette.items() for x in (e, v[k])))[F.col("ext")]
    mean = rows.groupBy("node").agg(*(F.avg(part(k)).alias(n) for k, n in enumerate(("r", "g", "b"))))
    return mean.select("node", *(F.round(base * (1 - mix) + F.col(n) * mix, 4).alias(full) for n, full in (("r", "red"), ("g", "green"), ("b", "blue"))))


def related_headers(files: DataFrame, scores: DataFrame, deps: DataFrame) -> DataFrame:
    """(file_id, score): headers of modules one step from those with a direct hit, at 0.3 of the best direct score.

    files: file_id, ext, module; scores: file_id, score.
    """
    direct = files.join(scores, "file_id")
    best = direct.agg(F.max("score").alias("best"))
    near = graph.expand(deps, direct.select("module").where("module is not null").distinct())
    rows = files.where("ext = 'h'").join(small_side(near), "module", "left_semi").join(scores, "file_id", "left_anti")
    return rows.crossJoin(F.broadcast(best)).select("file_id", F.round(F.col("best") * 0.3, 6).alias("score"))  # one row


def selected_modules(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(module): modules whose category is that of a selected file or above it, or that are named like the last part of one.

    files: category, selected; modules: module, module_category.
    """
    chosen = files.where("selected").select("category").distinct()
    up = chosen.select(F.explode(C.ancestors(F.col("category"))).alias("module_category")).distinct()
    last = chosen.select(F.element_at(F.split("category", " > "), -1).alias("module")).distinct()
    return modules.join(up, "module_category", "left_semi").select("module").unionByName(modules.join(last, "module", "left_semi").select("module")).distinct()


def preview(snippet: Column) -> Column:
    """The first line of a chunk that is neither blank nor the header of its path."""
    return F.get(F.filter(C.lines(snippet), lambda x: (F.trim(x) != "") & ~x.startswith("// File:")), F.lit(0))


def cache_identity(remote: Column) -> Column:
    """A file name for a repository's remote: without scheme, user and .git, in lower case, `:` and `/` as `_`."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(remote), r"^(?:[a-z+]+://)?(?:[^@/]*@)?", ""), r"\.git/?$", "")
    return F.lower(F.translate(F.replace(bare, F.lit(":"), F.lit("/")), "/", "_"))


def flat_tree(files: DataFrame) -> DataFrame:
    """(repo, node, depth, files, place): the categories of each repository in the order in which a tree shows them, parents before children."""
    rows = files.select("repo", F.explode(C.ancestors(F.col("category"))).alias("node")).groupBy("repo", "node").agg(F.count("*").alias("files"))
    keyed = rows.withColumn("key", F.array_join(F.split("node", " > "), "\x01"))
    return numbered(keyed, "repo", [("key", False)], "place").select(
        "repo", "node", F.size(F.split("node", " > ")).alias("depth"), "files", F.col("place").cast("int").alias("place")
    )


def tree_json(files: DataFrame) -> str:
    """Categories and their files as nested JSON, leaves under _files; of one repository, for a viewer."""
    tree: dict = {}
    for r in files.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("path", "size"))).alias("f")).orderBy("category").toLocalIterator():
        at = tree
        for part in r["category"].split(" > "):
            at = at.setdefault(part, {})
        at["_files"] = [{"path": x["path"], "size": x["size"]} for x in r["f"]]
    return json.dumps(tree, sort_keys=True)


def validation_count(files: DataFrame, most: int = 10_000) -> int:
    """Files under the filters, counted up to a limit."""
    return files.limit(most).count()


def path_prompts(files: DataFrame, most: int = 200) -> DataFrame:
    """(repo, category, piece, text): the paths of each category as texts of at most `most` paths; each path once."""
    paths = files.select("repo", "category", "path").distinct().withColumn("key", F.struct("repo", "category"))
    placed = numbered(paths, "key", [("path", False)], "n").withColumn("piece", F.floor(F.col("n") / most))
    rows = placed.groupBy("repo", "category", "piece").agg(F.array_sort(F.collect_list("path")).alias("paths"))  # at most `most`
    text = F.concat(F.lit("## "), "category", F.lit("\n"), F.array_join(F.transform("paths", lambda p: F.concat(F.lit("- "), p)), "\n"))
    return rows.select("repo", "category", "piece", text.alias("text"))


def content_prompts(files: DataFrame, most: int = 200) -> DataFrame:
    """(repo, piece, files, text): the texts of each repository's files by path, each under its path, `most` files a piece."""
    places = numbered(files.select("file_id", "repo", "path"), "repo", [("path", False), ("file_id", False)], "n")
    rows = files.select("file_id", "path", "content").join(places.select("file_id", "repo", F.floor(F.col("n") / most).alias("piece")), "file_id")
    one = F.concat(F.lit("// File: "), "path", F.lit("\n"), "content").alias("text")
    pieces = rows.groupBy("repo", "piece").agg(F.array_sort(F.collect_list(F.struct("path", "file_id", one))).alias("f"))
    return pieces.select("repo", "piece", F.size("f").cast("long").alias("files"), F.array_join("f.text", "\n\n").alias("text"))
