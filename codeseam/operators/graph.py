"""Imports and dependencies as edge tables: extraction, resolution, traversal, degrees and expansion."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.session import HOT_ROWS, SMALL_ROWS, durable, numbered, small_side

# How imports look in each family of languages (extensions, pattern with one group).
IMPORTS = (
    ("h hpp hxx cpp cxx cc c usf ush hlsl glsl", r'#include\s+"([^"]+)"'),
    ("py", r"from\s+([\w.]+)\s+import"),
    ("py", r"(?m)^import\s+([\w.]+)"),
    ("js ts jsx tsx mjs cjs", r"from\s+['\"]([^'\"]+)['\"]"),
    ("js ts jsx tsx mjs cjs", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    ("rs", r"use\s+(?:crate|super)::(\w+)"),
    ("rs", r"mod\s+(\w+)\s*;"),
    ("go", r'import\s+(?:\(\s*)?"([^"]+)"'),
    ("cs", r"(?m)^using\s+(?:static\s+)?([\w.]+)\s*;"),
    ("ps1 psm1 psd1", r"(?m)\.\s+['\".]?\.?[\\/]?([^\s'\"]+\.ps[md]?1)"),
    ("ps1 psm1 psd1", r"(?mi)Import-Module\s+['\".]?\.?[\\/]?([^\s'\";\)]+)"),
)
NAMESPACE = r"(?m)^namespace\s+([\w.]+)"
SYSTEM_NAMESPACES = ("System", "Microsoft")


def extract_imports(files: DataFrame) -> DataFrame:
    """(repo, src, ext, target): what each file imports, as written, once each; every file is read once."""
    own = lambda exts, pattern: F.when(
        F.col("ext").isin(exts.split()), F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.flatten(F.array(*(own(*i) for i in IMPORTS))))
    return files.select("repo", F.col("path").alias("src"), "ext", F.explode(found).alias("target")).where("target <> ''").select("repo", "src", "ext", "target").distinct()


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the candidates of an import those whose path ends with it come first, then the first path."""
    return rows.groupBy(*keys).agg(F.min(F.struct((~F.col("dst").endswith(F.col("target"))).alias("far"), "dst")).alias("m")).select(*keys, F.col("m.dst").alias("dst"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, target, dst): within the repository by file name, else by the last part as a stem; dst is null if there is none.

    Of several candidates the first path counts; a file never imports itself. Each spelling of a target is looked up once,
    however many files import it, and each stem is its first path, however many files have it.
    """
    keys = ["repo", "target"]
    last = F.regexp_extract("target", "([^/.]*)$", 1)
    targets = imports.select(*keys).distinct().select(*keys, C.filename(F.col("target")).alias("name"), last.alias("stem"))
    named = files.select("repo", F.col("path").alias("dst"), F.col("filename").alias("name"))
    by_name = _first(targets.select(*keys, "name").join(named, ["repo", "name"]), keys).withColumnRenamed("dst", "by_name")
    by_stem = files.groupBy("repo", C.stem(F.col("path")).alias("stem")).agg(F.min("path").alias("by_stem"))
    found = targets.join(by_name, keys, "left").join(by_stem, ["repo", "stem"], "left").select(*keys, F.coalesce("by_name", "by_stem").alias("dst"))
    rows = imports.select("repo", "src", "target").distinct().join(found, keys, "left")
    return rows.select("repo", "src", "target", F.when(F.col("dst") != F.col("src"), F.col("dst")).alias("dst"))


def namespace_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, dst) of `using` lines: files of the very namespace, else those of namespaces below it."""
    spaces = files.where("ext = 'cs'").select("repo", F.col("path").alias("dst"), F.regexp_extract("content", NAMESPACE, 1).alias("space")).where("space <> ''")
    using = imports.where((F.col("ext") == "cs") & ~F.split("target", r"\.")[0].isin(list(SYSTEM_NAMESPACES))).select("repo", "src", "target").distinct()
    exact = using.join(spaces, (using["repo"] == spaces["repo"]) & (using["target"] == spaces["space"])).select(using["repo"], "src", "target", "dst")
    # A namespace lies below each of its prefixes: an equi-join on those instead of a comparison of all with all.
    parts = F.split("space", r"\.")
    above = spaces.select(
        "repo", "dst",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("target")
    ) if spaces.columns else spaces
    below = using.join(exact.select("repo", "src", "target"), ["repo", "src", "target"], "left_anti").join(above, ["repo", "target"])
    return exact.select("repo", "src", "dst").unionByName(below.select("repo", "src", "dst")).where("src <> dst").distinct()


def cross_repo_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(from_repo, from_file, to_repo, to_file): what isn't found in its own repository, by stem in the others (one file in each)."""
    missing = resolved.where("dst is null").select(F.col("repo").alias("from_repo"), F.col("src").alias("from_file"), F.regexp_extract("target", "([^/.]*)$", 1).alias("stem"))
    there = files.groupBy(F.col("repo").alias("to_repo"), C.stem(F.col("path")).alias("stem")).agg(F.min("path").alias("to_file"))
    return missing.join(there, "stem").where("from_repo <> to_repo").select("from_repo", "from_file", "to_repo", "to_file").distinct()


def all_edges(files: DataFrame) -> DataFrame:
    """(src, dst, away) of every import: at home by name or stem, by namespace, and (away) what isn't found at home in the others.

    Nodes are repository/path. files: repo, path, filename, ext, content.
    """
    imports = durable(extract_imports(files))
    names = files.select("repo", "path", "filename")
    resolved = durable(resolve_imports(imports, names))
    spaces = namespace_edges(imports, files)
    node = lambda repo, path: F.concat_ws("/", repo, path)
    home = resolved.where("dst is not null").select("repo", "src", "dst").unionByName(spaces)
    # A `using` that a namespace answers isn't looked for elsewhere.
    open_imports = resolved.join(
        spaces.select("repo", "src").distinct().withColumn("spaced", F.lit(True)), ["repo", "src"], "left"
    ).where(~(F.coalesce("spaced", F.lit(False)) & F.col("src").endswith(".cs"))).drop("spaced")
    away = cross_repo_edges(open_imports, names)
    edges = home.select(node("repo", "src").alias("src"), node("repo", "dst").alias("dst")).distinct().withColumn("away", F.lit(False))
    return edges.unionByName(away.select(node("from_repo", "from_file").alias("src"), node("to_repo", "to_file").alias("dst"), F.lit(True).alias("away")))


# --- traversal --------------------------------------------------------------------------------------------------------


def _front(nodes: DataFrame, n: int) -> DataFrame:
    """Broadcast for a front of few nodes; n is their number."""
    return F.broadcast(nodes) if n <= SMALL_ROWS else nodes


def reach(edges: DataFrame, start: list[str], max_depth: int) -> DataFrame:
    """(node, depth): what depends on the start nodes, directly or not, at its least depth; the start itself isn't in it.

    A round joins the newest nodes with the edges and drops those seen before; each round is kept in the shared folder.
    """
    spark = edges.sparkSession
    # Kept once by node: every round joins with it.
    back = durable(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct().repartition("node"))
    seen = spark.createDataFrame([(s, 0) for s in start], "node string, depth int")
    newest = seen
    n = len(start)
    for depth in range(1, max_depth + 1):
        found = back.join(_front(newest.select("node"), n), "node").select(F.col("next").alias("node")).distinct()
        newest = durable(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not (n := newest.count()):
            break
        seen = seen.unionByName(newest)
    return seen.where("depth > 0")


def impact(edges: DataFrame, start: list[str], max_depth: int) -> DataFrame:
    """(node, depth) as reach along the edges at home; files of other repositories that import one of these, or the start, come a step later and go no further."""
    edges = durable(edges)
    home = reach(edges.where("not away"), start, max_depth)
    there = home.unionByName(edges.sparkSession.createDataFrame([(s, 0) for s in start], "node string, depth int"))
    far = edges.where("away").join(there.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((F.min("depth") + 1).cast("int").alias("depth"))
    return home.unionByName(far.where(F.col("depth") <= max_depth).join(there.select("node"), "node", "left_anti"))


def shortest_paths(edges: DataFrame, start: str, goals: list[str], max_depth: int | None = None) -> DataFrame:
    """(goal, path, hops) with a shortest way along the edges to each goal, the first in order among equals; goals out of reach have no row.

    A round per hop, until all goals are met or nothing new is: however long the ways are, unless max_depth bounds them.
    """
    spark = edges.sparkSession
    step = durable(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct().repartition("node"))
    newest = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen, found, missing = newest.select("node"), spark.createDataFrame([], newest.schema), set(goals)
    for _ in itertools.count() if max_depth is None else range(max_depth + 1):
        hits = newest.where(F.col("node").isin(sorted(missing)))
        if met := {r["node"] for r in hits.select("node").collect()}:
            missing -= met
            found = found.unionByName(hits)
        if not missing:
            break
        ways = newest.join(step, "node").select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        newest = durable(ways.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"))
        if newest.isEmpty():
            break
        seen = durable(seen.unionByName(newest.select("node")))
    return found.select(F.col("node").alias("goal"), F.array_join("path", " -> ").alias("path"), (F.size("path") - 1).alias("hops"))


def connections(deps: DataFrame, selected: list[str], max_nodes: int = 6) -> DataFrame:
    """(a, b, kind, path) for each pair of selected modules: a direct edge by kind and direction, else the shorter of the two ways."""
    spark = deps.sparkSession
    pairs = [(a, b) for n, a in enumerate(sorted(selected)) for b in sorted(selected)[n + 1 :]]
    chosen = sorted(set(selected))
    direct = {(r["module"], r["dep"]): r["kind"] for r in deps.where(F.col("module").isin(chosen) & F.col("dep").isin(chosen)).groupBy("module", "dep").agg(F.max("kind").alias("kind")).collect()}
    edges = deps.select(F.col("module").alias("src"), F.col("dep").alias("dst"))
    ways = {(a, r["goal"]): r["path"] for a in chosen for r in shortest_paths(edges, a, [x for x in chosen if x != a], max_nodes - 1).collect()} if any(
        (a, b) not in direct and (b, a) not in direct for a, b in pairs
    ) else {}
    out = []
    for a, b in pairs:
        if (a, b) in direct:
            out.append((a, b, direct[a, b], f"{a} -> {b}"))
        elif (b, a) in direct:
            out.append((a, b, direct[b, a], f"{b} -> {a}"))
        elif both := [w for w in (ways.get((a, b)), ways.get((b, a))) if w]:
            out.append((a, b, "path", min(both, key=lambda w: w.count("->"))))
    return spark.createDataFrame(out, "a string, b string, kind string, path string")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(direction, node): what a node imports and what imports it."""
    out = edges.where(F.col("src") == node).select(F.lit("imports").alias("direction"), F.col("dst").alias("node"))
    return out.unionByName(edges.where(F.col("dst") == node).select(F.lit("imported_by").alias("direction"), F.col("src").alias("node"))).distinct()


# --- dependencies of modules ------------------------------------------------------------------------------------------


def degrees(deps: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, radius): edges counted by kind, with the size of the node in a drawing."""
    ends = deps.select(F.col("module").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        deps.select(F.col("dep").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    rows = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    c = F.col("out_degree") + F.col("in_degree")
    radius = F.greatest(F.lit(1.5), F.when(c <= 25, 0.8 * F.sqrt(c.cast("double"))).otherwise(4 + 1.5 * F.log2(c / 25)))
    return rows.withColumn("radius", F.round(radius, 6))


def shared(deps: DataFrame, selected: list[str], most: int = 15) -> DataFrame:
    """(dep, modules): dependencies of at least two of the selected modules, which themselves don't count."""
    rows = deps.where(F.col("module").isin(selected) & ~F.col("dep").isin(selected)).groupBy("dep").agg(F.countDistinct("module").alias("modules")).where("modules >= 2")
    return rows.orderBy(F.desc("modules"), "dep").limit(most)


def reverse_index(deps: DataFrame) -> DataFrame:
    """(dep, module): who depends on it, once each; rows and no list, as one dependency may have most of the modules."""
    return deps.select("dep", "module").distinct()


def expand(deps: DataFrame, matched: DataFrame) -> DataFrame:
    """(module): one step from the matched modules in either direction, without them."""
    m = small_side(matched.select("module").distinct())
    ahead = deps.join(m, "module", "left_semi").select(F.col("dep").alias("module"))
    behind = deps.join(m.withColumnRenamed("module", "dep"), "dep", "left_semi").select("module")
    return ahead.unionByName(behind).distinct().join(m, "module", "left_anti")


def levels(deps: DataFrame, root: str, max_depth: int, reverse: bool = False) -> DataFrame:
    """(node, depth, kind): the tree of dependencies below a module, each node once, public edges before private ones; or, in
    reverse, of what depends on it."""
    spark = deps.sparkSession
    if reverse:
        deps = deps.select(F.col("dep").alias("module"), F.col("module").alias("dep"), "kind")
    deps = durable(deps.select("module", "dep", "kind").distinct().repartition("module"))
    seen = spark.createDataFrame([(root, 0, "root")], "node string, depth int, kind string")
    newest, n = seen, 1
    for depth in range(1, max_depth + 1):
        found = deps.join(_front(newest.select(F.col("node").alias("module")), n), "module").groupBy(F.col("dep").alias("node")).agg(F.max("kind").alias("kind"))
        newest = durable(found.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "kind"))
        if not (n := newest.count()):
            break
        seen = seen.unionByName(newest)
    return seen


def adjacency(deps: DataFrame, modules: DataFrame) -> DataFrame:
    """(node, group, kind, neighbour): every edge from both its ends, with the first part of the node's category ('' if unknown).

    modules: module, module_category. An edge of both kinds counts as public.
    """
    one = deps.groupBy("module", "dep").agg(F.max("kind").alias("kind"))  # public is the later word
    both = one.select(F.col("module").alias("node"), "kind", F.col("dep").alias("neighbour")).unionByName(
        one.select(F.col("dep").alias("node"), "kind", F.col("module").alias("neighbour"))
    )
    groups = modules.groupBy(F.col("module").alias("node")).agg(F.min(F.split("module_category", " > ")[0]).alias("group"))
    return both.groupBy("node", "neighbour").agg(F.max("kind").alias("kind")).join(groups, "node", "left").select(
        "node", F.coalesce("group", F.lit("")).alias("group"), "kind", "neighbour"
    )


def lookup(categories: DataFrame, modules: DataFrame) -> DataFrame:
    """(category, module): the module named like the last part of a category, else the first whose category it is; null if none."""
    names = modules.groupBy(F.lower("module").alias("last")).agg(F.min("module").alias("named"))
    places = modules.groupBy(F.col("module_category").alias("category")).agg(F.min("module").alias("placed"))
    asked = categories.select("category").distinct().withColumn("last", F.lower(F.element_at(F.split("category", " > "), -1)))
    return asked.join(names, "last", "left").join(places, "category", "left").select("category", F.coalesce("named", "placed").alias("module"))


def closure(deps: DataFrame, modules: DataFrame, files: DataFrame, module: str) -> DataFrame:
    """(repo, path) of the files of a module, of what it depends on and of what depends on it, with their subtrees. files: repo, path, category."""
    near = expand(deps, deps.sparkSession.createDataFrame([(module,)], "module string"))
    wanted = modules.join(near.unionByName(deps.sparkSession.createDataFrame([(module,)], "module string")), "module", "left_semi")
    up = files.select("repo", "path", F.explode(C.ancestors(F.col("category"))).alias("module_category"))
    return up.join(wanted.select("module_category").distinct(), "module_category", "left_semi").select("repo", "path").distinct()


def longest_module(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files with the module whose category is theirs or the nearest above: a join on ancestors, of at most five."""
    up = files.select("file_id", F.explode(C.ancestors(F.col("category"))).alias("module_category"))
    return up.join(modules, "module_category").groupBy("file_id").agg(F.max_by("module", F.length("module_category")).alias("module"))


def attention_order(rows: DataFrame, group: str, score: str, tie: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with place: the best third first, then the last, the middle third at the end; below three by score alone.

    tie makes the order unique in a group. A large group is numbered by ranges, see session.numbered.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("__n"))
    ranked = numbered(rows, group, [(score, True), (tie, False)], "__r", hot_rows).join(counts, group)
    r, n = F.col("__r"), F.col("__n")
    third = F.floor(n / 3)
    place: Column = F.when(n < 3, r).when(r < third, r).when(r < 2 * third, r + n - 2 * third).otherwise(r - third)
    return ranked.withColumn("place", place.cast("int")).drop("__r", "__n")
