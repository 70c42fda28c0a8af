"""Commands over a corpus: search, grep, read, modules, imports, history, status; every answer is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.functions import encoder
from codeseam.operators import budget, fuzzy, graph, history, incremental, ranking, stats, stubs
from codeseam.operators import grep as G
from codeseam.session import durable, numbered
from codeseam.sources import manifests, walk

#: Older names of commands, and what they stand for with the arguments they imply.
ALIASES: dict[str, tuple[str, dict]] = {
    "find": ("search", {}), "semantic": ("search", {}), "list_modules": ("modules", {"action": "list"}), "module_files": (
        "modules", {"action": "files"}
    ), "deps": ("modules", {"action": "deps"}),
    "impact": (
        "imports", {"transitive": True}
    ), "read_file": ("read", {}), "read_files": ("read", {}), "context": ("read_budget", {}), "blame": ("git", {"action": "blame"}), "file_history": ("git", {"action": "history"}),
    "changed": ("git", {"action": "changed"}), "hotspots": ("git", {"action": "hotspots"}), "session": ("status", {}), "list_repos": ("status", {}),
}
READ_MOST = 50
LIMITS = {"search": (30, 100), "grep": (50, 200), "history": (10, 100), "hotspots": (20, 200), "imports": (50, 500)}


def bounded(command: str, limit: int | None) -> int:
    """The limit asked for, or the default, within the most that the command gives."""
    usual, most = LIMITS[command]
    return min(most, usual if limit is None else limit)


@dataclass(frozen=True)
class Corpus:
    """Tables of one or more repositories. deps: module, dep, kind; deps_modules: module, module_category.

    files: repo, file_id, path, filename, ext, size, mtime, content, category. commits and commit_files: see history;
    blame: lines with authors; chunks: file_path, start_line, embedding of the encoder; reads: reads of sessions.
    """

    files: DataFrame
    commits: DataFrame | None = None
    commit_files: DataFrame | None = None
    blame: DataFrame | None = None
    chunks: DataFrame | None = None
    reads: DataFrame | None = None
    encoder_name: str = "hash-384"
    deps: DataFrame | None = None
    deps_modules: DataFrame | None = None

    def repo(self, name: str | None) -> Corpus:
        """The corpus of one repository; all of it for None. Raises ValueError for one that isn't there."""
        if name is None:
            return self
        mine = self.files.where(F.col("repo") == name)
        if mine.isEmpty():
            raise ValueError(f"no repository {name!r}")
        of = lambda rows: rows.where(F.col("repo") == name) if rows is not None and "repo" in rows.columns else rows
        return replace(self, files=mine, blame=of(self.blame), chunks=of(self.chunks))

    def _filtered(self, ext: str | None, path: str | None, category: str | None) -> DataFrame:
        rows = self.files
        if ext:
            rows = rows.where(F.col("ext").isin([e.strip().lstrip(".") for e in ext.split(",")]))
        if path:
            rows = rows.where(F.col("path").startswith(path))
        return rows.where(F.col("category").startswith(category)) if category else rows

    def grep(
        self, query: str, match_mode: str = "all", ext: str | None = None, path: str | None = None, category: str | None = None,
        limit: int | None = None, output: str = "files", per_file: int = 8, snippets: bool = False
    ) -> DataFrame:
        """Matching files by relevance (output 'files'), or their first per_file matching lines ('lines'), or counts ('count')."""
        rows = self._filtered(ext, path, category)
        if output == "lines":
            best = G.grep(rows, query, match_mode, bounded("grep", limit)).select("repo", "path", "score")
            return G.first_matches(rows, query, match_mode, per_file).join(F.broadcast(best), ["repo", "path"]).orderBy(F.desc("score"), "repo", "path", "line_no")
        if output == "count":
            return G.match_totals(rows, query, match_mode, bounded("grep", limit))
        if output != "files":
            raise ValueError(f"output {output}")
        return G.grep(rows, query, match_mode, bounded("grep", limit), snippets)

    def grep_lines(self, query: str, match_mode: str = "all", context: int = 2, **filters: str | None) -> DataFrame:
        rows = self._filtered(filters.get("ext"), filters.get("path"), filters.get("category"))
        return G.context_lines(rows, query, match_mode, min(10, context))

    def search(self, query: str, match_mode: str = "all", ext: str | None = None, path: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
        """(repo, path, score, source): names and content by hybrid score, fused with vectors if there are chunks."""
        rows, most = self._filtered(ext, path, category), bounded("search", limit)
        words = " ".join(w.rsplit(".", 1)[0] if w.rsplit(".", 1)[0] and w.rsplit(".", 1)[-1] in " ".join(C.HINTS.values()).split() else w for w in query.split())
        names = fuzzy.search_files(rows, words, 10 * most)
        found = ranking.find(names, G.grep(rows, query, match_mode, 10 * most), len(query.split()), most)
        if self.chunks is None:
            return found.select("repo", "path", F.col("combined").alias("score"), F.col("match").alias("source"))
        asked = self.files.sparkSession.range(1).select(encoder.encode(F.lit(query), self.encoder_name).alias("query"))
        # Files are told apart by repository and path; chunks without a repository belong to every file of their path.
        named = self.chunks if "repo" in self.chunks.columns else self.chunks.join(self.files.select("repo", F.col("path").alias("file_path")), "file_path")
        key = F.concat_ws("\x00", "repo", "path").alias("key")
        near = ranking.rerank(named.withColumn("file_path", F.concat_ws("\x00", "repo", "file_path")), asked, query.split(), most).select(F.col("file_path").alias("key"), "score")
        found = found.select("*", key)
        fused = ranking.reciprocal_ranks([found.select("key", F.col("combined").alias("score")), near], "key", "score", most)
        both = fused.join(found.select("key", "match"), "key", "left").join(near.select("key", F.lit(True).alias("vector")), "key", "left")
        both = both.select("*", F.split("key", "\x00")[0].alias("repo"), F.split("key", "\x00")[1].alias("path"))
        source = F.when(F.col("match").isNotNull() & F.col("vector").isNotNull(), "both").when(F.col("vector").isNotNull(), "semantic").otherwise(F.col("match"))
        return both.select("repo", "path", F.col("fused").alias("score"), source.alias("source")).orderBy(F.desc("score"), "repo", "path")

    def search_modules(self, query: str, limit: int = 5) -> DataFrame:
        return fuzzy.search_modules(stats.modules(self.files), query, min(50, limit))

    def read(self, paths: list[str], mode: str = "full", start: int | None = None, end: int | None = None) -> DataFrame:
        """(repo, path, content, lines, size, error) for each path asked for, of every repository that has it; a range of lines is numbered.

        A path that leaves its root, isn't found, or is beyond the first READ_MOST has a row with an error.
        """
        if start is not None and end is not None and start > end:
            raise ValueError("start is after end")
        unique = list(dict.fromkeys(paths))
        asked = self.files.sparkSession.createDataFrame([(p, n >= READ_MOST) for n, p in enumerate(unique)], "path string, beyond boolean")
        asked = asked.select("path", F.coalesce(C.path_error(F.col("path")), F.when(F.col("beyond"), f"more than {READ_MOST} paths")).alias("bad"))
        wanted = F.col("path").isin([p for p in unique[:READ_MOST]])
        rows = self.files.where(wanted).select("repo", "path", "content", "ext", "size").dropDuplicates(["repo", "path"])
        lines = C.lines(F.col("content"))
        body: Column = F.col("content") if mode == "full" else stubs.stub_column(F.col("content"), F.col("ext"))
        if start is not None or end is not None:
            first = F.greatest(F.lit(1), F.least(F.lit(start or 1), F.size(lines)))
            last = F.least(F.lit(end or 2**31 - 1), F.size(lines))
            numbered = F.transform(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), lambda x, i: F.concat(F.lpad((i + first).cast("string"), 5, " "), F.lit(" | "), x))
            body = F.array_join(numbered, "\n")
        found = rows.select("repo", "path", body.alias("content"), F.size(lines).alias("lines"), "size")
        out = asked.where("bad is null").join(found, "path", "left").unionByName(asked.where("bad is not null"), allowMissingColumns=True)
        return out.select("repo", "path", "content", "lines", "size", F.coalesce("bad", F.when(F.col("lines").isNull(), "not found")).alias("error"))

    def read_budget(self, paths: list[str], tokens: int = 50_000, query: str = "", seen: list[str] | None = None, ordering: str = "importance") -> DataFrame:
        """(path, tier, tokens, importance, place, content, error) of the paths, as much of each as the budget allows.

        Where several repositories are asked, path has the repository in front. With dependencies, files one step from the
        module of a file that matches well count more. A path that isn't found has a row with an error.
        """
        terms = [t for t in query.lower().split() if len(t) >= 2]
        several = self.files.select("repo").distinct().limit(2).count() > 1
        rows = self.files.where(F.col("path").isin(paths)).dropDuplicates(["repo", "path"])
        score = C.importance(F.col("path"), F.octet_length("content")) + C.query_importance(F.col("path"), F.col("content"), terms)
        rows = rows.withColumn("importance", score)
        if self.deps is not None:
            rows = budget.connected_bonus(rows, self.deps, self.deps_modules)
        rows = rows.withColumn("importance", budget.seen_penalty(F.col("importance"), F.col("path").isin(seen or [])))
        shown = F.concat_ws("/", "repo", "path") if several else F.col("path")
        asked = rows.select(shown.alias("path"), "ext", "content", C.describe(F.col("path")).alias("desc"), "importance", F.lit(1).alias("request_id"))
        packed = durable(budget.answer(asked, tokens, query)).withColumn("request_id", F.lit(1))
        texts = graph.attention_order(packed, "request_id", "importance", "path") if ordering == "attention" else numbered(
            packed, "request_id", [("importance", True), ("path", False)], "place"
        )
        missing = self.files.sparkSession.createDataFrame(
            [(p,) for p in dict.fromkeys(paths)], "path string"
        ).join(rows.select("path"), "path", "left_anti").select("path", F.lit("not found").alias("error"))
        columns = ["path", "tier", "tokens", "importance", "place", "content"]
        return texts.select(*columns, F.lit(None).cast("string").alias("error")).unionByName(missing, allowMissingColumns=True).orderBy(F.col("place").asc_nulls_last(), "path")

    def budget_map(self, answer: DataFrame) -> DataFrame:
        """The map row of an answer of read_budget: one text with a line for each file that was given less than whole."""
        lines = answer.where("tier > 1").select("place", F.concat(F.lit("- "), "path", F.lit(" (tier "), F.col("tier").cast("string"), F.lit(")")).alias("line"))
        return lines.agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "line")))["line"], "\n").alias("content"), F.count("*").alias("files"))

    def modules(self, action: str = "list", module: str = "", limit: int = 1000) -> DataFrame:
        if action == "list":
            found = stats.modules(self.files).where(F.col("id").startswith(module))
            return found.orderBy("id").limit(limit).crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row
        if action == "files":
            return self.files.where(C.in_module(F.col("category"), F.lit(module))).select("repo", "path", "category")
        if action == "deps":
            return manifests.edges(manifests.modules(self.files)).where((F.col("module") == module) | (F.col("dep") == module))
        raise ValueError(f"action {action}")

    def import_edges(self) -> DataFrame:
        """(src, dst, away) of imports, at home, by namespace or in another repository, with the repository in front of the path."""
        return graph.all_edges(self.files)

    def imports(self, path: str, transitive: bool = False, max_depth: int = 5, limit: int | None = None, direction: str = "both") -> DataFrame:
        """Neighbours of a file ('imports', 'imported_by' or 'both'), or all that depends on it at its least depth."""
        if direction not in ("both", "imports", "imported_by"):
            raise ValueError(f"direction {direction}")
        edges = self.import_edges()
        if not transitive:
            near = graph.neighbours(edges, path)
            return near if direction == "both" else near.where(F.col("direction") == direction)
        return graph.impact(edges, [path], min(20, max_depth)).orderBy("depth", "node").limit(bounded("imports", limit))

    def git(self, action: str, path: str = "", since: str = "", days: int = 90, repo: str = "", limit: int | None = None) -> DataFrame:
        """History by action; a path that leaves its root, or a blamed file that isn't there, raises ValueError."""
        if action in ("blame", "history") and walk.path_is_bad(path):
            raise ValueError("Invalid path")
        if action == "blame":
            rows = history.blame(self.blame, repo).where(F.col("path") == path)
            if rows.isEmpty():
                raise ValueError(f"no blame of {path!r}")
            return rows.orderBy("line_no")
        if action == "history":
            return history.file_history(self.commits, self.commit_files, path, bounded("history", limit))
        if action == "changed":
            return history.by_status(history.changed_since(self.commits, self.commit_files, since))
        if action == "hotspots":
            return history.hot_files(self.commits, self.commit_files, since, min(365, days), bounded("hotspots", limit))
        raise ValueError(f"action {action}")

    def status(self) -> DataFrame:
        return stats.status(self.files)

    def sessions(self) -> DataFrame:
        return incremental.session_summary(self.reads)

    def call(self, command: str, **arguments: object) -> DataFrame:
        """A command by name, also by an older one."""
        name, implied = ALIASES.get(command, (command, {}))
        if name.startswith("_") or not callable(getattr(self, name, None)):
            raise ValueError(f"no command {command}")
        return getattr(self, name)(**implied, **arguments)
