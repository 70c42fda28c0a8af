"""Package manifests: the module a file declares and what it depends on, in built-in expressions.

A registry maps file names to parsers; a parser takes text and path columns and returns name, public and private.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions import columns as C

Parser = Callable[[Column, Column], tuple[Column, Column, Column]]


def _none() -> Column:
    return F.array().cast("array<string>")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), _none())


def _or_dir(name: Column, path: Column) -> Column:
    """The declared name, else that of the directory."""
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(C.filename(C.directory(path)))


def _section(text: Column, title: str) -> Column:
    """The lines of a [title] section up to the next one."""
    return F.regexp_extract(text, rf"(?ms)^\[{title}\][ \t]*\r?$(.*?)(?=^\[|\z)", 1)


def cargo(text: Column, path: Column) -> tuple[Column, Column, Column]:
    keys = r"(?m)^[ \t]*([\w-]+)[ \t]*="
    return _or_dir(F.regexp_extract(text, r'(?m)^\s*name\s*=\s*"([^"]+)"', 1), path), _all(_section(text, "dependencies"), keys), _all(_section(text, "dev-dependencies"), keys)


def package_json(text: Column, path: Column) -> tuple[Column, Column, Column]:
    keys = lambda k: F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{k}")), _none())
    return _or_dir(F.get_json_object(text, "$.name"), path), keys("dependencies"), keys("devDependencies")


def go_mod(text: Column, path: Column) -> tuple[Column, Column, Column]:
    last = lambda x: C.filename(x)
    blocks = F.array_join(_all(text, r"(?s)require\s*\((.*?)\)"), "\n")
    return _or_dir(last(F.regexp_extract(text, r"(?m)^module\s+(\S+)", 1)), path), F.transform(_all(blocks, r"(?m)^\s*(\S+)\s+v"), last), _none()


def cmake(text: Column, path: Column) -> tuple[Column, Column, Column]:
    """Words of every target_link_libraries after the target; PRIVATE, PUBLIC and INTERFACE switch where they go."""
    name = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)\bproject\s*\(\s*([\w.-]+)", r"(?i)\badd_(?:library|executable)\s*\(\s*([\w.-]+)")))
    calls = _all(text, r"(?is)\btarget_link_libraries\s*\(([^)]*)\)")
    words = F.flatten(F.transform(calls, lambda c: F.concat(F.array(F.lit("PUBLIC")), F.slice(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), 2, 10_000))))
    start = F.struct(F.lit("PUBLIC").alias("to"), _none().alias("public"), _none().alias("private"))
    skip = lambda w: w.startswith("$") | w.startswith("-") | w.isin("debug", "optimized", "general", "LINK_PUBLIC", "LINK_PRIVATE")

    def step(a: Column, w: Column) -> Column:
        bare = F.regexp_extract(w, r"([^:]*)$", 1)
        add = lambda side, on: F.when(on, F.array_append(a[side], bare)).otherwise(a[side]).alias(side)
        switch = w.isin("PUBLIC", "PRIVATE", "INTERFACE")
        counted = ~switch & ~skip(w)
        return F.struct(F.when(switch, w).otherwise(a["to"]).alias("to"), add("public", counted & (a["to"] != "PRIVATE")), add("private", counted & (a["to"] == "PRIVATE")))

    found = F.aggregate(words, start, step)
    return _or_dir(name, path), found["public"], found["private"]


def build_cs(text: Column, path: Column) -> tuple[Column, Column, Column]:
    def names(kind: str) -> Column:
        lists = _all(text, rf"(?s){kind}DependencyModuleNames\.AddRange\s*\(\s*(?:new\s+\w*\s*\[\s*\]\s*)?[{{\[](.*?)[}}\]]")
        return F.concat(_all(F.array_join(lists, ","), r'"([^"]+)"'), _all(text, rf'{kind}DependencyModuleNames\.Add\s*\(\s*"([^"]+)"'))

    return F.regexp_extract(C.filename(path), r"^(.*)\.Build\.cs$", 1), names("Public"), names("Private")


#: Pattern of the file name -> parser; the first that fits counts.
PARSERS: dict[str, Parser] = {r"^Cargo\.toml$": cargo, r"^package\.json$": package_json, r"^go\.mod$": go_mod, r"^CMakeLists\.txt$": cmake, r"\.Build\.cs$": build_cs}


def modules(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(repo, module, path, category, public, private) of files of path, content, category; of equal names the last path counts."""
    rows, name = files, C.filename(F.col("path"))
    parsers = PARSERS if parsers is None else parsers
    found = F.lit(None)
    for pattern, parse in reversed(parsers.items()):
        module, public, private = parse(F.col("content"), F.col("path"))
        found = F.when(name.rlike(pattern), F.struct(module.alias("module"), F.array_distinct(public).alias("public"), F.array_distinct(private).alias("private"))).otherwise(found)
    rows = rows.where(F.concat_ws("", *(F.when(name.rlike(p), "x") for p in parsers)) != "").select("repo", "path", "category", found.alias("m"))
    rows = rows.select("repo", F.col("m.module").alias("module"), F.struct("path", "category", "m.public", "m.private").alias("x"))
    return rows.groupBy("repo", "module").agg(F.max_by("x", F.col("x.path")).alias("x")).select("repo", "module", "x.path", "x.category", "x.public", "x.private")


def edges(table: DataFrame) -> DataFrame:
    """(repo, module, dep, kind), one row per dependency."""
    both = F.concat(
        F.transform("public", lambda x: F.struct(x.alias("dep"), F.lit("public").alias("kind"))),
        F.transform("private", lambda x: F.struct(x.alias("dep"), F.lit("private").alias("kind")))
    )
    return table.select("repo", "module", F.explode(both).alias("e")).select("repo", "module", "e.dep", "e.kind")
