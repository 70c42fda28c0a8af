"""Derived columns of files and lines: functions from Column to Column, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension groups, directory names and weights that decide results.
HINTS = {
    "header": "h hpp hxx", "impl": "cpp cxx cc c", "shader": "usf ush hlsl glsl vert frag comp wgsl",
    "config": "ini cfg conf toml yaml yml json xml", "script": "py rb lua sh bash zsh ps1 psm1 psd1 bat cmd",
    "source": "cs js ts jsx tsx mjs cjs rs go java kt scala swift", "build": "csproj sln cmake make gradle props targets",
    "style": "css scss less sass", "template": "html htm vue svelte", "doc": "md rst txt adoc",
}
FAMILIES = {
    "brace": "h hpp hxx cpp cxx cc c cs java kt scala rs go js ts jsx tsx mjs cjs swift usf ush hlsl glsl vert frag comp wgsl d ps1 psm1 psd1",
    "indent": "py rb", "ini": "ini cfg conf", "structured": "json yaml yml toml xml",
}
DEFINITION_EXTS = ("h", "hpp", "hxx", "d.ts", "pyi")
CONTEXT_NOISE = ("Source", "Private", "Public", "Internal", "Include", "src", "lib", "Classes", "Src")
EMBEDDABLE = tuple(FAMILIES["brace"].split()) + ("py", "rb")
EMBED_SKIP_DIRS = ("thirdparty", "external", "intermediate", "deploy")
EMBED_MAX_BYTES = 512 * 1024
EXT_WEIGHTS = {
    0.30: "h hpp hxx d.ts pyi", 0.20: "cs csproj sln cmake gradle", 0.15: "rs go java kt scala swift ts tsx",
    0.12: "cpp cxx cc c js jsx mjs cjs py rb usf ush hlsl glsl vert frag comp wgsl", 0.05: "ini cfg toml yaml yml json xml", 0.03: "md rst txt adoc",
}
NAME_BONUS = {"MOD": 0.05, "MODULE": 0.1, "INTERFACE": 0.1, "BASE": 0.05, "TYPES": 0.05, "INDEX": 0.05, "LIB": 0.05, "MAIN": 0.1, "API": 0.1, "SCHEMA": 0.05, "MODEL": 0.05}
FENCES = {"rs": "rust", "py": "python", "rb": "ruby", "js": "javascript", "ts": "typescript", "cs": "csharp", "sh": "bash", "yml": "yaml", "h": "cpp", "hpp": "cpp", "md": "markdown"}


def lookup(key: Column, groups: dict, default) -> Column:
    """The group whose blank-separated members hold the key."""
    out = F.lit(default)
    for value, members in groups.items():
        out = F.when(key.isin(members.split()), F.lit(value)).otherwise(out)
    return out


def filename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; '' without a dot (never a part of a directory)."""
    return F.regexp_extract(filename(path), r"\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(filename(path), r"\.[^.]*$", "")


def describe(path: Column) -> Column:
    """Words of the stem, split at case changes, `_` and `-`, with a hint at the kind of file in brackets."""
    words = F.regexp_replace(F.regexp_replace(stem(path), r"(\p{Ll})(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    words = F.trim(F.translate(words, "_-", "  "))
    hint = lookup(extension(path), HINTS, "")
    return F.when(hint == "", words).otherwise(F.concat(words, F.lit(" ("), hint, F.lit(")")))


def category(path: Column, scan_dirs: Column, noise_dirs: Column) -> Column:
    """Directories after the first scan directory that is a prefix, without noise, at most five, joined by ' > '."""
    prefix = F.get(F.filter(F.coalesce(scan_dirs, F.array().cast("array<string>")), lambda d: path.startswith(F.concat(d, F.lit("/")))), F.lit(0))
    rest = F.when(prefix.isNotNull(), F.substr(path, F.length(prefix) + 2)).otherwise(path)
    dirs = F.filter(F.slice(F.split(rest, "/"), 1, F.greatest(F.size(F.split(rest, "/")) - 1, F.lit(0))), lambda p: ~F.array_contains(F.coalesce(noise_dirs, F.array().cast("array<string>")), p))
    return F.when(F.size(dirs) == 0, F.lit("Other")).otherwise(F.array_join(F.slice(dirs, 1, 5), " > "))


def ancestors(cat: Column) -> Column:
    """The category and every category above it."""
    parts = F.split(cat, " > ")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " > "))


def in_module(cat: Column, module: Column) -> Column:
    return (cat == module) | cat.startswith(F.concat(module, F.lit(" > ")))


def fence(ext: Column) -> Column:
    """The word after the opening fence of a code block in Markdown."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in FENCES.items() for x in pair))[ext], ext)


_MASKED = "abcdefghijklmnopqrstuvwxyz0123456789_-./"


def bitmask(text: Column) -> Column:
    """One bit for each letter, digit, `_`, `-`, `.` and `/` that occurs, whatever its case."""
    low = F.lower(text)
    return sum((F.when(F.contains(low, F.lit(c)), F.lit(1 << n)).otherwise(F.lit(0)).cast("long") for n, c in enumerate(_MASKED)), F.lit(0).cast("long"))


def tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 3).cast("long")


def read_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def token_level(n: Column) -> Column:
    return F.when(n > 100_000, "danger").when(n > 50_000, "warn").otherwise("ok")


def byte_label(n: Column) -> Column:
    return F.when(
        n >= 1_048_576, F.concat(F.format_string("%.1f", n / 1_048_576), F.lit("M"))
    ).when(n >= 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit("K"))).otherwise(n.cast("string"))


def cut_line(text: Column, most: int) -> Column:
    """At most `most` bytes in UTF-8, whole characters, with ... where something was cut off."""
    return F.when(F.octet_length(text) > most, F.concat(cut_bytes(text, most), F.lit("..."))).otherwise(text)


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most `most` bytes in UTF-8 that ends with a whole character."""
    ends = [F.substring(text.cast("binary"), 1, most - k).cast("string") for k in range(min(4, most))]
    return F.coalesce(*(F.when(F.is_valid_utf8(e), e) for e in ends), F.lit(""))


def snippet(text: Column) -> Column:
    return F.substring(text, 1, 200)


def path_header(path: Column) -> Column:
    """`// File: name (a > b > c)` with the last three directories that aren't noise."""
    name = filename(path)
    parts = F.filter(F.split(path, "/"), lambda p: (p != name) & ~p.isin(list(CONTEXT_NOISE)))
    last = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3))
    return F.when(F.size(parts) == 0, F.concat(F.lit("// File: "), name)).otherwise(F.concat(F.lit("// File: "), name, F.lit(" ("), F.array_join(last, " > "), F.lit(")")))


def path_error(path: Column) -> Column:
    """Why a requested path is refused; null if it isn't."""
    return F.when(F.coalesce(path, F.lit("")) == "", "empty").when(F.contains(path, F.lit("..")), "parent").when(path.startswith("/"), "absolute")


def manifest_line(path: Column, desc: Column) -> Column:
    return F.concat(F.lit("// "), path, F.lit(" — "), desc, F.lit("\n"))


def color_slot(text: Column, slots: int = 8) -> Column:
    """32-bit polynomial hash of the characters (factor 31), folded into a palette."""
    wrap = lambda v: F.pmod(v + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + F.ascii(c)))
    return F.pmod(F.abs(h), F.lit(slots)).cast("int")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, and an empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def importance(path: Column, size: Column) -> Column:
    """Small standing weight of a file, by extension, words in its name, and size."""
    name = F.upper(stem(path))
    bonus = sum((F.when(F.contains(name, F.lit(k)), F.lit(v)).otherwise(F.lit(0.0)) for k, v in NAME_BONUS.items()), F.lit(0.0))
    by_size = F.when(size < 5_000, 0.05).when(size < 20_000, 0.02).otherwise(0.0)
    return lookup(extension(path), EXT_WEIGHTS, 0.08) + F.least(F.lit(0.2), bonus) + by_size


def query_importance(path: Column, text: Column, terms: list[str]) -> Column:
    """10 for each term in the path and 3 for each in the first 4000 characters."""
    low, head = F.lower(path), F.lower(F.substring(text, 1, 4000))
    parts = [F.when(F.contains(low, F.lit(t)), 10.0).otherwise(0.0) + F.when(F.contains(head, F.lit(t)), 3.0).otherwise(0.0) for t in terms]
    return sum(parts, F.lit(0.0))


def embeddable(path: Column, size: Column) -> Column:
    folded = F.concat(F.lit("/"), F.lower(path))
    skipped = folded.rlike("/(" + "|".join(EMBED_SKIP_DIRS) + ")/")
    return extension(path).isin(list(EMBEDDABLE)) & ~skipped & (size <= EMBED_MAX_BYTES)


def display_path(repo: Column, path: Column, several: Column) -> Column:
    """The path, after the repository's name in brackets where files of several are shown."""
    return F.when(several, F.format_string("[%s] %s", repo, path)).otherwise(path)
