"""Problem 4: source files that nobody wrote by hand: generated, minified, copied from outside, or data kept as code.

Copies are found by an inverted index over hashes of lines. A file that lies to COPIED in an owner shares with it one of
the lines that are rarest among owners, so only these are looked up; published files are all looked up so. Of our own
files each line names the oldest that has it, and a file is held against those that its lines name; so of a group of
copies, however large, mostly links to the owner arise. Only files that no such owner holds, though most of their lines
are known, are held against all that share one of their rarest lines. What isn't a copy is judged by its head, its path
and the composition of its tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.session import distinct_rows, durable, join_counted, small_side

#: Lines count from this length (after inner blanks are made single).
LINE_CHARS = 12
#: Files need as many different lines to be judged as copies.
MIN_LINES = 5
#: Share of a file's lines that must name one owner for a look, and that must be in the owner.
LOOK, COPIED = 0.3, 0.7
#: Rows of a key from which it is spread, and at least 1/2000 of all.
HOT_FROM = 10_000


def line_hashes(text: Column) -> Column:
    """The different lines of a text as hashes, without indentation, doubled blanks and short lines."""
    lines = F.transform(F.split(F.regexp_replace(text, r"[^\S\n]+", " "), "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= LINE_CHARS), lambda x: F.xxhash64(x)))


def line_index(files: DataFrame, published: DataFrame) -> DataFrame:
    """(id, repo, n, whole, lines): one row per file with its line hashes; ids of published files are below 0, whole is a hash of all lines.

    files: file_id, repo, rel_path, content. published: lib, rel_path, content. A file that occurs twice counts once.
    """
    own = distinct_rows(files.select("file_id", "repo", "content"), "file_id").where("content is not null")
    own = own.select(F.col("file_id").cast("long").alias("id"), F.hash(F.coalesce("repo", F.lit(""))).alias("repo"), line_hashes(F.col("content")).alias("lines"))
    key = F.xxhash64("lib", "rel_path", "content").bitwiseOR(F.lit(-(1 << 63)))
    theirs = published.where("content is not null").select(
        key.alias("id"), F.hash(F.lit("published"), "lib").alias("repo"), line_hashes(F.col("content")).alias("lines")
    ).dropDuplicates(["id"])
    return own.unionByName(theirs).where(F.size("lines") >= MIN_LINES).select("id", "repo", F.size("lines").alias("n"), F.xxhash64(F.array_sort("lines")).alias("whole"), "lines")


def _by_line(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select(*columns, F.explode("lines").alias("h"))


def _hot_from(rows: DataFrame) -> int:
    return max(HOT_FROM, rows.count() // 2000)


def _known(files: DataFrame, owned: DataFrame, hot_from: int) -> DataFrame:
    """(id, n, repo, h, and what owned has of the line) for the lines of files that are in owned (h, files, ...), kept.

    files is the number of those files that have the line: of hot lines there are few, and they are broadcast.
    """
    rows = _by_line(files, "id", "n", "repo")
    if owned.limit(100_001).count() <= 100_000:
        return durable(rows.join(F.broadcast(owned), "h"))
    return durable(join_counted(rows, owned.withColumn("held", F.col("files")), ["h"], "files", "id", hot_from).where("held is not null").withColumnRenamed("held", "files"))


def _rarest(known: DataFrame, k: DataFrame) -> DataFrame:
    """Of each file of k (id, k known lines) the lines of which an owner that holds COPIED of it must have one: the rarest.

    An owner lacks n - ceil(COPIED n) lines at most, so it has one of that many and one more, to which all lines belong
    that nobody else has.
    """
    rows = known.join(k.select("id", "k"), "id")
    spare = F.col("n") - F.ceil(COPIED * F.col("n") - 1e-9) + 1 - (F.col("n") - F.col("k"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("files", "h"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= spare).select("h", "id", "n", F.col("repo").alias("own_repo"))


def _mostly_known(known: DataFrame) -> DataFrame:
    return known.groupBy("id", "n").agg(F.count("*").alias("k")).where(F.col("k") >= COPIED * F.col("n"))


def _contained(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Of the pairs (id, n, own_repo, owner) those with COPIED of the lines in the owner, with owner_repo and containment."""
    pairs = durable(pairs.distinct())
    mine = index.select("id", "lines").join(small_side(pairs), "id")
    owners = pairs.groupBy("owner").agg(F.count("*").alias("lookers"))
    have = index.select(F.col("id").alias("owner"), F.col("repo").alias("owner_repo"), F.col("lines").alias("there")).join(small_side(owners), "owner")
    both = join_counted(mine, have, ["owner"], "lookers", "id", _hot_from(pairs))
    held = both.select("id", "n", "own_repo", "owner", "owner_repo", (F.size(F.array_intersect("lines", "there")) / F.col("n")).alias("containment"))
    return durable(held.where(F.col("containment") >= COPIED))


def _foreign(contained: DataFrame) -> DataFrame:
    """(owner, members) of the groups that lie in more than one repository."""
    groups = contained.groupBy("owner").agg(F.min("own_repo").alias("a"), F.max("own_repo").alias("b"), F.min("owner_repo").alias("c"), F.count("*").alias("members"))
    return groups.where((F.col("a") != F.col("b")) | (F.col("a") != F.col("c"))).select("owner", "members")


def _largest(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("id").agg(F.max(F.struct("containment", (-F.col("owner")).alias("minus"))).alias("m"))
    return best.select("id", (-F.col("m.minus")).alias("owner"), F.col("m.containment").alias("containment"))


def copies(index: DataFrame) -> DataFrame:
    """(id, owner, containment) of the files that were copied: from a published file or between repositories.

    The owner itself is among them if it is a file of ours, as which of two equal files was first can't be told from
    them; containment is the share of the file's lines in the owner, the largest where several hold it. Every published
    file counts as an owner. Files that none of them holds are compared with those of our files that own LOOK of their
    lines, and what is left with all that share one of its rarest lines.
    """
    index = durable(index)
    own, published = index.where("id >= 0"), index.where("id < 0")
    hot_lines = max(HOT_FROM, (index.agg(F.sum("n")).first()[0] or 0) // 2000)
    offered = durable(_by_line(published, F.col("id").alias("owner")))
    known = _known(own, offered.groupBy("h").agg(F.count("*").alias("files")), hot_lines)
    asked = _rarest(known, _mostly_known(known))
    direct = durable(_largest(_contained(asked.join(small_side(offered), "h").select("id", "n", "own_repo", "owner"), index)))

    # Files of one repository with the same lines are one: the smallest id stands for them.
    stands = own.groupBy("repo", "whole").agg(F.min("id").alias("one"), F.count("*").alias("members"))
    same = durable(join_counted(own.select("id", "repo", "whole"), stands, ["repo", "whole"], "members", "id", _hot_from(own)).select("id", "one"))
    own = own.join(small_side(same.where("id <> one").select("id")), "id", "left_anti")
    lines = durable(_by_line(own, "id").groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("files")).where("files > 1"))
    known = _known(own, lines, hot_lines)
    able = durable(_mostly_known(known).join(direct.select("id"), "id", "left_anti"))
    votes = known.where("first <> id").join(small_side(able.select("id")), "id", "left_semi").groupBy(
        "id", "n", F.col("repo").alias("own_repo"), F.col("first").alias("owner")
    ).agg(F.count("*").alias("votes"))
    contained = _contained(votes.where(F.col("votes") >= LOOK * F.col("n")).drop("votes"), index)
    foreign = _foreign(contained)
    settled = contained.join(foreign, "owner", "left_semi").select("id").union(foreign.select(F.col("owner").alias("id"))).distinct()
    rarest = _rarest(known, able.join(settled, "id", "left_anti"))
    others = small_side(durable(rarest)).join(_by_line(own, F.col("id").alias("owner")), "h").where("owner <> id")
    contained = contained.unionByName(_contained(others.select("id", "n", "own_repo", "owner"), index)).distinct()
    hot_from = _hot_from(contained)
    foreign = _foreign(contained).withColumn("foreign", F.lit(True))
    members = join_counted(contained.select("id", "owner", "containment"), foreign, ["owner"], "members", "id", hot_from).where("foreign")
    members = durable(_largest(members).unionByName(direct))
    originals = foreign.select(F.col("owner").alias("id"), "owner", F.lit(1.0).alias("containment")).join(members, "id", "left_anti")
    found = members.unionByName(originals)
    each = same.groupBy("one").agg(F.count("*").alias("members"))
    found = found.join(each, found["id"] == each["one"]).select("one", "owner", "containment", "members")  # direct ones find themselves below
    return join_counted(same, found, ["one"], "members", "id", hot_from).where("owner is not null").select("id", "owner", "containment")


# --- files by themselves ----------------------------------------------------------------------------------------------

#: What people write and keep; rules of composition leave it alone.
KEPT = frozenset("yaml yml ini env toml conf cfg cnf properties json xml md rst txt sh bash gradle tf tfvars editorconfig".split())
_VENDOR_DIRS = frozenset("node_modules third_party thirdparty third-party vendor vendors vendored external externals extern contrib bower_components site-packages".split())
_MADE_NAMES = re.compile(r"(?:\.min\.(?:js|css|mjs)|\.bundle\.js|\.(?:pb|g|generated|designer)\.\w+|_pb2(?:_grpc)?\.py|\.pb\.go|-lock\.(?:json|yaml)|\.lock|go\.sum)$", re.I)
#: Banners by which tools mark what they write, as their makers document them; whole head comments are searched.
_MADE = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b|\bautomatically generated\b|\bcode generated\b|^\W*generated (?:by|from|with|automatically|on)\b|\b(?:file|code|source|content|this)\b[^\n]{0,30}\bgenerated (?:automatically )?(?:by|from|with)\b"
    r"|\bmachine[ -](?:made|generated|written)\b|^\W*generator: *\w|\bgenerated (?:file|code|source)\b|^\W*do not (?:edit|modify|touch)\W*$|[.,;:!-]\s*do not (?:edit|modify|touch)\W*$|\bmanual (?:changes|edits)\b[^\n]{0,20}\b(?:lost|overwritten)"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|erstellt|generiert)\b|\bänderungen gehen verloren\b|\bnicht (?:bearbeiten|ändern|editieren)\W*$|\b(?:generado|generada) (?:automáticamente|por)\b|[,;.]\s*no (?:tocar|modificar|editar)\W*$"
    r"|\bgénérée? (?:automatiquement|par)\b|[,;.]\s*ne pas (?:modifier|éditer|toucher)\W*$",
    re.I | re.M,
)
#: Verbs that people use too: they tell a tool only where what follows is named like one (a version, a dash or an underscore
#: in its name, a word for a tool) or says that it was automatic.
_PRODUCED = re.compile(r"\b(?:created|produced|emitted|written|made|built|creado|producido|produit|créé|erzeugt|erstellt) (?:automatically|automatiquement|automáticamente|automatisch)?\s*(?:by|from|with|por|par|von|mit) ((?:the |el |le |dem )?[^\n]{1,60})", re.I)
_TOOL = re.compile(r"^(?:the )?[\w.]*(?:[a-z][-_][a-z]|\d)[\w.-]*|^\S+\s+v?\d+(?:\.\d+)+|\b(?:generator|compiler|codegen|tool|script|builder|bundler|exporter|converter|protoc|gen)\b", re.I)
_NOT_MADE = re.compile(r"\b(?:not|never|nicht|no es|n'est pas) (?:a )?(?:auto-?)?generated\b|\bgenerated (?:part|id|key|name|value|token|password|hash)\b|hand-?written|written by hand", re.I)
#: How published code names its source: a name, its version and a licence on one line, or words of vendoring.
_FOREIGN = re.compile(
    r"^\W*[\w.@/-]+ v?\d+\.\d+(?:\.\d+)*(?:[-+]\w+)? (?:by the \w+ authors|[-|(,][^\n]*\b(?:licen[cs]e[ds]?|copying|copyright|terms|rights|permission|public domain|free (?:for|to|software))\b)"
    r"|\bvendored (?:from|copy)\b|\bcopied (?:verbatim )?from (?:https?:|upstream)|\bthird[- ]party (?:code|source|library)\b",
    re.I | re.M,
)


def _marked(head: str) -> bool:
    """Whether the comments at the head say that a tool made the file."""
    if _NOT_MADE.search(head):
        return False
    return bool(_MADE.search(head)) or any(_TOOL.search(m[1].strip()) for m in _PRODUCED.finditer(head))


_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|pragma|!)|/\*|\*|--|<!--|;|%|\"\"\"|'''|/\*!)")
_WORD = re.compile(r"\w+")
_LITERAL = re.compile(r"([\"'`])([^\"'`\s]{48,})\1")
_TOKENS = re.compile(r"[A-Za-z_]\w*|[-+]?(?:0x[0-9a-fA-F]+|\d[\d.]*(?:[eE][-+]?\d+)?)")
_HEAD_LINES = 12
#: How comments over several lines open and close; all lines of the plain ones are comments.
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))
_PLAIN_BLOCKS = ("*/", "-->")


def _head(text: str) -> str:
    """The comments before the first line of code, however many, and those among the first lines."""
    head, close, at, n = [], None, 0, 0
    leading = True
    while at < len(text) and (leading or n < _HEAD_LINES and at < 4000):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].rstrip("\r") if leading else text[at : min(end, 4000)].rstrip("\r")
        opened = next((c for o, c in _BLOCKS if line.lstrip().startswith(o)), None) if leading and not close else None
        if _COMMENT.match(line) or leading and close in _PLAIN_BLOCKS:
            head.append(line)
        elif leading and not close and line.strip() and not (n == 0 and line.startswith(("#!", "<?"))):
            leading = False
        if close and close in line or opened and opened in line.lstrip()[len(opened) :]:
            close = None
        elif opened:
            close = opened
        at, n = end + 1, n + 1
    return "\n".join(head)


def _template(line: str) -> str:
    """A line without its names and numbers."""
    return re.sub(r"[A-Za-z_]\w*", "w", re.sub(r"(?<![A-Za-z_])[-+]?\d[\w.]*", "9", re.sub(r"([\"'`])[^\"'`]*\1", "s", line.strip())))


def made_by_tool(path: str | None, text: str | None, skip_dirs: frozenset[str] = frozenset()) -> str | None:
    """Why a file isn't written by hand, judged by itself: marker, foreign, path, minified, data or pattern; else None.

    skip_dirs: directory names (lower case) that its repository leaves out of scans. A null or empty text is judged by
    its path alone.
    """
    path = (path or "").replace("\\", "/")
    *dirs, name = path.lower().split("/")
    ext = name.rsplit(".", 1)[1] if "." in name else ""
    text = text or ""
    head = _head(text)
    if _marked(head):
        return "marker"
    if _FOREIGN.search(head):
        return "foreign"
    if _MADE_NAMES.search(name) or any(d in _VENDOR_DIRS or d in skip_dirs for d in dirs):
        return "path"
    lines = [x for x in text.splitlines() if x.strip()]
    size = sum(map(len, lines))
    if ext in KEPT or size < 200:
        return None
    literals = sum(len(m[2]) for m in _LITERAL.finditer(text) if not m[2].startswith("-----BEGIN"))
    if literals >= 0.7 * size:
        return "data"
    tokens = _TOKENS.findall(text)
    numbers = sum(not (t[0].isalpha() or t[0] == "_") for t in tokens)
    if numbers >= 40 and numbers >= 0.6 * len(tokens):
        return "data"
    code = [x for x in lines if not _COMMENT.match(x)]
    if len(code) >= 10:
        shape, n = Counter(map(_template, code)).most_common(1)[0]
        if n >= 0.75 * len(code) and len(shape) > 6 and len(_WORD.findall(shape)) >= 2:
            return "data" if shape.upper().startswith("W W W W (") or ext in {"sql", "csv"} else "pattern"
    long = sum(len(x) for x in lines if len(x) > 250)
    if long >= 0.85 * size or size / len(lines) > 200:
        return "minified"
    return None


def judge_files(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(file_id, reason) for the files that are judged by themselves; see made_by_tool. A row that occurs twice is judged twice."""
    skip = small_side(configs.where("repo is not null").groupBy("repo").agg(F.flatten(F.collect_set(F.coalesce("skip_dirs", F.array().cast("array<string>")))).alias("skip")))
    rows = files.where("file_id is not null").select("file_id", "repo", "rel_path", "content").join(skip, "repo", "left").select("file_id", "rel_path", "content", "skip")
    kind = files.schema["file_id"].dataType.simpleString()

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            skips = [frozenset(str(x).lower() for x in s) if s is not None else frozenset() for s in frame["skip"]]
            frame["reason"] = [made_by_tool(p, t, s) for p, t, s in zip(frame["rel_path"], frame["content"], skips)]
            yield frame.loc[frame["reason"].notna(), ["file_id", "reason"]]

    return rows.mapInPandas(judge, f"file_id {kind}, reason string")


def not_handwritten(files: DataFrame, published: DataFrame, configs: DataFrame) -> DataFrame:
    """(file_id, reasons): every file that isn't written by hand for its project, with why ('copied' for copies)."""
    copied = copies(line_index(files, published)).select(F.col("id").alias("file_id"), F.lit("copied").alias("reason"))
    both = judge_files(files, configs).unionByName(copied)
    return both.groupBy("file_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
