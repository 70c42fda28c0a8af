"""Structural summaries of source files: what is declared, without the bodies; and their division into blocks and chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions import columns as C

BODY = " { /* ... */ }"
MAX_LINES, MAX_ENTRIES, CHUNK_BYTES = 100, 5, 40

# Words that open a scope of declarations, and words of functions.
_TYPE_WORDS = "class struct namespace enum interface trait impl union module package object extern"
_FUNCTION_WORDS = "fn func fun function"
#: How annotations and macros stand before what they are about (fixed values).
_ANNOTATION = re.compile(r"@[A-Z]|#\[|\[[A-Z]|//go:|[A-Z][A-Z_]{2,}\(")

_GROUP = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_ADORNMENT = re.compile(rf"\s*(?:@[\w.]+(?:\s*{_GROUP})?|[A-Z][A-Z_]{{2,}}\s*{_GROUP}|#!?\[[^\]]*\]|\[\[?[A-Z][^\]]*\]\]?|template\s*<(?:[^<>]|<[^<>]*>)*>|(?:public|private|protected|signals|slots)\s*:(?!:))")
_TYPE_HEAD = re.compile(rf"(?<![\w.])(?:{_TYPE_WORDS.replace(' ', '|')})(?![\w.])")
_FUNCTION_HEAD = re.compile(rf"(?<![\w.])(?:{_FUNCTION_WORDS.replace(' ', '|')})(?!\w)")
_VALUE_OF_TYPE = re.compile(r"(?:struct|enum|union)\s+\w+[\s*&]+\w+\s*$")
#: What the scan of a brace language looks at; texts between quotes and comments hold no braces.
_SCAN = {
    "'": re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>^[ \t]*#(?:[^\n\\]|\\.)*)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?P<mark>[{};])", re.S | re.M),
    "": re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>^[ \t]*#(?:[^\n\\]|\\.)*)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]{1,8}?|[^'\\\n])'|`[^`]*`|(?P<mark>[{};])", re.S | re.M),
}
#: Languages in which a text may stand between single quotes.
_QUOTED = frozenset("js jsx ts tsx mjs cjs php dart groovy vue svelte".split())


def _lines(text: str) -> list[str]:
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


class Scope(NamedTuple):
    """A pair of braces: [start, end) with both, nesting depth (0 outermost), where its head begins, whether it declares."""

    start: int
    end: int
    depth: int
    head: int
    declares: bool


def declares(head: str) -> bool:
    """Whether braces after this head hold declarations or values (a type, a namespace, a literal) and no code."""
    while m := _ADORNMENT.match(head):
        head = head[m.end() :]
    before = head.split("(", 1)[0]
    function = _FUNCTION_HEAD.search(before)
    if (m := _TYPE_HEAD.search(before)) and not (function and function.start() < m.start()):
        return "(" not in head or not _VALUE_OF_TYPE.search(before)
    if function or head.rstrip().endswith(("=>", "->")):
        return False
    opened = head.count("(") - head.count(")")
    inside = head.rsplit("(", 1)[-1]
    return "(" not in head or opened > 0 and ")" not in inside and not _FUNCTION_HEAD.search(inside)


def scopes(text: str, quoted: bool = False) -> tuple[list[Scope], list[tuple[int, int]]]:
    """All scopes of a text in a brace language, in the order in which they open, and its comments, in one pass.

    quoted: texts may stand between single quotes. A scope that isn't closed ends with the text.
    """
    found: list[list] = []
    open_scopes: list[int] = []
    comments = []
    head = 0
    for m in _SCAN["'" if quoted else ""].finditer(text):
        if m["comment"] is not None:
            comments.append(m.span())
            if not text[head : m.start()].strip():
                head = m.end()
        elif m["directive"] is not None:
            if not m["directive"].lstrip().startswith("#["):
                head = m.end()
        elif m["mark"] == "{":
            line = text.rfind("\n\n", head, m.start())
            head = line + 2 if line >= 0 and text[line:m.start()].strip() else head
            found.append([m.start(), len(text), len(open_scopes), head, declares(_without(text, head, m.start(), comments))])
            open_scopes.append(len(found) - 1)
            head = m.end()
        elif m["mark"] == "}":
            if open_scopes:
                found[open_scopes.pop()][1] = m.end()
            head = m.end()
        elif m["mark"] == ";":
            head = m.end()
    return [Scope(*x) for x in found], comments


def _without(text: str, start: int, end: int, comments: list[tuple[int, int]]) -> str:
    """text[start:end] without its comments; comments are in order, and those of the head are the last ones."""
    parts, at = [], end
    for a, b in reversed(comments):
        if a < start:
            break
        parts.append(text[b:at])
        at = a
    parts.append(text[start:at])
    return "".join(reversed(parts))


def _braced(text: str, ext: str = "") -> str:
    """The text without bodies and without comments over several lines that document nothing."""
    text = "".join(x + "\n" for x in _lines(text))
    found, comments = scopes(text, ext in _QUOTED)
    cuts = [(s.start, s.end, BODY if s.start and not text[s.start - 1].isspace() else BODY.lstrip()) for s in found if not s.declares]
    cuts += [(a, b, "") for a, b in comments if "\n" in text[a:b] and not text.startswith(("/**", "/*!"), a)]
    parts, at = [], 0
    for start, end, instead in sorted(cuts):
        if start >= at:
            parts += [text[at:start], instead]
            at = end
    out = "".join([*parts, text[at:]])
    return re.sub(r"\n(?:[ \t]*\n){3,}", "\n\n\n", re.sub(r"(?m)[ \t]+$", "", out))


def _indented(text: str) -> str:
    out, body = [], None
    for line in _lines(text):
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        if body is not None:
            if not bare or indent > body:
                if bare.startswith(('"""', "'''")):
                    out.append(line)
                continue
            body = None
        if bare.startswith(("def ", "async def ")):
            out += [line, " " * (indent + 4) + "..."]
            body = indent
        elif not bare or bare.startswith(("import ", "from ", "#", "@", "class ")) or indent == 0:
            out.append(line)
    return "".join(x + "\n" for x in out)


def _sections(text: str, marks: tuple[str, ...], more: str) -> str:
    out, entries = [], 0
    for line in _lines(text):
        bare = line.strip()
        if not bare or bare.startswith(marks):
            out.append(line)
        elif bare.startswith("["):
            entries = 0
            out.append(line)
        else:
            entries += 1
            if entries <= MAX_ENTRIES + 1:
                out.append(line if entries <= MAX_ENTRIES else more)
    return "".join(x + "\n" for x in out)


def _head(text: str, more: str) -> str:
    lines = _lines(text)
    return "\n".join(lines[:MAX_LINES]) + (f"\n{more}\n" if len(lines) > MAX_LINES else "\n")


def _json(value: object, depth: int = 0) -> str:
    if isinstance(value, list):
        return f"[...{len(value)} items]"
    if not isinstance(value, dict):
        return json.dumps(value, ensure_ascii=False)
    if depth == 2:
        return "{...}"
    pad = "  " * (depth + 1)
    rows = [f'{pad}"{k}": {_json(v, depth + 1)}' for k, v in sorted(value.items())]
    return "{\n" + "".join(r + ("," if n < len(rows) - 1 else "") + "\n" for n, r in enumerate(rows)) + "  " * depth + "}"


def _yaml(text: str) -> str:
    return "".join(x + "\n" for x in _lines(text) if not re.match(r" (?! )|    |\t\t", x))


FALLBACK_MORE, XML_MORE = "// ... (truncated at 100 lines)", "<!-- ... (truncated) -->"


def stub(text: str | None, ext: str | None) -> str:
    """The summary of a file by the kind of its extension; '' for null and empty texts."""
    if not text:
        return ""
    ext = ext or ""
    family = next((k for k, v in C.FAMILIES.items() if ext in v.split()), "unknown")
    if family == "brace":
        return _braced(text, ext)
    if family == "indent":
        return _indented(text)
    if family == "ini":
        return _sections(text, (";", "#"), "; ... (more entries)")
    if ext == "toml":
        return _sections(text, ("#",), "# ... (more entries)")
    if ext in ("yaml", "yml"):
        return _yaml(text)
    if ext == "xml":
        return _head(text, XML_MORE)
    if ext == "json":
        try:
            return _json(json.loads(text))
        except ValueError:
            pass
    return _head(text, FALLBACK_MORE)


# --- blocks -----------------------------------------------------------------------------------------------------------


class Block(NamedTuple):
    kind: str
    identifier: str
    full: str
    summary: str

    @property
    def cost(self) -> int:
        return size(self.full)

    @property
    def summary_cost(self) -> int:
        return size(self.summary)


def size(text: str) -> int:
    """Tokens, a third of the bytes."""
    return -(-len(text.encode()) // 3)


# How imports, macros and types begin.
_IMPORT = re.compile(r"#include|#pragma|import |from |use (?!.*\{)")
_MACRO = re.compile(r"IMPLEMENT_|DECLARE_|[A-Z][A-Z_]{2,}\(")
_CLASS = re.compile(r"(?:class|struct|interface|trait|impl) ")


def _statements(text: str, quoted: bool) -> Iterator[tuple[str, Scope | None]]:
    """The statements of a summary, whole lines each, with their first outermost scope.

    One ends at the line on which its outermost scope closes, on which a ; stands outside all, or before a blank line. A
    line that is a comment, a directive, an import, an annotation or a closed macro is one by itself.
    """
    found, comments = scopes(text, quoted)
    outer = [s for s in found if s.depth == 0]
    held = sorted([(s.start, s.end) for s in outer] + comments)
    first, start, at, k = 0, 0, 0, 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        while k < len(held) and held[k][0] < end:  # a line goes on as long as something is open on it
            if held[k][1] > end:
                end = text.find("\n", held[k][1] - 1) + 1 or len(text)
            k += 1
        line, own = text[at:end].strip(), None
        while first < len(outer) and outer[first].start < at:
            first += 1
        if first < len(outer) and outer[first].start < end:
            own = outer[first]
        alone = line.startswith(("//", "/*", "#")) or _IMPORT.match(line) or _ANNOTATION.match(line) and line.count("(") <= line.count(")")
        if start < at and (not line or alone):
            yield text[start:at], None
            start = at
        if not line:
            start = end
        elif alone or own or line.endswith(";"):
            yield text[start:end], own
            start = end
        at = end
    if text[start:].strip():
        yield text[start:], None


def _describe(statement: str, scope: Scope | None, text: str) -> Block:
    """What a statement is, by its first line and its scope."""
    bare = statement.strip()
    line = bare.split("\n", 1)[0]
    if _IMPORT.match(line):
        return Block("imports", "", statement, "")
    if _MACRO.match(line):
        named = re.search(r"\(([^,)]*)[,)]", line)
        return Block("macro", named[1].strip().lower() if named else "", statement, statement)
    if _ANNOTATION.match(line):
        return Block("annotation", "", statement, statement)
    if bare.endswith(BODY.strip()) and "(" in bare:
        return Block("function", re.split(r"[\s*&>]", bare.split("(", 1)[0])[-1].lower(), statement, statement)
    if scope and scope.declares and _CLASS.match(line):
        inner = [x.strip() for x in text[scope.start + 1 : scope.end - 1].split("\n")]
        name = re.split(r"[\s:{<]", line.split(" ", 1)[1].lstrip())[0].lower()
        return Block("class", name, statement, f"{bare.split('{', 1)[0].strip()} {{ /* {sum(x[:1] not in ('', '{', '}') for x in inner)} members */ }};\n")
    return Block("misc", "", statement, "")


def blocks(text: str, ext: str) -> list[Block]:
    """A summary as blocks that can be kept, shortened or dropped by themselves; one block where there are no braces.

    Neighbouring imports are one block, and so are neighbouring annotations and statements of no kind.
    """
    if ext not in C.FAMILIES["brace"].split():
        return [Block("misc", "", text, text)]
    out: list[Block] = []
    for statement, scope in _statements(text, ext in _QUOTED):
        new = _describe(statement, scope, text)
        if out and new.kind == out[-1].kind and new.kind in ("imports", "annotation", "misc"):
            both = out[-1].full + new.full
            out[-1] = out[-1]._replace(full=both, summary=both if new.kind == "annotation" else "")
        else:
            out.append(new)
    return [b._replace(summary=_imports(b.full)) if b.kind == "imports" else b for b in out]


def _imports(text: str) -> str:
    lines = [x.strip() for x in _lines(text)]
    shown = [re.sub(r'^#include\s*[<"]?|[>"]$', "", x).rsplit("/", 1)[-1] if x.startswith("#include") else x for x in lines[:3]]
    return f"// {len(lines)} imports ({', '.join(shown)})\n"


# --- chunks -----------------------------------------------------------------------------------------------------------


def chunks(text: str, most: int) -> list[tuple[int, str]]:
    """(line of the summary, text) of pieces that end at blank lines, or where `most` bytes would be passed; short ones at blank lines are dropped."""
    out, part, start, n = [], [], 1, 0
    flush = lambda always: out.append((start, "\n".join(part))) if part and (always or n >= CHUNK_BYTES) else None
    for number, line in enumerate(_lines(text), 1):
        if not line.strip() and any(x.strip() for x in part):
            flush(False)
            part, n, start = [], 0, number + 1
            continue
        width = len(line.encode())
        if part and n + width + 1 > most:
            flush(True)
            part, n, start = [], 0, number
        n += width + (1 if part else 0)
        part.append(line)
    flush(False)
    return out


# --- on tables --------------------------------------------------------------------------------------------------------


def stub_column(text: Column, ext: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, exts in batches:
            yield pd.Series([stub(t, e) for t, e in zip(texts, exts)], dtype="object")

    return run(text, ext)


def block_table(files: DataFrame) -> DataFrame:
    """(file_id, position, kind, identifier, cost, summary_cost) of the blocks of every file's summary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, n, b.kind, b.identifier, b.cost, b.summary_cost) for k, t, e in zip(frame["file_id"], frame["content"], frame["ext"]) for n, b in enumerate(blocks(stub(t, e), e or ""))]
            yield pd.DataFrame(rows, columns=["file_id", "position", "kind", "identifier", "cost", "summary_cost"])

    return files.select("file_id", "content", "ext").mapInPandas(run, "file_id long, position int, kind string, identifier string, cost int, summary_cost int")


def chunk_table(files: DataFrame, most: int) -> DataFrame:
    """(file_id, start_line, text) of the chunks of embeddable files, each under the header of its path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, line, f"{h}\n{c}") for k, t, e, h in zip(frame["file_id"], frame["content"], frame["ext"], frame["header"]) for line, c in chunks(stub(t, e), most)]
            yield pd.DataFrame(rows, columns=["file_id", "start_line", "text"])

    wanted = files.where(C.embeddable(F.col("path"), F.octet_length("content"))).select("file_id", "content", "ext", C.path_header(F.col("path")).alias("header"))
    return wanted.mapInPandas(run, "file_id long, start_line int, text string")


def head_stub(text: Column, more: str = FALLBACK_MORE) -> Column:
    """The first lines, in built-in expressions."""
    lines = C.lines(text)
    return F.concat(F.array_join(F.slice(lines, 1, MAX_LINES), "\n"), F.when(F.size(lines) > MAX_LINES, F.lit(f"\n{more}\n")).otherwise(F.lit("\n")))


def yaml_stub(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(C.lines(text), lambda x: ~x.rlike(r"^( (?! )|    |\t\t)")), lambda x: F.concat(x, F.lit("\n"))), "")
