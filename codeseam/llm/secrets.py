"""Problem 2: find credentials in source text and mask their values without touching anything else.

A text is searched layer by layer: what looks like base64, hex, percent or backslash escapes is decoded and searched
again, and bytes that are no text are parsed by the grammar of key containers. A find inside a layer masks the literal
of the text that encloses it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layers are opened as long as there are any: every one is shorter than what it was in. A text that is made to hold very
#: many is left when what was decoded from it comes to so many times its length, and so many characters more.
DECODED_TIMES, DECODED_MORE = 40, 1_000_000
#: Extensions of files in which values stand without quotes; also for files without extension.
PLAIN_VALUES = frozenset("yaml yml ini env toml conf cfg cnf properties sh bash zsh ps1 bat txt xml json tf tfvars dockerfile netrc pgpass npmrc".split()) | {""}


class Secret(NamedTuple):
    """What is to be masked: [start, end) pieces of the text, the first where the secret opens."""

    kind: str
    opens: int
    spans: tuple[tuple[int, int], ...]


# --- names and values -------------------------------------------------------------------------------------------------

#: Names (lower case, letters and digits only) that hold a secret.
_SECRET_NAME = re.compile(
    r"password|passwd|passwort|kennwort|motdepasse|contrasen|contraseñ|passphrase|parola|senha|wachtwoord|pwd|secret|credential"
    r"|(?:api|access|auth|account|signing|encryption|encrypt|private|master|license|storage|shared|service|session|client|deploy|secret)key"
    r"|token|(?:^|smtp|db|user|admin|root|ftp|mail|login|ssh|sudo|app)(?:pass|pw)$|^pin$|^clave|clave$|bearer$"
)
#: Names that speak of a secret but hold something else.
_OTHER_NAME = re.compile(
    r"(?:label|name|hint|error|type|file|path|dir|url|uri|id|ids|count|length|len|size|limit|ttl|expiry|expires|policy|field|header|prefix|suffix|format|pattern|regex"
    r"|prompt|message|title|text|placeholder|algorithm|alg|version|endpoint|enabled|required|fingerprint|checksum|digest|index|kind|class|store|provider|ref|arn|min|max|env|var)$"
    r"|tokenstream|tokeniz|tokenis|keyword|keyboard|^(?:next|prev|page|sort|cursor|continuation|csrf|primary|foreign|request|public|pub|partition|row|trace|cache|idempotency|group|order)"
)
_PLACEHOLDER = re.compile(
    r"\$\{|\$\(|\{\{|^\$[A-Z_]+$|^<.*>$|^%\w*%$|^%[sd(]|^@|process\.env|os\.environ|getenv|env\.|env\[|vault:|secretsmanager|arn:"
    r"|replace[_-]?me|change[_-]?me|changeit|^your[_-]|[_-]here$|example|placeholder|dummy|redacted|insert[_-]|^todo|^(?:none|null|nil|true|false|undefined|empty|unset|default|password|passwd|secret|token|test|pass|hidden|masked)$",
    re.I,
)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_DIGEST = re.compile(r"(?:sha\d+|md5|blake\w+)[:=-]", re.I)
_DOTTED = re.compile(r"[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+\(?")
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*")


@lru_cache(maxsize=200_000)
def names_secret(name: str) -> bool:
    """Whether a variable, key or element of that name holds a secret by its name."""
    flat = re.sub(r"[\W_]+", "", name.lower())
    return bool(_SECRET_NAME.search(flat)) and not _OTHER_NAME.search(flat)


def _repeats(value: str) -> bool:
    body = value.strip("\"'")
    return len(set(body)) <= 2 or bool(re.search(r"([Xx*.\-_0])\1{6,}", body))


_SPECIAL = re.compile(r"[^\w\s.,:;'\"()/\[\]{}<>=|\\-]")


def opaque(value: str) -> bool:
    """Whether a literal can be a secret: no reference, placeholder, word, path, sentence, id or checksum.

    Values of letters alone count where their case changes often, those with three kinds of small and capital letters,
    digits and special characters from five characters on. Values with a blank don't, nor those that hold "example".
    """
    if len(value) < 5 or any(c.isspace() for c in value):
        return False
    if _PLACEHOLDER.search(value) or _repeats(value) or _DIGEST.match(value) or _UUID.fullmatch(value) or "://" in value or value.startswith(("data:", "./", "../", "~/")):
        return False
    if value[0] == "/" and (len(value) < 24 or not re.search(r"[A-Z].*[A-Z]", value) or not re.search(r"\d", value) or "." in value):
        return False
    upper, lower, digit = (sum(map(f, value)) for f in (str.isupper, str.islower, str.isdigit))
    if (upper > 0) + (lower > 0) + (digit > 0) + bool(_SPECIAL.search(value)) >= 3 and not _DOTTED.fullmatch(value):
        return True
    if len(value) < 6:
        return False
    if digit == 0:
        turns = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:]))
        return len(value) >= 12 and upper >= 3 and lower >= 3 and turns >= 5 and not _DOTTED.fullmatch(value)
    return upper + lower > 0 and not (_DOTTED.fullmatch(value) and digit < 4)


def _unquoted(value: str) -> bool:
    """As opaque, for a value without quotes, which might as well be code."""
    if re.search(r"[()\[\]{}\"'`;,|&<>]|^[^\w/+]", value) or not opaque(value):
        return False
    if _IDENTIFIER.fullmatch(value):
        mixed = any(c.isupper() for c in value) and any(c.islower() for c in value) and any(c.isdigit() for c in value)
        return (mixed and len(value) >= 12) or bool(re.fullmatch(r"[0-9a-f]{24,}|[0-9A-Z]{16,}", value))
    return True


# --- detectors --------------------------------------------------------------------------------------------------------

#: Tokens that providers mark by a prefix: the prefix, and the whole from there.
_ISSUED = [
    (prefix, re.compile(pattern))
    for prefix, pattern in (
        ("AKIA", r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
        ("ASIA", r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
        ("ghp_", r"ghp_[0-9A-Za-z]{36,}"),
        ("gho_", r"gho_[0-9A-Za-z]{36,}"),
        ("ghu_", r"ghu_[0-9A-Za-z]{36,}"),
        ("ghs_", r"ghs_[0-9A-Za-z]{36,}"),
        ("ghr_", r"ghr_[0-9A-Za-z]{36,}"),
        ("github_pat_", r"github_pat_\w{22,}"),
        ("glpat-", r"glpat-[\w-]{20,}"),
        ("npm_", r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
        ("pypi-", r"pypi-[\w-]{40,}"),
        ("xox", r"xox[abeoprs]-[0-9A-Za-z-]{10,}"),
        ("xapp-", r"xapp-[0-9A-Za-z-]{20,}"),
        ("AIza", r"AIza[\w-]{35}(?![\w-])"),
        ("ya29.", r"ya29\.[\w-]{20,}"),
        ("sk-", r"sk-(?:[a-z]+-)*[0-9A-Za-z]{20,}"),
        ("sk_live_", r"sk_live_[0-9A-Za-z]{16,}"),
        ("rk_live_", r"rk_live_[0-9A-Za-z]{16,}"),
        ("whsec_", r"whsec_[0-9A-Za-z]{20,}"),
        ("hf_", r"hf_[0-9A-Za-z]{34,}"),
        ("dop_v1_", r"dop_v1_[0-9a-f]{64}"),
        ("shpat_", r"shpat_[0-9a-f]{32}"),
        ("SG.", r"SG\.[\w-]{16,}\.[\w-]{16,}"),
        ("AGE-SECRET-KEY-", r"AGE-SECRET-KEY-1[0-9A-Z]{50,}"),
    )
]
_JWT = re.compile(r"eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_PEM_BODY = re.compile(r"(?:\\[nr]|[\s\"'`+,;#*/\\\x2d]|//|<!--|Proc-Type:[^\n]*|DEK-Info:[^\n]*|(?:Version|Comment|Hash): [^\n]*)*?([A-Za-z0-9+/=]{16,})")
_BASE64_RUN = re.compile(r"[A-Za-z0-9+/]{4,}={0,2}")
#: The password ends at the last @ before the host's end, as it may hold that sign itself.
_LINK_USER = re.compile(r"://([^\s:/@\"'`<>]*):([^\s/\"'`<>]+)@[\w.\[{$-]")
_LINK_QUERY = re.compile(r"[?&](?:access_token|token|sig|signature|api_?key|key|secret|password|pwd|auth|x-amz-signature|x-goog-signature)=([^\s&;\"'`<>#]+)", re.I)
_LINK_HOOK = re.compile(r"://(?:hooks?|webhooks?|[\w.-]*discord(?:app)?)\.[^\s/\"'`]+/(?:api/)?(?:services|webhooks?|hooks?|workflows|triggers)/((?:[\w-]+/)*[\w-]{16,})", re.I)
_DSN_PART = re.compile(r"[;\"'`=\s](?:password|pwd|accountkey|sharedaccesskey|sharedsecret|accesskey)\s*=\s*([^;\"'`\s]+)", re.I)
_COMMANDS = [
    re.compile(r"\bsshpass\s+-p\s*['\"]?([^\s'\"]+)"),
    re.compile(r"\s--?(?:password|passwd|pass|passphrase|token|api-?key|secret|auth-token)(?:=|\s+)['\"]?([^\s'\"`,;)]+)", re.I),
    re.compile(r"\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[= ]?\s*['\"]?[^\s:'\"]+:([^\s'\"`]+)"),
    re.compile(r"\bmysql(?:dump|admin)?\b[^\n]*?\s-p([^\s'\"`]+)"),
]
_SCHEME = re.compile(r"\b(Bearer|Basic|bearer|basic|BEARER|BASIC|Token|token|ApiKey)\s+([A-Za-z0-9+/=_.~-]{8,})")
_LOGIN = re.compile(r"\b(?:login|log_in|auth|authenticate|sign_?in|connect|set_?credentials)\s*\(\s*([\"'`])[^\"'`\n]*\1\s*,\s*([\"'`])([^\"'`\n]+)\2", re.I)
_SAID = re.compile(
    r"\b(?:pass(?:word|wd|phrase)?|pwd|pw|secret|token|\w*key|credentials?|kennwort|passwort|mot de passe|contraseña|clave)\b[^\n\"'=:]{0,16}?\s(?:was|is|remains|stays|lautet|war|ist|est|était|es|era)[ :]+['\"`]?([^\s,\"'`]+)", re.I
)
_USE_SAID = re.compile(r"\b(?:use|using|try|enter|type|set)\b[^\n\"'=:]{0,20}?(?:\b|\+)(?:pass(?:word|wd|phrase)?|pwd|pw|pin|secret|token|key|kennwort|passwort|contraseña)\s+['\"`]?([^\s,\"'`]+)", re.I)
_LOGIN_SAID = re.compile(r"\b(?:login|logon|credentials?|account|zugang|user)\b[^\n\"'=]{0,24}?\s(?:is|are|was|lautet|:)\s+\S+\s*(?:/|\bwith\b|\band\b)\s*([^\s,]+)", re.I)
#: What lines with the name of a secret, or a phrase about one, have in them.
_HINT_WORDS = (
    "pass", "pwd", "pw", "secret", "token", "key", "kennwort", "passwort", "mot", "contrase", "clave", "senha", "parola", "wachtwoord", "credential",
    "login", "auth", "pin", "bearer", "basic "
)
_HINT = re.compile("|".join(_HINT_WORDS), re.I)
#: The whole run of name characters, once: what follows it is the same wherever in the run the name begins.
_NAME_BEFORE_QUOTE = re.compile(r"(?<![\w.\-])([\w.\-]++)[\"'`]?\]?\s*+(?:(?::=|=>|==?|:|,|\()\s*+)?(?:[rbfu]{1,2}(?=[\"'`]))?(\"\"\"|\'\'\'|[\"'`])")
_NAME_IN_RUN = re.compile(r"(?:^|(?<=[.\-]))[^\W\d].*", re.S)
_CONTINUED = re.compile(r"\s*(?:\+|\.\.?|<>|\\)\s*([\"'`])([^\"'`\n]*)\1")
_ELEMENT = re.compile(r"<([^\W\d][\w.\-]*)(?:\s[^<>]*)?>\s*([^<>\s]+)\s*</\1>")
_ATTRIBUTES = re.compile(r"(?:key|name|id)\s*[=:]\s*[\"']([^\"'\n]+)[\"'][\s,]+[\"']?(?:value|val|content)[\"']?\s*[=:]\s*[\"']([^\"'\n]+)[\"']", re.I)
_PLAIN = re.compile(r"^[ \t]*(?:(?:export|set|setx|env|arg|declare -x)[ \t]+|-[ \t]+|(?:#|//|;|--)[ \t]*)?[\"']?([^\W\d][\w.\-]*)[\"']?[ \t]*(?:=|:[ \t]|:(?=\S))[ \t]*([^\s\"'`][^\s]*)[ \t]*(?:#.*)?$", re.I)
_BLOCK = re.compile(r"^[ \t]*(?:-[ \t]+)?[\"']?([^\W\d][\w.\-]*)[\"']?[ \t]*:[ \t]*[|>][+-]?[ \t]*\r?\n[ \t]+([^\s\"'`]+)[ \t]*$", re.M)

_BASE64 = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}|[A-Za-z0-9_-]{24,}={0,2}")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){16,}")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2}[^\s\"'`<>%]*){3,}")
#: What stands between the pieces of a wrapped literal: a line end, quotes with or without a sign that joins, an escaped line end.
_WRAP = re.compile(
    r"(?:(?:\\r)?(?:\\n)?\\?[ \t]*\r?\n[ \t]*(?:(?://|[#*;]|--?)[ \t]+)?|(?:(?:\\r)?\\n)?[\"'`][ \t]*(?:\.\.|<>|[+.,&\\])?[ \t]*(?:\\?\r?\n[ \t]*)?(?:[+.&,][ \t]*)?[rbfu]{0,2}[\"'`]|(?:\\r)?\\n)"
)
_PIECE = re.compile(r"[A-Za-z0-9+/_-]++")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:(?<=\\)[nrt])?([A-Za-z0-9+/_-]{{16,}}+(?:{_WRAP.pattern}{_PIECE.pattern}(?=={{0,2}}(?:[\s\"'`\\,;)\]}}<]|\Z)))+)")
_LITERAL_ENDS = frozenset(" \t\r\n\"'`<>\x00")
_ESCAPES = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){4,}(?:[^\s\"'`\\]*(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}))*")


def _quoted(text: str, at: int, mark: str, line_end: int) -> int:
    """The end of the literal that begins at `at`; -1 if it doesn't end (on its line, but for triple quotes and `)."""
    stop = len(text) if len(mark) == 3 or mark == "`" else line_end
    while True:
        end = text.find(mark, at, stop)
        if end < 0:
            return -1
        back = 0
        while text[end - 1 - back] == "\\":
            back += 1
        if back % 2 == 0 or len(mark) == 3:
            return end
        at = end + 1


def _keyed(text: str, lo: int, hi: int, plain: bool) -> Iterator[Secret]:
    """Secrets by the name of what holds them, and those that comments give away, within text[lo:hi] (a line)."""
    for m in _NAME_BEFORE_QUOTE.finditer(text, lo, hi):
        name = _NAME_IN_RUN.search(m[1], 1 if text[m.start() - 1 : m.start()] == "$" else 0)
        if not name or not names_secret(name[0]):
            continue
        start, end = m.end(), _quoted(text, m.end(), m[2], hi)
        if end < 0:
            continue
        spans, value, rest = [(start, end)], text[start:end], end + len(m[2])
        while c := _CONTINUED.match(text, rest):
            spans.append(c.span(2))
            value += c[2]
            rest = c.end()
        if opaque(value):
            yield Secret("named", start, tuple(spans))
    for pattern in (_ELEMENT, _ATTRIBUTES):
        for m in pattern.finditer(text, lo, hi):
            if names_secret(m[1]) and opaque(m[2]):
                yield Secret("named", m.start(2), (m.span(2),))
    if plain and (m := _PLAIN.match(text[lo:hi].rstrip("\r"))) and names_secret(m[1]) and _unquoted(m[2]):
        yield Secret("named", lo + m.start(2), ((lo + m.start(2), lo + m.end(2)),))
    for m in _LOGIN.finditer(text, lo, hi):
        if opaque(m[3]):
            yield Secret("login", m.start(3), (m.span(3),))
    for pattern in (_SAID, _USE_SAID, _LOGIN_SAID):
        for m in pattern.finditer(text, lo, hi):
            value = m[1].rstrip(".,;:)")
            if opaque(value) and not re.fullmatch(r"\d+[a-z]*|[a-z_]+\d{0,2}", value):
                yield Secret("said", m.start(1), ((m.start(1), m.start(1) + len(value)),))
    for m in _SCHEME.finditer(text, lo, hi):
        if m[1].lower() == "basic":
            pair = _text_of(_unbase64(m[2]))
            if pair and ":" in pair and len(pair.split(":", 1)[1]) >= 4 and not _PLACEHOLDER.search(pair.split(":", 1)[1]):
                yield Secret("basic", m.start(2), (m.span(2),))
        elif len(m[2]) >= 16 and opaque(m[2]):
            yield Secret("bearer", m.start(2), (m.span(2),))


def _hints(text: str) -> Iterator[tuple[int, int]]:
    """Where hints stand, in order. Plain searches in the lower-case text are many times faster than one pattern for all."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow
        yield from (m.span() for m in _HINT.finditer(text))
        return
    found = []
    for word in _HINT_WORDS:
        at = low.find(word)
        while at >= 0:
            if word != "token" or not low.startswith(("stream", "_stream"), at + 5):
                found.append((at, at + len(word)))
            at = low.find(word, at + len(word))
    yield from sorted(found)


def _lines_with_hints(text: str) -> Iterator[tuple[int, int]]:
    """The lines around hints, however long."""
    done = 0
    for start, end in _hints(text):
        if end <= done:
            continue
        lo = text.rfind("\n", 0, start) + 1
        hi = text.find("\n", end)
        hi = len(text) if hi < 0 else hi
        yield lo, hi
        done = hi


def _blocks(text: str) -> Iterator[Secret]:
    """Private key blocks, also encrypted or commented out: the body is masked."""
    for m in _PEM.finditer(text):
        end = text.find(f"-----END {m[1]}-----", m.end())
        rest = text[m.end() : text.find("\n", m.end()) if "\n" in text[m.end() : m.end() + 400] else m.end() + 400]
        cut = text.find("\x00", m.end())
        stop = min(x for x in (end, cut, len(text)) if x >= 0)
        body = _PEM_BODY.match(text, m.end(), stop)
        if body:
            runs = []
            at = body.start(1)
            limit = stop if end >= 0 and stop == end else None
            while run := _BASE64_RUN.search(text, at, limit or stop):
                if limit is None and re.search(r"[^\\nr\s\"'`+,;#*/\-.]", re.sub(r"\\[nr]", "", text[at : run.start()])):
                    break
                first = 1 if text[run.start() - 1] == "\\" and text[run.start()] in "nr" else 0
                runs.append((run.start() + first, run.end()))
                at = run.end()
            yield Secret("private key", m.start(), tuple(runs))
        elif not rest.strip() and stop != end and not text[m.end() : stop].strip():
            yield Secret("private key", m.start(), ())


def _issued(text: str) -> Iterator[Secret]:
    for prefix, pattern in _ISSUED:
        if prefix in text:
            for m in pattern.finditer(text):
                before = text[m.start() - 1 : m.start()]
                if not (before.isalnum() or before == "_") and not _repeats(m[0][len(prefix) :]) and not _PLACEHOLDER.search(m[0]) and re.search(
                    r"\d|[A-Z].*[a-z].*[A-Z]", m[0][len(prefix) :]
                ):
                    yield Secret("issued token", m.start(), (m.span(),))
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            head = _text_of(_unbase64(m[0].split(".")[0]))
            try:
                if head and "alg" in json.loads(head):
                    yield Secret("signed token", m.start(), (m.span(),))
            except (ValueError, TypeError):
                pass


def _links(text: str) -> Iterator[Secret]:
    for m in _LINK_USER.finditer(text):
        word = m[2]
        if len(word) >= 4 and not _PLACEHOLDER.search(word) and not _repeats(word) and not word.isdigit():
            yield Secret("link", m.start(2), (m.span(2),))
    for m in _LINK_HOOK.finditer(text):
        if opaque(m[1].rsplit("/", 1)[-1]):
            yield Secret("link", m.start(1), (m.span(1),))
    for m in _LINK_QUERY.finditer(text):
        if len(m[1]) >= 12 and opaque(m[1]):
            yield Secret("link", m.start(1), (m.span(1),))


def _plain_finds(text: str, plain: bool) -> Iterator[Secret]:
    """What can be seen in a text without decoding."""
    if "PRIVATE KEY" in text:
        yield from _blocks(text)
    yield from _issued(text)
    if "://" in text:
        yield from _links(text)
    for lo, hi in _lines_with_hints(text):
        yield from _keyed(text, lo, hi, plain)
        if "=" in (line := text[lo:hi]) and ";" in line:
            for m in _DSN_PART.finditer(text, lo, hi):
                if len(m[1]) >= 4 and not re.search(r"[(){}\[\]]|::", m[1]) and not _PLACEHOLDER.search(m[1]) and not _repeats(m[1]):
                    yield Secret("connection", m.start(1), (m.span(1),))
    if plain and ("|" in text or ">" in text):
        for m in _BLOCK.finditer(text):
            if names_secret(m[1]) and _unquoted(m[2]):
                yield Secret("named", m.start(2), (m.span(2),))
    for pattern, sign in zip(_COMMANDS, ("sshpass", "--", "-", "mysql")):
        if sign in text and (sign != "-" or "curl" in text or "wget" in text):
            for m in pattern.finditer(text):
                if len(m[1]) >= 4 and not _PLACEHOLDER.search(m[1]) and not _repeats(m[1]) and any(c.isdigit() for c in m[1]):
                    yield Secret("command", m.start(1), (m.span(1),))


# --- layers and containers --------------------------------------------------------------------------------------------


def _unbase64(literal: str) -> bytes | None:
    body = literal.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _text_of(data: bytes | None) -> str | None:
    """The bytes as text, if they are text."""
    if not data:
        return None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.97 * len(text) else None


def _der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at `at`."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data):
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= len(data) else None


def _children(data: bytes, lo: int, hi: int) -> list[tuple[int, bytes]]:
    out = []
    while lo < hi:
        part = _der(data, lo)
        if not part or part[2] > hi:
            return []
        out.append((part[0], data[part[1] : part[2]]))
        lo = part[2]
    return out


class _Bytes:
    """Reads the fields of a binary format; any field that would end beyond the data raises ValueError."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def field(self, n: int = 4) -> bytes:
        """A field that is preceded by its length in n bytes."""
        return self.take(self.number(n))

    def left(self) -> int:
        return len(self.data) - self.at


def _openssh(data: bytes) -> bool:
    """Magic, cipher, derivation and its options, number of keys, as many public keys, and the private part, whole in blocks of 8."""
    r = _Bytes(data)
    if r.take(15) != b"openssh-key-v1\x00":
        return False
    cipher, derivation = r.field(), r.field()
    r.field()
    keys = r.number(4)
    if not cipher.isascii() or not derivation or not 1 <= keys <= 64:
        return False
    for _ in range(keys):
        if not _Bytes(r.field()).field().isascii():
            return False
    private = r.field()
    if len(private) < 8 or len(private) % 8:
        return False
    return cipher != b"none" or private[:4] == private[4:8]  # twice the same number, where it isn't encrypted


def _key_store(data: bytes) -> bool:
    """JKS and JCEKS: magic, version, entries; at least one of a private (1) or secret (3) key. Certificates (2) alone are none."""
    r = _Bytes(data)
    if r.take(4) not in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce"):
        return False
    version, entries, keys = r.number(4), r.number(4), 0
    if version not in (1, 2):
        return False
    for _ in range(entries):
        tag = r.number(4)
        r.field(2)  # alias
        r.take(8)  # created
        if tag == 3:
            return True  # a serialised object follows, whose end only Java can tell
        if tag not in (1, 2):
            return False
        chain = 1
        if tag == 1:
            r.field()
            chain, keys = r.number(4), keys + 1
        for _ in range(chain):
            if version == 2:
                r.field(2)
            r.field()
    return keys > 0 and r.left() in (0, 20)


def _openpgp(data: bytes) -> bool:
    """Packets from the first to the end of the data; the first is a secret key (5) whose numbers are as long as they say."""
    r, first = _Bytes(data), True
    while r.left():
        head = r.number(1)
        if not head & 0x80:
            return False
        if head & 0x40:
            tag, size = head & 0x3F, r.number(1)
            if size >= 192:
                size = int.from_bytes(r.take(4), "big") if size == 255 else ((size - 192) << 8) + r.number(1) + 192 if size < 224 else -1
        else:
            tag, kind = (head >> 2) & 15, head & 3
            size = r.left() if kind == 3 else r.number((1, 2, 4)[kind])
        body = r.take(size)
        if first and not (tag == 5 and _secret_key_body(body)):
            return False
        if tag in (0, 15, 16) or tag > 21 and tag < 60:
            return False
        first = False
    return not first


def _secret_key_body(body: bytes) -> bool:
    r = _Bytes(body)
    version = r.number(1)
    if version not in (3, 4, 5, 6):
        return False
    r.take(4)
    if version == 3:
        r.take(2)
    algorithm = r.number(1)
    if version >= 5:
        public = _Bytes(r.field())
    else:
        public = r
    # Numbers of the public key, by algorithm; curves begin with the length of their name.
    numbers = {1: 2, 2: 2, 3: 2, 16: 3, 17: 4, 18: 1, 19: 1, 22: 1}.get(algorithm)
    if algorithm in (25, 26, 27, 28):
        public.take({25: 32, 26: 56, 27: 32, 28: 57}[algorithm])
    elif numbers is None:
        return False
    else:
        if algorithm in (18, 19, 22):
            name = public.field(1)
            if name[:1] not in (b"\x2a", b"\x2b"):
                return False
        for _ in range(numbers):
            bits = public.number(2)
            value = public.take((bits + 7) // 8)
            if bits == 0 or value[0].bit_length() != (bits - 1) % 8 + 1:
                return False
        if algorithm == 18:
            public.field(1)
    r.number(1)  # how the secret part is protected
    return r.left() >= 2


def _der_kind(data: bytes) -> str | None:
    top = _der(data)
    if not top or top[0] != 0x30 or top[2] - top[1] < 16 or len(data) - top[2] > 4:
        return None
    parts = _children(data, top[1], top[2])
    tags = [t for t, _ in parts]
    if tags[:3] == [0x02, 0x30, 0x04] and parts[0][1] in (b"\x00", b"\x01") and _children(parts[1][1], 0, len(parts[1][1]))[:1] and parts[1][1][:1] == b"\x06":
        return "pkcs8"
    if len(parts) >= 9 and tags[:9] == [0x02] * 9 and parts[0][1] in (b"\x00", b"\x01"):
        return "pkcs1"
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01" and 16 <= len(parts[1][1]) <= 72:
        return "sec1"
    if tags == [0x30, 0x04] and parts[0][1][:1] == b"\x06" and len(parts[1][1]) >= 32:
        return "pkcs8 encrypted"
    if tags[:2] == [0x02, 0x30] and parts[0][1] == b"\x03" and parts[1][1][:2] == b"\x06\x09":
        return "pkcs12"
    return None


def key_container(data: bytes) -> str | None:
    """The kind of private key container the bytes are, by their grammar: PKCS#1, #8, #12, SEC 1, OpenSSH, JKS, OpenPGP; else None."""
    for start, kind, holds in (
        (b"openssh-key-v1\x00", "openssh", _openssh), (b"\xfe\xed\xfe\xed", "keystore", _key_store), (b"\xce\xce\xce\xce", "keystore", _key_store),
        (None, "openpgp", _openpgp)
    ):
        if data.startswith(start) if start else data[:1] in (b"\x94", b"\x95", b"\x96", b"\xc5"):
            try:
                return kind if holds(data) else None
            except ValueError:
                return None
    return _der_kind(data)


def _layers(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Literals that hold another text or bytes: [start, end) and what they hold."""
    for m in _BASE64.finditer(text):
        word = m[0]
        if not (any(c.isdigit() for c in word) or "+" in word) and word.islower():
            continue
        data = _unbase64(word)
        if data:
            yield m.start(), m.end(), data
    for m in _HEX.finditer(text):
        yield m.start(), m.end(), bytes.fromhex(m[0])
    if "%" in text:
        for m in _PERCENT.finditer(text):
            start = m.start()
            while start > 0 and text[start - 1] not in _LITERAL_ENDS:
                start -= 1
            # %2525..41 is as many layers as it has 25s: they are opened at once.
            yield start, m.end(), unquote(re.sub(r"%(?:25)+(?=[0-9A-Fa-f]{2})", "%", text[start : m.end()])).encode()
    if "\\" in text:
        for m in _ESCAPES.finditer(text):
            try:
                yield m.start(), m.end(), m[0].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("utf-8", "replace")
            except UnicodeDecodeError:
                pass


def _wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """Pieces of base64 or hex that may be one literal: those of one width with the shorter last one, and all that are joined."""
    for m in _WRAPPED.finditer(text):
        pieces, at = [], m.start(1)
        while at < m.end(1):
            piece = _PIECE.match(text, at)
            pieces.append(piece.span())
            at = _WRAP.match(text, piece.end()).end() if piece.end() < m.end(1) else m.end(1)
        width = [b - a for a, b in pieces]
        groups, first = [], 0
        for n in range(1, len(pieces) + 1):
            if n == len(pieces) or width[n] > width[first] or width[n - 1] < width[first]:
                groups.append((first, n))
                first = n
        groups += [(a, b - 1) for a, b in groups if width[b - 1] < width[a]] + [(0, len(pieces))]
        yield from (pieces[a:b] for a, b in dict.fromkeys(groups) if b - a > 1)


def _in_wrapped(text: str, pieces: list[tuple[int, int]], room: list[int]) -> Iterator[Secret]:
    """Secrets of a wrapped literal: a key container masks all pieces, a find in its text those that hold it."""
    word = "".join(text[a:b] for a, b in pieces)
    if word.islower() and not any(c.isdigit() for c in word):
        return
    ends, at = [], 0
    for a, b in pieces:
        at += b - a
        ends.append(at)
    decoded = [(_unbase64(word), 4, 3)]
    if len(word) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", word):
        decoded.append((bytes.fromhex(word), 2, 1))
    for data, chars, size in decoded:
        if data and (kind := key_container(data)):
            yield Secret(kind, pieces[0][0], tuple(pieces))
        elif inner := _text_of(data):
            ranges: list[list[int]] = []
            for s in _search(inner, True, room):
                lo, hi = s.opens, max([s.opens + 1, *(b for _, b in s.spans)])
                lo, hi = (len(inner[:k].encode()) * chars for k in (lo, hi))
                i, k = bisect_right(ends, lo // size), min(bisect_right(ends, (hi - 1) // size), len(pieces) - 1)
                if ranges and i == ranges[-1][0]:
                    ranges[-1][1] = max(ranges[-1][1], k)
                elif ranges and i <= ranges[-1][1]:
                    k = max(k, ranges[-1][1])
                    ranges[-1][1] = i - 1
                    ranges.append([i, k])
                else:
                    ranges.append([i, k])
            yield from (Secret("encoded", pieces[i][0], tuple(pieces[i : k + 1])) for i, k in ranges)


def find_secrets(text: str | None, plain: bool = True) -> list[Secret]:
    """The secrets of a text, in the order in which they open, none inside another; none for null and empty texts.

    plain: values without quotes count too, as in configuration files. Layers within layers are opened to any depth.
    """
    return _search(text, plain, [DECODED_TIMES * len(text) + DECODED_MORE]) if text else []


def _search(text: str, plain: bool, room: list[int]) -> list[Secret]:
    """room: how many characters may still be decoded out of the whole text."""
    found = list(_plain_finds(text, plain))
    for start, end, data in _layers(text):
        if kind := key_container(data):
            found.append(Secret(kind, start, ((start, end),)))
        elif (inner := _text_of(data)) and inner != text[start:end] and room[0] > 0:
            room[0] -= len(inner)
            if _search(inner, True, room):
                found.append(Secret("encoded", start, ((start, end),)))
    for pieces in _wrapped(text):
        if room[0] > 0:
            room[0] -= pieces[-1][1] - pieces[0][0]
            found += _in_wrapped(text, pieces, room)
    out: list[Secret] = []
    taken = -1
    for s in sorted(found, key=lambda s: (s.opens, -max([b for _, b in s.spans], default=s.opens))):
        last = max([b for _, b in s.spans], default=s.opens + 1)
        if s.opens >= taken:
            out.append(s)
            taken = max(taken, last)
    return out


def redact(text: str, secrets: list[Secret]) -> str:
    """The text with the values masked by *, character by character; line ends and all around them stay."""
    parts, at = [], 0
    for a, b in sorted(span for s in secrets for span in s.spans):
        if b <= at:
            continue
        a = max(a, at)
        parts += [text[at:a], re.sub(r"[^\r\n]", "*", text[a:b])]
        at = b
    return "".join([*parts, text[at:]])


# --- on tables --------------------------------------------------------------------------------------------------------

PLACES = "record_id long, line_no int, kind string, start_char int, n_chars int"


def _is_plain(path: str | None) -> bool:
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] in PLAIN_VALUES if "." in name else True


def _file_places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for key, path, text in zip(frame["record_id"], frame["path"], frame["body"]):
            if finds := find_secrets(text, _is_plain(path)):
                breaks = [m.start() for m in re.finditer("\n", text)]
                rows += [(key, bisect_right(breaks, s.opens - 1) + 1, s.kind, s.opens, sum(b - a for a, b in s.spans)) for s in finds]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACES.split(", ")])


def _line_places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of a batch are searched as one text, with a character between them that no pattern crosses."""
    for frame in frames:
        frame = frame[frame["body"].notna()]
        plain = frame["path"].map(_is_plain)
        rows = []
        for kind in (True, False):
            part = frame[plain == kind]
            starts, at = [], 0
            for t in part["body"]:
                starts.append(at)
                at += len(t) + 3
            keys, lines = part["record_id"].tolist(), part["line_no"].tolist()
            for s in find_secrets("\n\x00\n".join(part["body"]), kind):
                n = bisect_right(starts, s.opens) - 1
                rows.append((keys[n], lines[n], s.kind, s.opens - starts[n], sum(b - a for a, b in s.spans)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLACES.split(", ")])


def places_in_files(files: DataFrame, item: str = "file_id", path: str = "rel_path", text: str = "content") -> DataFrame:
    """(origin 'file', record_id, line_no, kind, start_char, n_chars), one row per secret; lines are split at line feeds.

    Null texts have none. A row that occurs twice yields its secrets twice. start_char counts from 0 in the text.
    """
    rows = files.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("record_id"), F.col(path).alias("path"), F.col(text).alias("body"))
    return rows.mapInPandas(_file_places, PLACES).select(F.lit("file").alias("origin"), "*")


def places_in_lines(lines: DataFrame, item: str = "blame_id", line_no: str = "line_no", path: str = "rel_path", text: str = "content") -> DataFrame:
    """As places_in_files, with origin 'blame', for a table of single lines; a key block shows where its BEGIN line is."""
    rows = lines.where(F.col(item).isNotNull() & F.col(text).isNotNull() & F.col(line_no).isNotNull())
    rows = rows.select(F.col(item).alias("record_id"), F.col(line_no).cast("int").alias("line_no"), F.col(path).alias("path"), F.col(text).alias("body"))
    return rows.mapInPandas(_line_places, PLACES).select(F.lit("blame").alias("origin"), "*")


def redacted(df: DataFrame, item: str, path: str, text: str) -> DataFrame:
    """(item, text, n_secrets) with the values masked, for every row; null texts stay null."""
    kind = df.schema[item].dataType.simpleString()

    def mask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            finds = [find_secrets(t, _is_plain(p)) for p, t in zip(frame["path"], frame["body"])]
            frame["n_secrets"] = [len(f) for f in finds]
            frame["body"] = [redact(t, f) if f else t for t, f in zip(frame["body"], finds)]
            yield frame[["record_id", "body", "n_secrets"]]

    rows = df.select(F.col(item).alias("record_id"), F.col(path).alias("path"), F.col(text).alias("body"))
    return rows.mapInPandas(mask, f"record_id {kind}, body string, n_secrets int").select(F.col("record_id").alias(item), F.col("body").alias(text), "n_secrets")


def _mask_lines(numbers: list, texts: list, plain: bool) -> tuple[list, list[int]]:
    """The lines of one file, masked, and of each how many secrets stand in it; a gap in the numbers is crossed by no secret.

    Lines are searched together, so that all lines of a key block are masked, and each by itself, as in places_in_lines.
    """
    body = [t or "" for t in texts]
    starts, together = [], []
    at = 0
    for n, t in enumerate(body):
        follows = n and None not in (numbers[n], numbers[n - 1]) and numbers[n] == numbers[n - 1] + 1
        glue = "" if n == 0 else "\n" if follows else "\n\x00\n"
        together += [glue, t]
        starts.append(at + len(glue))
        at += len(glue) + len(t)
    apart, begin = [], 0
    for t in body:
        apart.append(begin)
        begin += len(t) + 3
    spans: list[list[tuple[int, int]]] = [[] for _ in body]
    hulls: list[list[tuple[int, int]]] = [[] for _ in body]
    for text, offsets in (("".join(together), starts), ("\n\x00\n".join(body), apart)):
        for s in find_secrets(text, plain):
            parts: dict[int, list[tuple[int, int]]] = {}
            n = bisect_right(offsets, s.opens) - 1
            parts[n] = [(s.opens - offsets[n],) * 2]
            for a, b in s.spans:
                n = bisect_right(offsets, a) - 1
                while n < len(body) and offsets[n] < b:
                    lo, hi = max(a - offsets[n], 0), min(b - offsets[n], len(body[n]))
                    if lo < hi:
                        parts.setdefault(n, []).append((lo, hi))
                        spans[n].append((lo, hi))
                    n += 1
            for n, found in parts.items():
                hulls[n].append((min(a for a, _ in found), max(b for _, b in found)))
    counts = []
    for found in hulls:
        k, end = 0, -1
        for lo, hi in sorted(set(found)):
            k += lo >= end
            end = max(end, hi, lo + 1)
        counts.append(k)
    masked = [redact(t, [Secret("", 0, tuple(x))]) if x else t for t, x in zip(texts, spans)]
    return masked, counts


def redacted_lines(lines: DataFrame, item: str = "blame_id", repo: str = "repo", line_no: str = "line_no", path: str = "rel_path", text: str = "content") -> DataFrame:
    """As redacted, for a table of single lines, once per item. The lines of a file meet in one task, as a file's text does in one row."""
    kind = lines.schema[item].dataType.simpleString()

    def mask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, keys, numbers, texts in zip(frame["path"], frame["keys"], frame["numbers"], frame["texts"]):
                keys, numbers, texts = ([None if pd.isna(x) else x for x in column] for column in (keys, numbers, texts))
                first = list({k: n for n, k in reversed(list(enumerate(keys)))}.values())[::-1]
                masked, counts = _mask_lines([numbers[n] for n in first], [texts[n] for n in first], _is_plain(path))
                rows += zip([keys[n] for n in first], masked, counts)
            yield pd.DataFrame(rows, columns=["record_id", "body", "n_secrets"])

    alone = F.when(F.col(repo).isNull() | F.col(path).isNull() | F.col(line_no).isNull(), F.col(item))
    rows = lines.where(F.col(item).isNotNull()).select(
        F.col(repo).alias("repo"), F.col(path).alias("path"), alone.alias("alone"),
        F.struct(F.col(line_no).cast("int").alias("n"), F.col(item).alias("k"), F.col(text).alias("t")).alias("line")
    )
    files = rows.groupBy("repo", "path", "alone").agg(F.array_sort(F.collect_list("line")).alias("lines")).select(
        "path", F.col("lines.k").alias("keys"), F.col("lines.n").alias("numbers"), F.col("lines.t").alias("texts")
    )
    return files.mapInPandas(mask, f"record_id {kind}, body string, n_secrets int").select(F.col("record_id").alias(item), F.col("body").alias(text), "n_secrets")
