"""Length-preserving masking of what is not prose: code, links, tags, templates, front matter, ignored blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of masked characters inside a sentence, and of those that end one.
SOFT, BLOCK = "\ue000", "\ue001"

# ---- Fixed values: what is protected. ----
RAW_ELEMENTS = "script style pre code textarea kbd samp".split()
BLOCK_TAGS = frozenset(
    """p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table section article header footer nav aside main blockquote hr title option
dt dd figcaption figure body head html form label button caption summary details""".split()
)
IGNORE_FROM, IGNORE_TO = r"(?m)^[ \t]*<!--[ \t]*lint-ignore[ \t]*-->[ \t\r]*$", r"(?m)^[ \t]*<!--[ \t]*/lint-ignore[ \t]*-->[ \t\r]*$"
URL = r"(?:https?|ftp)://[^\s<>\"'«»]+|www\.[^\s<>\"'«»]+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,63}"
URL_TRAIL = ".,;:!?،؛؟)]}'\""
PLACEHOLDER = r"\[[^\[\]\n]{1,120}\](?!\()"

_FRONT = regex.compile(r"\A---[ \t]*\r?\n.*?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)", regex.S)
_FENCE = regex.compile(r"^[ \t]{0,3}(?P<c>[`~])(?P=c){2,}.*(?:\n(?![ \t]{0,3}(?P=c){3}).*+)*+(?:\n[ \t]{0,3}(?P=c){3}.*)?", regex.M)
_IGNORE_FROM, _IGNORE_TO = regex.compile(IGNORE_FROM), regex.compile(IGNORE_TO)
_RAW = regex.compile(rf"<(?P<end>/?)(?P<name>{'|'.join(RAW_ELEMENTS)})(?:\b[^<>]*+|\s*)>", regex.I)
_COMMENT = regex.compile(r"<!--.*?-->", regex.S)
_TAG = regex.compile(r"</?(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?:\s[^<>]*+)?>|<![A-Za-z][^<>]*+>|<\?[^<]*?\?>")
_CODE = regex.compile(r"``[^\n]+?``|`[^`\n]+`")
_TARGET = regex.compile(r"(?<=\])\([^()\s]*+(?:\([^()\s]*+\)[^()\s]*+)*+(?:\s+\"[^\"\n]*\"|\s+'[^'\n]*')?\)")
_PLACE = r"(?:<[^<>\s]+>|[A-Za-z][A-Za-z0-9+.\-]*:\S+|[./#~?]\S*|[^\s/]*/\S*|[^\s#?]*\.[A-Za-z0-9]{1,8}(?:[#?]\S*)?)"
_DEFINITION = regex.compile(rf"^[ \t]{{0,3}}\[[^\]\n]+\]:[ \t]*{_PLACE}(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?[ \t\r]*$", regex.M)
_URL = regex.compile(URL)
_TEMPLATE = regex.compile(r"\{\{(?:[^{}\n]|\{(?!\{)|\}(?!\}))*+\}\}|\{%(?:[^%{\n]|%(?!\})|\{(?!%))*+%\}|\{[^{}\n]{1,40}\}|%[A-Za-z_]\w*%|\$\{[^{}\n]*+\}")
_PLACEHOLDER = regex.compile(PLACEHOLDER)
_LINK_TEXT = regex.compile(r"\[([^\[\]\n]{1,200})\](?=\()")
_NOT_BREAK = regex.compile(r"[^\n]")
#: Texts without any of these have nothing to mask.
GATE = r"[`<{]|~~~|://|www\.|@|%[A-Za-z_]|\]\(|\]:|\A---"
_GATE = regex.compile(GATE)


def fences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _FENCE.finditer(text)] if "```" in text or "~~~" in text else []


def _inside(spans: list[tuple[int, int]], at: int) -> bool:
    i = bisect_left(spans, (at + 1,)) - 1
    return i >= 0 and spans[i][0] <= at < spans[i][1]


def ignored(text: str, code: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Blocks between markers on lines of their own; an open one reaches the end.  Markers inside code blocks are examples."""
    if "lint-ignore" not in text:
        return []
    code = fences(text) if code is None else code
    events = sorted([(m.start(), m.end(), True) for m in _IGNORE_FROM.finditer(text)] + [(m.start(), m.end(), False) for m in _IGNORE_TO.finditer(text)])
    out, begun = [], None
    for a, b, opens in events:
        if _inside(code, a):
            continue
        if opens and begun is None:
            begun = a
        elif not opens and begun is not None:
            out.append((begun, b))
            begun = None
    return out + ([(begun, len(text))] if begun is not None else [])


def _raw_elements(text: str) -> Iterator[tuple[int, int]]:
    """From an element's start tag to its next end tag; start tags without one protect nothing."""
    tags = list(_RAW.finditer(text))
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in tags:
        if m["end"]:
            ends.setdefault(m["name"].lower(), []).append(m.span())
    reach = 0
    for m in tags:
        if m["end"] or m.start() < reach:
            continue
        closers = ends.get(m["name"].lower(), [])
        i = bisect_left(closers, (m.end(),))
        if i < len(closers):
            reach = closers[i][1]
            yield m.start(), reach


def urls(text: str) -> list[tuple[int, int]]:
    """Links and addresses without the punctuation behind them."""
    if "://" not in text and "www." not in text and "@" not in text:
        return []
    return [(m.start(), m.start() + len(m[0].rstrip(URL_TRAIL))) for m in _URL.finditer(text)]


def protected(text: str, kind: str = "text") -> tuple[list[tuple[int, int, bool]], list[tuple[int, int]]]:
    """Protected spans (start, end, whether they end a sentence), merged; and the merged spans that even raw rules skip."""
    code = fences(text)
    hard: list[tuple[int, int, bool]] = [(a, b, True) for a, b in (*code, *ignored(text, code))]
    if kind == "md" and (front := _FRONT.match(text)):
        hard.append((0, front.end(), True))
    soft: list[tuple[int, int, bool]] = []
    if "<" in text:
        hard += [(a, b, True) for a, b in _raw_elements(text)]
        hard += [(*m.span(), True) for m in _COMMENT.finditer(text, 0, text.rfind("-->") + 3)]
        soft += [(*m.span(), (m["name"] or "").lower() in BLOCK_TAGS) for m in _TAG.finditer(text, 0, text.rfind(">") + 1)]
    hard += [(*m.span(), False) for m in _CODE.finditer(text)] if "`" in text else []
    if "](" in text:
        soft += [(*m.span(), False) for m in _TARGET.finditer(text)]
    if "]:" in text:
        soft += [(*m.span(), True) for m in _DEFINITION.finditer(text)]
    soft += [(a, b, False) for a, b in urls(text)]
    if "{" in text or "%" in text:
        soft += [(*m.span(), False) for m in _TEMPLATE.finditer(text)]
    return _merged(hard + soft), [(a, b) for a, b, _ in _merged(hard)]


def _merged(spans: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    out: list[tuple[int, int, bool]] = []
    for a, b, block in sorted(s for s in spans if s[1] > s[0]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] or block)
        else:
            out.append((a, b, block))
    return out


def _covered(text: str, spans) -> str:
    """The text with spans (start, end, mark) replaced character by character; line feeds stay."""
    parts, at = [], 0
    for a, b, mark in spans:
        parts += [text[at:a], _NOT_BREAK.sub(mark, text[a:b])]
        at = b
    return "".join([*parts, text[at:]]) if parts else text


def masked(text: str | None, kind: str = "text") -> str | None:
    if not text or not _GATE.search(text):
        return text
    return _covered(text, [(a, b, BLOCK if block else SOFT) for a, b, block in protected(text, kind)[0]])


def with_placeholders_masked(text: str, raw: str) -> str:
    """Bracketed gaps are masked too; link texts stay prose, only their brackets go."""
    if "[" not in text:
        return text
    brackets = [m.span() for m in _LINK_TEXT.finditer(raw) if text[m.start()] == "["]
    text = _covered(text, sorted(x for a, b in brackets for x in ((a, a + 1, SOFT), (b - 1, b, SOFT))))
    return _covered(text, [(*m.span(), SOFT) for m in _PLACEHOLDER.finditer(text)])


def prose(text: str, kind: str = "text") -> str:
    """What rules about sentences read."""
    return with_placeholders_masked(masked(text, kind) or "", text)


def mask_prose(text: Column, kind: str = "text") -> Column:
    """Masked text; only texts that have something to mask go through Python."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([masked(t, kind) for t in texts.to_pylist()], pa.string())

    return F.when(text.rlike(GATE), mask(F.when(text.rlike(GATE), text))).otherwise(text)


def read_prose(text: Column, kind: str = "text") -> Column:
    """``prose`` as a column."""

    @F.arrow_udf("string")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else prose(t, kind) for t in texts.to_pylist()], pa.string())

    gate = text.rlike(GATE + r"|\[")
    return F.when(gate, read(F.when(gate, text))).otherwise(text)
