"""Resource files as units: key, value and line of every translatable string."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

from ..rules.persian import LETTERS

Entry = tuple[str, str, int]


def json_entries(text: str) -> list[Entry]:
    """String leaves under dotted keys with [i] for arrays; keys that start with @ and what they hold are skipped."""
    lines = _json_lines(text)
    out: list[Entry] = []

    def walk(node, path: str) -> None:
        if isinstance(node, dict):
            for key, value in node.items():
                if not key.startswith("@"):
                    walk(value, f"{path}.{key}" if path else key)
        elif isinstance(node, list):
            for i, value in enumerate(node):
                walk(value, f"{path}[{i}]")
        elif isinstance(node, str):
            out.append((path, node, lines.get(path, 1)))

    walk(json.loads(text), "")
    return out


def _json_lines(text: str) -> dict[str, int]:
    """Line on which each leaf's value starts: one pass with a stack of open keys and indices."""
    out: dict[str, int] = {}
    stack: list[list] = []  # [is_object, key or index]
    line, i, n, expect_key = 1, 0, len(text), False

    def path() -> str:
        done = ""
        for is_object, at in stack:
            done += (f".{at}" if done else str(at)) if is_object else f"[{at}]"
        return done

    while i < n:
        c = text[i]
        if c == "\n":
            line += 1
        elif c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            value = text[i : j + 1]
            if expect_key and stack and stack[-1][0]:
                stack[-1][1] = json.loads(value)
                expect_key = False
            else:
                out.setdefault(path(), line)
            line += value.count("\n")
            i = j
        elif c in "{[":
            stack.append([c == "{", 0])
            expect_key = c == "{"
        elif c in "}]" and stack:
            stack.pop()
            expect_key = False
        elif c == "," and stack:
            if stack[-1][0]:
                expect_key = True
            else:
                stack[-1][1] += 1
        i += 1
    return out


_PO_LINE = re.compile(r'^(msgctxt|msgid_plural|msgid|msgstr(?:\[\d+\])?)?\s*"(.*)"\s*$')


#: Code points of a key that are shown.
KEY_CHARS = 60
_PERSIAN = re.compile(f"[{LETTERS}]")


def po_entries(text: str) -> list[Entry]:
    """Translations, keyed by context and source; continued lines join.

    An entry without any stands for its source if that is Persian; the header
    (an empty source without a context) is none.
    """
    out: list[Entry] = []
    parts: dict[str, str] = {}
    lines: dict[str, int] = {}
    field = ""

    def close() -> None:
        source, context = parts.get("msgid", ""), parts.get("msgctxt")
        if parts and (source or context is not None):
            key = (f"{context}|{source}" if context else source)[:KEY_CHARS]
            strings = sorted(f for f in parts if f.startswith("msgstr") and parts[f])
            out.extend((key + f[6:], parts[f], lines[f]) for f in strings)
            if not strings and _PERSIAN.search(source):
                out.append((key, source, lines["msgid"]))
        parts.clear()
        lines.clear()

    for number, raw in enumerate(text.split("\n"), 1):
        row = raw.strip()
        if row.startswith("#"):
            continue
        m = _PO_LINE.match(row)
        if not m:
            if not row:
                close()
                field = ""
            continue
        if m[1]:
            if (m[1] == "msgctxt" and parts) or (m[1] == "msgid" and ("msgid" in parts or any(f.startswith("msgstr") for f in parts))):
                close()
            field = m[1]
            parts[field], lines[field] = "", number
        if field:
            parts[field] += _unescaped(m[2])
    close()
    return out


def _unescaped(text: str) -> str:
    marks = {"n": "\n", "t": "\t", "r": "\r"}

    def one(m: re.Match) -> str:
        return chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else marks.get(m[1], m[1])

    return re.sub(r"\\([uU][0-9a-fA-F]{4}|.)", one, text)


_STRING = re.compile(r"<string\b([^>]*)>(.*?)</string>", re.S)
_GROUP = re.compile(r"<(plurals|string-array)\b([^>]*)>(.*?)</\1>", re.S)
_ITEM = re.compile(r"<item\b([^>]*)>(.*?)</item>", re.S)


def _attribute(attrs: str, name: str) -> str:
    m = re.search(rf'\b{name}\s*=\s*"([^"]*)"', attrs)
    return m[1] if m else ""


def _android(value: str) -> str:
    value = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", value, flags=re.S).strip()
    if len(value) >= 2 and value[0] == value[-1] == '"':
        value = value[1:-1]
    return _unescaped(unescape(value))


def android_entries(text: str) -> list[Entry]:
    """Strings, plurals and arrays that are translatable."""
    blank = re.sub(r"<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    out = []
    for m in _STRING.finditer(blank):
        if _attribute(m[1], "translatable") != "false":
            out.append((_attribute(m[1], "name"), _android(m[2]), blank.count("\n", 0, m.start()) + 1))
    for g in _GROUP.finditer(blank):
        if _attribute(g[2], "translatable") == "false":
            continue
        for i, m in enumerate(_ITEM.finditer(g[3])):
            part = _attribute(m[1], "quantity") or str(i)
            out.append((f"{_attribute(g[2], 'name')}[{part}]", _android(m[2]), blank.count("\n", 0, g.start(3) + m.start()) + 1))
    return sorted(out, key=lambda e: e[2])


def xliff_entries(text: str) -> list[Entry]:
    """Targets, or sources without one, by unit id."""
    out = []
    for m in re.finditer(r"<(trans-unit|unit)\b([^>]*)>(.*?)</\1>", text, re.S):
        for tag in ("target", "source"):
            found = re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}>", m[3], re.S)
            if found and found[1].strip():
                plain = unescape(re.sub(r"<[^>]+>", "", found[1])).strip()
                out.append((_attribute(m[2], "id"), plain, text.count("\n", 0, m.start(3) + found.start(1)) + 1))
                break
    return out


def xml_entries(text: str) -> list[Entry]:
    """Text nodes with letters of any other XML file."""
    out = []
    for m in re.finditer(r">([^<>]+)<", text):
        value = unescape(m[1]).strip()
        if any(c.isalpha() for c in value):
            out.append((f"text{len(out)}", value, text.count("\n", 0, m.start(1)) + 1))
    return out


def strings_entries(text: str) -> list[Entry]:
    """``"key" = "value";`` pairs outside comments."""
    blank = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    pairs = re.finditer(r'^\s*"((?:[^"\\]|\\.)*)"\s*=\s*"((?:[^"\\]|\\.)*)"\s*;', blank, re.M)
    return [(_unescaped(m[1]), _unescaped(m[2]), blank.count("\n", 0, m.start(1)) + 1) for m in pairs]


def entries(path: str, text: str) -> list[Entry]:
    """By extension; XML by its root element. Files that do not parse have no entries."""
    name = path.lower()
    try:
        if name.endswith((".json", ".arb")):
            return json_entries(text)
        if name.endswith((".po", ".pot")):
            return po_entries(text)
        if name.endswith(".strings"):
            return strings_entries(text)
        if name.endswith((".xlf", ".xliff")) or "<xliff" in text[:2000]:
            return xliff_entries(text)
        if "<resources" in text[:2000]:
            return android_entries(text)
        return xml_entries(text) if name.endswith(".xml") else []
    except (ValueError, RecursionError):
        return []


def units(docs: DataFrame) -> DataFrame:
    """doc_id, unit_key, value, line of documents (doc_id, path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, v, n) for d, p, t in zip(batch["doc_id"], batch["path"], batch["text"], strict=True) for k, v, n in entries(p, t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "unit_key", "value", "line"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "path", "text").mapInPandas(run, f"doc_id {kind}, unit_key string, value string, line long")
