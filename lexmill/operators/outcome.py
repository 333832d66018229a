"""Draft against final text: aligned sentences and tokens, held-out and kept findings, placebo positions, fixers.

A case is measured in one Arrow row: aligning two texts has no counterpart in
Spark's functions, and its size is bounded by the refusals that come first.
"""

from __future__ import annotations

import difflib
import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mask

_TOKEN = regex.compile(r"[^\W_]+(?:[‌'’\-][^\W_]+)*")
_END = regex.compile(r"(?<=[.!?؟])[ \t]+|\n+")
#: Limits of one case, budgets, and shares of checks that are held out.
MAX_CHARS, MAX_TOKENS, MAX_BLOCK, SESSION_BUDGET, WEEK_BUDGET = 20_000, 4_000, 300, 3, 20
HOLDOUT = {"warning": 10, "error": 5}
FORMAT_GROUPS = {
    "short": "caption story reels carousel post sms push ad headline subject name bot reply".split(),
    "long": "email landing about blog press deck script product listing".split(),
    "ui": "ui error otp hard".split(),
}
GROUP_OF = {name: group for group, names in FORMAT_GROUPS.items() for name in names}


def normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(normal(text))


def sentence_list(text: str) -> list[str]:
    return [s for s in map(normal, _END.split(unicodedata.normalize("NFKC", text))) if s]


def refusal(shown: str | None, final: str, in_session: int = 0, in_week: int = 0) -> str | None:
    """Why a case is not measured, in the order of the reasons; None if it is."""
    if shown is None:
        return "unlinted"
    if shown == final:
        return "unchanged"
    if in_session >= SESSION_BUDGET:
        return "session_budget"
    if in_week >= WEEK_BUDGET:
        return "week_budget"
    return "too_long" if any(len(t) > MAX_CHARS or len(tokens(t)) > MAX_TOKENS for t in (shown, final)) else None


def held_out(salt: bytes, epoch: str, language: str, check: str, severity: str, locked: bool = False) -> bool:
    """Whether a check is measured without being shown: locked ones never, shadow ones always."""
    rate = 0 if locked else 100 if severity == "shadow" else HOLDOUT["error" if severity == "error" else "warning"]
    digest = hashlib.sha256(salt + b"measure" + f"{epoch}{language}{check}".encode()).digest()
    return int.from_bytes(digest[:4], "big") % 100 < rate


def placebo_places(salt: bytes, sentence: str, covered: set[int]) -> list[int]:
    """Up to two token pairs outside findings, chosen by a salted hash of the sentence, not next to each other."""
    free = [j for j in range(len(tokens(sentence)) - 1) if j not in covered and j + 1 not in covered]
    digest = hashlib.sha256(salt + sentence.encode()).digest()
    out: list[int] = []
    for part in (digest[:4], digest[4:8]):
        left = [j for j in free if all(abs(j - k) >= 2 for k in out)]
        if left:
            out.append(left[int.from_bytes(part, "big") % len(left)])
    return out


def half_up(part: int, total: int, places: int = 2) -> float:
    """part / total rounded half up, in whole numbers."""
    unit = 10**places
    return (2 * unit * part + total) // (2 * total) / unit


@dataclass
class Finding:
    check: str
    sentence: int | None
    first: int = 0
    last: int = 0


@dataclass
class Case:
    """Both texts with their findings, and the checks by id: severity and whether locked."""

    shown: str | None
    final: str
    language: str = "en"
    epoch: str = "1970-W01"
    salt: bytes = b""
    in_session: int = 0
    in_week: int = 0
    shown_findings: tuple[Finding, ...] = ()
    final_findings: tuple[Finding, ...] = ()
    checks: tuple[tuple[str, str, bool], ...] = ()


def _inside(findings: tuple[Finding, ...], check: str, sentences: range) -> int:
    return sum(f.check == check and f.sentence is not None and f.sentence in sentences for f in findings)


def measure(case: Case) -> dict:
    """What becomes of a case: its refusal, or edit ratio, token counts, held-out and kept findings, and placebo counts.

    Unequal stretches of sentences are aligned token by token, if both sides
    are of bounded size.  In them, a held-out check gains a hit for every
    finding that the final side has less, and a placebo pair one if it is gone.
    """
    why = refusal(case.shown, case.final, case.in_session, case.in_week)
    out = {"reason": why, "er": None, "ta": 0, "td": 0, "fe": 0, "pl_n": 0, "pl_g": 0, "cells": []}
    if why:
        return out
    shown, final = sentence_list(case.shown), sentence_list(case.final)
    a, b = [tokens(s) for s in shown], [tokens(s) for s in final]
    hidden = {check: held_out(case.salt, case.epoch, case.language, check, severity, locked) for check, severity, locked in case.checks}
    held, gained = Counter(), Counter()
    matched = 0
    for kind, i, j, k, m in difflib.SequenceMatcher(None, shown, final, autojunk=False).get_opcodes():
        left, right = [t for s in a[i:j] for t in s], [t for s in b[k:m] for t in s]
        if kind == "equal":
            matched += len(left)
            continue
        out["td"] += len(left)
        if kind != "replace" or max(len(left), len(right)) > MAX_BLOCK:
            continue
        same = sum(x.size for x in difflib.SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks())
        matched += same
        out["td"] -= same
        for check, is_hidden in hidden.items():
            if is_hidden and (n := _inside(case.shown_findings, check, range(i, j))):
                held[check] += n
                gained[check] += max(0, n - _inside(case.final_findings, check, range(k, m)))
        pairs = {p for s in b[k:m] for p in zip(s, s[1:], strict=False)}
        for s in range(i, j):
            covered = {t for f in case.shown_findings if f.sentence == s for t in range(f.first, f.last)}
            for place in placebo_places(case.salt, shown[s], covered):
                out["pl_n"] += 1
                out["pl_g"] += (a[s][place], a[s][place + 1]) not in pairs
    total = sum(map(len, a)) + sum(map(len, b))
    out["er"] = half_up(total - 2 * matched, total) if total else 0.0
    out["ta"] = sum(map(len, a))
    for check, severity, _ in sorted(case.checks):
        kept = 0 if hidden[check] else sum(f.check == check for f in case.final_findings)
        out["fe"] += kept if severity == "error" else 0
        if held[check] or kept:
            out["cells"].append({"id": check, "kept": kept, "ho": held[check], "hg": gained[check]})
    return out


_MEASURED = T.StructType(
    [
        T.StructField("reason", T.StringType()),
        T.StructField("er", T.DoubleType()),
        *(T.StructField(c, T.LongType()) for c in ("ta", "td", "fe", "pl_n", "pl_g")),
        T.StructField("cells", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("kept", "ho", "hg"))]))),
    ]
)
_OPTIONAL = {"lang": "en", "epoch": "1970-W01", "salt": b"", "in_session": 0, "in_week": 0}


def _case(row: dict) -> Case:
    found = lambda name: tuple(Finding(f["id"], f["s"], f["a"], f["b"]) for f in row.get(name) or ())
    own = {k: row[k] if row.get(k) is not None else default for k, default in _OPTIONAL.items()}
    checks = tuple((c["id"], c["severity"], bool(c["locked"])) for c in row.get("checks") or ())
    return Case(row["shown"], row["final"] or "", own["lang"], own["epoch"], bytes(own["salt"]), own["in_session"], own["in_week"], found("shown_findings"), found("final_findings"), checks)


def outcome_cases(cases: DataFrame) -> DataFrame:
    """case_id and the measures of every case.

    cases: case_id, shown, final, and if known lang, epoch, salt, in_session,
    in_week, checks (id, severity, locked), shown_findings and final_findings
    (id, s, a, b: sentence and token range).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(_case(row)) for row in batch.to_pylist()]
            made = pa.Table.from_pylist(rows, pa.schema([(f.name, kinds[f.name]) for f in _MEASURED])).combine_chunks()
            columns = [made.column(f.name).combine_chunks() if len(rows) else pa.array([], kinds[f.name]) for f in _MEASURED]
            yield pa.RecordBatch.from_arrays([batch.column("case_id"), *columns], names=["case_id", *_MEASURED.names])

    cell = pa.struct([("id", pa.string()), ("kept", pa.int64()), ("ho", pa.int64()), ("hg", pa.int64())])
    kinds = {"reason": pa.string(), "er": pa.float64(), "cells": pa.list_(cell)} | {c: pa.int64() for c in ("ta", "td", "fe", "pl_n", "pl_g")}
    return cases.mapInArrow(run, T.StructType([cases.schema["case_id"], *_MEASURED.fields]))


def format_group(format_: Column) -> Column:
    """short, long, ui or none."""
    out = F.when(format_.isin([*FORMAT_GROUPS, "none"]), format_)
    for group, names in FORMAT_GROUPS.items():
        out = out.when(F.lower(F.trim(format_)).isin(names), group)
    return out.otherwise("none")


def bucket(value: float, width: float) -> int:
    """The number of a value's bucket, exactly."""
    return int(Fraction(repr(value)) / Fraction(repr(width)) // 1)


def mined_ngrams(pairs: DataFrame, longest: int = 4, language: str = "en") -> DataFrame:
    """case_id, ng, deleted, kept: how often each n-gram of the shown text is gone or kept in the final text.

    Masked tokens (names, numbers, links) are in none.
    """
    from .mixed import masked_tokens
    from .segment import ngrams

    def counted(c: str, n: str) -> DataFrame:
        tokens_ = masked_tokens(F.coalesce(F.col(c), F.lit("")), language)
        grams = F.flatten(F.array(*(ngrams(tokens_, k) for k in range(1, longest + 1))))
        return pairs.select("case_id", F.explode(grams).alias("ng")).groupBy("case_id", "ng").agg(F.count(F.lit(1)).alias(n))

    both = counted("shown", "n").join(counted("final", "m"), ["case_id", "ng"], "left").withColumn("kept", F.least("n", F.coalesce("m", F.lit(0))))
    return both.select("case_id", "ng", (F.col("n") - F.col("kept")).alias("deleted"), "kept")


def rewritten(text: Column, change, kind: str = "text") -> Column:
    """A text with ``change`` applied to what is not protected."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _outside(t, change, kind) for t in texts.to_pylist()], pa.string())

    return run(text)


def _outside(text: str, change, kind: str) -> str:
    out, at = [], 0
    for a, b, _ in mask.protected(text, kind)[0]:
        out += [change(text[at:a]), text[a:b]]
        at = b
    return "".join([*out, change(text[at:])])


def _curly(text: str) -> str:
    """Straight marks as curly ones: opening before a word that stands behind a space or a bracket."""
    text = regex.sub(r"(?<=^|[\s(\[“‘—–-])\"(?=\S)", "“", text)
    text = regex.sub(r"(?<=^|[\s(\[“‘—–-])'(?=\S)", "‘", text)
    return text.replace('"', "”").replace("'", "’")


def _straight(text: str) -> str:
    return regex.sub("[“”]", '"', regex.sub("[‘’]", "'", text))


def fix_quotes(text: Column, to: str = "curly") -> Column:
    return rewritten(text, _curly if to == "curly" else _straight)


def fix_spelling(text: Column, variant: str) -> Column:
    """Words in a variant's spelling, in their own case."""
    from .findings import spelled_as

    def own(m) -> str:
        from ..rules.english import SPELLING_FORMS

        word = m[0]
        to = spelled_as(word, variant) if word.lower() in SPELLING_FORMS else None
        if to is None:
            return word
        return to.upper() if word.isupper() else to.capitalize() if word[0].isupper() else to

    return rewritten(text, lambda part: regex.sub(r"(?<![A-Za-z'’\-])[A-Za-z]+(?![A-Za-z'’\-])", own, part))


def fix_english(text: Column) -> Column:
    """Mechanical rewrites outside protected text: one space after a full stop, closed em dashes, bare heading ends.

    Fixing twice changes nothing more.
    """
    protected = r"`[^`\n]*`|(?:https?://|www\.)\S+|<[^<>\n]*>"
    text = F.regexp_replace(text, rf"({protected})|(?<=[.?!:])  +(?=[^\s|])", "$1\x01")
    text = F.regexp_replace(text, "(?<=[.?!:])\x01(?=[^\\s|])", " ")
    text = F.replace(text, F.lit("\x01"), F.lit(""))
    text = F.regexp_replace(text, r"(?<=\S)[ \t]+—[ \t]+(?=\S)|(?<=\w) -- (?=\w)", "—")
    return F.regexp_replace(text, r"(?m)^([ \t]{0,3}#{1,6}[ \t]+\S.*?)(?<![.:])[.:][ \t]*$", "$1")


def fix_persian(text: Column) -> Column:
    """Persian letters for Arabic ones, Persian marks after Persian letters, half spaces at affixes."""
    from ..rules.persian import LETTERS

    text = F.translate(text, "يىك", "ییک")
    letter = f"[{LETTERS}]"
    text = F.regexp_replace(text, rf"(?<={letter})[ \t]*,(?![0-9])", "،")
    text = F.regexp_replace(text, rf"(?<={letter});", "؛")
    text = F.regexp_replace(text, rf"(?<={letter})[ \t]*\?(?![A-Za-z0-9=&])", "؟")
    text = F.regexp_replace(text, rf"(?<!{letter})(ن?می) (?={letter}{{2,}})", "$1‌")
    return F.regexp_replace(text, rf"(?<={letter}) (ها|های|هایی|تر|ترین)(?!{letter})", "‌$1")
