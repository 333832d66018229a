r"""License scan with ordered signature rules, in DataFrame functions only.

A rule is a regular expression with a priority and a strength; rules belong
to families with a keyword and a name.  A prefilter on keywords at word
starts passes few texts; there the rules of those families are tried whose
keyword and name occur.  Detections are
ordered by start, longer ones first, then higher priority; one that lies
inside the furthest-reaching detection kept before it is suppressed unless
its priority is higher.

The base phrases are counted apart, as places where their words stand
consecutively, whatever separates the words.

Null and empty texts have no words, no detections and score 0; repeated rows
are read each for itself, and columns beside ``doc_id`` and ``text`` are not
read, so their names may clash.  The work is linear in a text, whatever the
number of its detections.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import before_each, let, total_before_each
from .common import text_or_empty

_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Base phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License families as (label, keyword, name pattern, versions).
FAMILIES = (
    ("gpl", "gpl", r"(?:gnu\W{1,3})?gpl", "1.0 2.0 3.0"),
    ("gpl", "general public", r"(?:gnu\W{1,3})?general\W{1,3}public\W{1,3}licen[cs]e", "1.0 2.0 3.0"),
    ("lgpl", "lgpl", r"(?:gnu\W{1,3})?lgpl", "2.0 2.1 3.0"),
    ("lgpl", "lesser general", r"(?:gnu\W{1,3})?lesser\W{1,3}general\W{1,3}public\W{1,3}licen[cs]e", "2.0 2.1 3.0"),
    ("agpl", "agpl", r"(?:gnu\W{1,3})?agpl", "1.0 3.0"),
    ("agpl", "affero", r"(?:gnu\W{1,3})?affero\W{1,3}general\W{1,3}public\W{1,3}licen[cs]e", "1.0 3.0"),
    ("gfdl", "free documentation", r"(?:gnu\W{1,3})?free\W{1,3}documentation\W{1,3}licen[cs]e", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache(?:\W{1,3}software)?(?:\W{1,3}licen[cs]e)?", "1.0 1.1 2.0"),
    ("mit", "mit", r"(?:the\W{1,3})?(?:mit|expat)\W{1,3}licen[cs]e", ""),
    ("bsd", "bsd", r"bsd(?:\W{1,3}licen[cs]e)?", "0-clause 1-clause 2-clause 3-clause 4-clause"),
    ("isc", "isc", r"isc\W{1,3}licen[cs]e", ""),
    ("mpl", "mpl", r"mpl", "1.0 1.1 2.0"),
    ("mpl", "mozilla", r"mozilla\W{1,3}public\W{1,3}licen[cs]e", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse\W{1,3}public\W{1,3}licen[cs]e", "1.0 2.0"),
    ("cddl", "common development", r"common\W{1,3}development\W{1,3}and\W{1,3}distribution\W{1,3}licen[cs]e", "1.0 1.1"),
    ("cpl", "common public", r"common\W{1,3}public\W{1,3}licen[cs]e", "1.0"),
    ("eupl", "european union", r"european\W{1,3}union\W{1,3}public\W{1,3}licen[cs]e", "1.0 1.1 1.2"),
    ("artistic", "artistic", r"artistic\W{1,3}licen[cs]e", "1.0 2.0"),
    ("bsl", "boost", r"boost\W{1,3}software\W{1,3}licen[cs]e", "1.0"),
    ("zlib", "zlib", r"zlib\W{1,3}licen[cs]e", ""),
    ("unlicense", "unlicense", r"(?:the\W{1,3})?unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", "1 2"),
    ("ofl", "open font", r"(?:sil\W{1,3})?open\W{1,3}font\W{1,3}licen[cs]e", "1.0 1.1"),
    ("osl", "open software", r"open\W{1,3}software\W{1,3}licen[cs]e", "1.0 2.0 2.1 3.0"),
    ("ms-pl", "microsoft public", r"microsoft\W{1,3}public\W{1,3}licen[cs]e", ""),
    ("psf", "python", r"python\W{1,3}(?:software\W{1,3}foundation\W{1,3})?licen[cs]e", "2"),
    ("odbl", "open database", r"open\W{1,3}database\W{1,3}licen[cs]e", "1.0"),
    ("cc0", "cc0", r"cc0", "1.0"),
    *((f"cc-{terms}", "cc", rf"cc\W{{1,3}}{terms.replace('-', r'\W{1,3}')}", "1.0 2.0 2.5 3.0 4.0") for terms in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")),
    *(
        (f"cc-{terms}", "commons", r"creative\W{1,3}commons\W{1,3}" + name, "1.0 2.0 2.5 3.0 4.0")
        for terms, name in (
            ("by", r"attribution"),
            ("by-sa", r"attribution\W{1,3}share\W?alike"),
            ("by-nd", r"attribution\W{1,3}no\W?deriv(?:ative)?s"),
            ("by-nc", r"attribution\W{1,3}non\W?commercial"),
            ("by-nc-sa", r"attribution\W{1,3}non\W?commercial\W{1,3}share\W?alike"),
            ("by-nc-nd", r"attribution\W{1,3}non\W?commercial\W{1,3}no\W?deriv(?:ative)?s"),
        )
    ),
    ("public-domain", "public domain", r"(?:released|placed|dedicated)\W{1,3}(?:in)?to\W{1,3}the\W{1,3}public\W{1,3}domain", ""),
    ("proprietary", "all rights reserved", r"all\W{1,3}rights\W{1,3}reserved", ""),
    # Identifiers that are words of another kind elsewhere, on an SPDX line.
    *(
        (label, "spdx", rf"{name}(?<=spdx\W{{1,3}}licen[cs]e\W{{1,3}}identifier\W[^\r\n]{{0,200}})", versions)
        for label, name, versions in (
            ("mit", "mit(?:-0)?", ""),
            ("isc", "isc", ""),
            ("zlib", "zlib", ""),
            ("bsd-0-clause", "0bsd", ""),
            ("epl", "epl", "1.0 2.0"),
            ("cddl", "cddl", "1.0 1.1"),
            ("cpl", "cpl", "1.0"),
            ("eupl", "eupl", "1.0 1.1 1.2"),
            ("artistic", "artistic", "1.0 2.0"),
            ("bsl", "bsl", "1.0"),
            ("ofl", "ofl", "1.0 1.1"),
            ("osl", "osl", "1.0 2.0 2.1 3.0"),
            ("ms-pl", "ms-pl", ""),
            ("psf", "(?:psf|python)", "2"),
            ("odbl", "odbl", "1.0"),
            ("gfdl", "gfdl", "1.1 1.2 1.3"),
        )
    ),
)

# A license's own wording as (label, keyword, words); any short separator may stand between words.
WORDINGS = (
    ("mit", "hereby granted", r"permission is hereby granted free of charge(?!\W{1,8}to\W{1,8}any\W{1,8}person\W{1,8}or\W)"),
    ("bsl", "hereby granted", r"permission is hereby granted free of charge to any person or organization"),
    ("isc", "hereby granted", r"permission to use copy modify (?:and\W{1,8}(?:or\W{1,8})?)?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution binary", r"redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither endorse", r"neither the names? of [^.]{0,200}?may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    *((f"gpl-{v}", "general public", rf"gnu general public licen[cs]e as published by the free software foundation (?:either\W{{1,8}})?version {v[0]}(?:\.0)?") for v in ("1.0", "2.0", "3.0")),
    *((f"lgpl-{v}", "lesser general", rf"gnu lesser general public licen[cs]e as published by the free software foundation (?:either\W{{1,8}})?version {n}") for v, n in (("2.1", r"2\.1"), ("3.0", r"3(?:\.0)?"))),
    *((f"agpl-{v}", "affero", rf"gnu affero general public licen[cs]e as published by the free software foundation (?:either\W{{1,8}})?version {v[0]}(?:\.0)?") for v in ("1.0", "3.0")),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("zlib", "express implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what want", r"do what the f\W?u\W?c\W?k you want to public licen[cs]e"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    family: int
    pattern: str
    priority: int
    strength: float


def rules() -> list[Rule]:
    """Every family's rules, most specific first: a declared version, a version, a declared name, a name."""
    out = []
    lead = r"(?:licen[cs]ed|released|distributed|available|published)\W{1,3}(?:under|subject\W{1,3}to)\W{1,3}(?:the\W{1,3}|a\W{1,3})?(?:terms\W{1,3}of\W{1,3}the\W{1,3})?"
    edge = EDGE
    for family, (label, _, name, versions) in enumerate(FAMILIES):
        for version in versions.split():
            number = version.split("-")[0]
            short = re_number(number)
            if "clause" in version:
                forms = [rf"{short}\W{{0,2}}clause\W{{1,3}}{name}", rf"{name}\W{{1,3}}{short}\W{{0,2}}clause"]
            else:
                # Short forms have the number or a v right after the name, except where that could end in a digit.
                gap = "1" if label == "cc0" else "0"
                forms = [rf"{name}(?:\W{{1,3}}licen[cs]e)?(?:\W{{1,3}}version\W{{0,3}}|\W{{0,3}}v\W{{0,2}}|\W{{{gap},3}}){short}(?:\W{{1,2}}(?:or\W{{1,3}}later|only))?"]
            for form in forms:
                out.append(Rule(f"{label}-{version}", family, rf"(?i)(?<![0-9A-Za-z]){lead}{form}(?![0-9A-Za-z]|\.[0-9])", 4, 1.0))
                out.append(Rule(f"{label}-{version}", family, rf"(?i)(?<![0-9A-Za-z]){form}(?![0-9A-Za-z]|\.[0-9])", 3, 0.9))
        out.append(Rule(label, family, rf"(?i)(?<![0-9A-Za-z]){lead}{name}{edge}", 2, 0.8))
        out.append(Rule(label, family, rf"(?i)(?<![0-9A-Za-z]){name}{edge}", 1, 0.5))
    for family, (label, _, words) in enumerate(WORDINGS, len(FAMILIES)):
        out.append(Rule(label, family, rf"(?i)(?<![0-9A-Za-z]){worded(words)}{edge}", 3, 0.9))
    return out


def re_number(number: str) -> str:
    """A version number, whose trailing ``.0`` may be missing."""
    head, _, tail = number.partition(".")
    return head + (r"(?:\.0)?" if tail == "0" else rf"\.{tail}" if tail else "")


def worded(words: str) -> str:
    """A wording with any short separator between its words: it is wrapped, often inside comments."""
    return words.replace(" ", r"\W{1,8}")


#: After a name no letter or digit stands, but a version may.
EDGE = r"(?![0-9A-Za-z])"
_SHORT_EDGE = r"(?:(?![0-9A-Za-z])|(?=v?\W{0,2}[0-9]))"
RULES = rules()
#: Keywords that are words of their own kind elsewhere need what follows them.
_NARROW = {"mit": r"(?:mit|expat)\W{1,3}licen", "cc": r"cc\W{1,3}by", "python": r"python\W{1,3}(?:licen|soft)", "commons": r"creative\W{1,3}commons", "bsd": r"(?:bsd|[0-4]\W{0,2}clause)", "spdx": r"spdx\W{1,3}licen"}
_KEYWORD_GATE = r"(?i)(?<![0-9A-Za-z])(?:" + "|".join(sorted({_NARROW.get(f[1], f[1].split()[0]) for f in FAMILIES} | {_NARROW["mit"], "gnu", "apache", rf"cc{_BREAK}+by", rf"mit{_BREAK}+licen", *(" ".join(w[2].split()[:2]).replace(" ", r"\W{1,8}") for w in WORDINGS)})) + ")"
_HIT = "array<struct<start:int,neg_end:int,neg_priority:int,end:int,priority:int,label:string,strength:double>>"


def count_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"{_WORD}++"), F.lit(0))).cast("long")


def _phrase(phrase: str) -> str:
    return f"(?i)(?<!{_WORD})" + f"{_BREAK}++".join(phrase.split()) + f"(?!{_WORD})"


def _base(text: Column) -> Column:
    """For every base phrase: places, first and last word."""
    out = []
    for phrase, label in BASE_PHRASES.items():
        pattern, size = _phrase(phrase), len(phrase.split())
        counts = F.transform(F.split(text, pattern, -1), count_words)
        places = F.size(counts) - 1
        last = F.aggregate(F.slice(counts, 1, places), F.lit(0).cast("long"), lambda a, b: a + b) + (places - 1) * size
        found = F.struct(F.lit(label).alias("label"), places.cast("long").alias("n"), F.element_at(counts, 1).alias("first"), last.alias("last"))
        out.append(F.when(text.rlike(pattern), found))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _detections(text: Column) -> Column:
    """Kept detections of the rules whose keywords occur."""
    low = F.lower(text)
    families = []
    for number, (_, keyword, name, *_) in enumerate((*FAMILIES, *((label, k, worded(w)) for label, k, w in WORDINGS))):
        own = F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.strength).alias("strength")) for r in RULES if r.family == number))
        # Every rule of a family holds the family's name.
        named = text.rlike(rf"(?i)(?<![0-9A-Za-z]){name}{_SHORT_EDGE}")
        if keyword not in ("mit", "bsd"):
            # Word by word: whatever separates a keyword's words in the text.
            named = reduce(and_, (F.contains(low, F.lit(word)) for word in keyword.split())) & named
        families.append(F.when(named, own))
    tried = F.flatten(F.filter(F.array(*families), lambda f: f.isNotNull()))

    def places(rule: Column) -> Column:
        pairs = F.zip_with(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.split(text, rule["pattern"], -1), lambda hit, before: F.struct(hit.alias("hit"), before.alias("before")))

        def placed(all_: Column) -> Column:
            size = lambda p: F.length(p["before"]) + F.length(p["hit"])
            return F.zip_with(
                all_,
                total_before_each(F.transform(all_, size)),
                lambda p, at: F.struct((at + F.length(p["before"])).alias("start"), (-at - size(p)).alias("neg_end"), (-rule["priority"]).alias("neg_priority"), (at + size(p)).alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["strength"].alias("strength")),
            )

        return let(F.filter(pairs, lambda p: p["hit"].isNotNull()), placed)

    def kept(hits: Column) -> Column:
        reach = "struct<end:int,priority:int>"
        furthest = before_each(
            F.transform(hits, lambda h: F.struct(h["end"].alias("end"), h["priority"].alias("priority")).cast(reach)), F.struct(F.lit(-1).alias("end"), F.lit(0).alias("priority")), reach, lambda a, b: F.when(b["end"] > a["end"], b).otherwise(a)
        )
        pairs = F.zip_with(hits, furthest, lambda h, f: F.struct(h.alias("hit"), ((h["end"] <= f["end"]) & (h["priority"] <= f["priority"])).alias("inside")))
        return F.transform(F.filter(pairs, lambda p: ~p["inside"]), lambda p: p["hit"])

    return let(F.array_sort(F.flatten(F.transform(tried, places))), kept)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and kept detections (start, end, priority, label, strength) of every text."""
    text = text_or_empty()
    gate = text.rlike(_KEYWORD_GATE)
    base = F.when(gate, _base(text)).otherwise(F.array()).cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>")
    hits = F.when(gate, _detections(text)).otherwise(F.array()).cast(_HIT)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), count_words(text).alias("n_words"), base.alias("base"), hits.alias("detections"))


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    total = F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    base_labels = F.transform("base", lambda b: b["label"])
    strengths = F.concat(F.transform("detections", lambda d: d["strength"]), F.transform("base", lambda b: F.lit(0.5)), F.array(F.lit(0.0)))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        total.alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        join(base_labels).alias("base_labels"),
        join(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.array_max(strengths).alias("score"),
    )
