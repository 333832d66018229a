"""From documents to lines, sentences, words, n-grams, paragraphs, cells and quote blocks.

``structured`` keeps a document's lines and sentences as arrays of small
structs in its own row, so rules about order, runs and neighbours need no
shuffle: an array's order is the text's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let
from ..rules import english, persian
from ..rules.english import SENTENCE_ABBREVIATIONS, WORD
from .mask import BLOCK, SOFT, read_prose

def clean(text: Column) -> Column:
    """Without byte-order marks, with line feeds only."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("﻿"), F.lit("")), "\r\n?", "\n")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (1-based), text."""
    return docs.select("doc_id", F.posexplode(F.split(clean(F.col("text")), "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line"), "text")


def _english_border() -> str:
    """White space behind a sentence's end: not behind a listed abbreviation or a single capital."""
    closing = r"[\"'’”)\]*_]{0,4}"
    guarded = "|".join(a.replace(".", r"\.") for a in SENTENCE_ABBREVIATIONS)
    # Cheap tests come first: most places are no white space, most white space follows a letter.
    return rf"(?=[ \t])(?<=[.!?\"'’”)\]*_])(?<=[.!?]{closing})(?<!(?<![A-Za-z.])(?i:{guarded})\.{closing})(?<!(?<![A-Za-z.])[A-Z]\.{closing})[ \t]+|{BLOCK}+"


ENGLISH_BORDER = _english_border()
PERSIAN_BORDER = rf"(?=\s)(?<=[.؟!؛?](?:\*\*|__|[*_»)]|»\*\*|\*\*»)?)[^\S\n]+|{BLOCK}+"
PERSIAN_WORD = f"(?U){persian.WORD}"


#: Stands for a sentence's end.  Spark compiles the pattern of a split for every value, but that of a replacement once:
#: so ends are replaced in a whole text, and only this character is split at.
_END = "\x02"
_SOMETHING = f"[^ \t{SOFT}{BLOCK}]"


def with_ends(text: Column, border: str = ENGLISH_BORDER) -> Column:
    return F.regexp_replace(text, border, _END)


def _parted(text: Column) -> Column:
    return F.filter(F.split(text, _END), lambda s: s.rlike(_SOMETHING))


def sentence_array(line: Column, border: str = ENGLISH_BORDER) -> Column:
    """Sentences of one line."""
    return _parted(with_ends(line, border))


def cells_of(line: Column) -> Column:
    """A table row's cells that are not empty; an escaped pipe parts nothing."""
    return F.filter(F.transform(F.split(line, r"(?<!\\)\|"), lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t\r]+$", "")), lambda c: c != "")


def _tag(text: Column, language: str, kind: str) -> Column:
    """What a line is: blank, skipped, heading, cell, item or prose."""
    skipped = F.ltrim(text).startswith("#") if language == "fa" else F.ltrim(text).startswith("#") & text.rlike(english.TAG_LINE)
    tag = F.when(~text.rlike(_SOMETHING) | (F.contains(text, F.lit("|")) & text.rlike(english.TABLE_SEPARATOR)), "blank")
    if kind == "md" and language == "en":
        tag = tag.when(text.rlike(english.HEADING), "heading")
    marked = F.regexp_extract(text, english.LIST_LEAD, 1) != ""
    return tag.when(skipped, "skipped").when(F.ltrim(text).startswith("|"), "cell").when(marked, "item").otherwise("prose")


def structured(docs: DataFrame, language: str = "en", kind: str = "text") -> DataFrame:
    """doc_id, raw, body, lines (line, text, tag, n), sents (line, tag, text, n, first) of every document.

    ``body`` is the text with what is not prose masked; ``n`` counts words; sentences have one or more.
    """
    word, border = (WORD, ENGLISH_BORDER) if language == "en" else (PERSIAN_WORD, PERSIAN_BORDER)
    rows = docs.select("doc_id", clean(F.col("text")).alias("raw"))
    rows = rows.select("doc_id", "raw", read_prose(F.col("raw"), kind).alias("body"))
    both = F.zip_with(F.split("body", "\n"), F.split(with_ends(F.col("body"), border), "\n"), lambda t, m: F.struct(t.alias("text"), m.alias("ended")))
    tagged = F.transform(both, lambda x, i: F.struct((i + 1).alias("line"), x["text"].alias("text"), _tag(x["text"], language, kind).alias("tag"), x["ended"].alias("ended")))
    rows = rows.select("doc_id", "raw", "body", tagged.alias("tagged"))
    # A list mark may end like a sentence.
    lead, heading = (p.replace(r"[ \t]", rf"[ \t{_END}]") for p in (english.LIST_LEAD, english.HEADING))

    def pieces(ln: Column) -> Column:
        whole = F.array(F.when(ln["tag"] == "heading", F.regexp_replace(ln["ended"], heading, "")).otherwise(F.regexp_replace(ln["ended"], lead, "")))
        return F.when(ln["tag"].isin("blank", "skipped"), F.array().cast("array<string>")).when(ln["tag"] == "cell", cells_of(ln["ended"])).otherwise(whole)

    def sentences_of(ln: Column) -> Column:
        parts = F.flatten(F.transform(pieces(ln), _parted))
        made = F.transform(parts, lambda s: F.struct(ln["line"].alias("line"), ln["tag"].alias("tag"), s.alias("text"), F.regexp_count(s, F.lit(word)).alias("n"), F.regexp_extract(s, word, 0).alias("first")))
        return F.filter(made, lambda s: s["n"] > 0)

    lines_ = F.transform("tagged", lambda ln: F.struct(ln["line"].alias("line"), ln["text"].alias("text"), ln["tag"].alias("tag")))
    return rows.select("doc_id", "raw", "body", lines_.alias("lines"), F.flatten(F.transform("tagged", sentences_of)).alias("sents"))


def sentences(docs: DataFrame, language: str = "en", kind: str = "text") -> DataFrame:
    """doc_id, line, ord (within the document), tag, text, n_words."""
    rows = structured(docs, language, kind).select("doc_id", F.posexplode("sents").alias("pos", "s"))
    return rows.select("doc_id", F.col("s.line").alias("line"), (F.col("pos") + 1).alias("ord"), F.col("s.tag").alias("tag"), F.col("s.text").alias("text"), F.col("s.n").cast("long").alias("n_words"))


def words(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all(clean(F.col("text")), F.lit(WORD), F.lit(0))).alias("pos", "word"))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of an array without null tokens; a null (a masked token) breaks them.

    Shifted copies are joined pairwise, so the work is linear in the array.
    """
    out = tokens
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(out, lambda g: g.isNotNull())


_PARAGRAPH = "struct<first:int,n:bigint>"


def paragraph_array(lines_: Column) -> Column:
    """first (line), n (words) of the paragraphs of tagged lines: runs of prose, ended by blank lines and all that is no prose.

    Lines come with their own word counts, and a fold carries the paragraph that is open.
    """
    start = F.struct(F.lit(None).cast("int").alias("first"), F.lit(0).cast("bigint").alias("n"), F.array().cast(f"array<{_PARAGRAPH}>").alias("out"))
    closed = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), s["n"].alias("n")).cast(_PARAGRAPH)))).otherwise(s["out"])

    def step(s: Column, ln: Column) -> Column:
        prose = ln["tag"] == "prose"
        first = F.when(prose, F.coalesce(s["first"], F.when(ln["n"] > 0, ln["line"])))
        return F.struct(first.alias("first"), F.when(prose, s["n"] + ln["n"]).otherwise(0).cast("bigint").alias("n"), F.when(prose, s["out"]).otherwise(closed(s)).alias("out"))

    return F.aggregate(lines_, start, step, closed)


def counted_lines(lines_: Column, word: str = WORD) -> Column:
    """Tagged lines with their words, list marks left out."""
    return F.transform(lines_, lambda ln: F.struct(ln["line"].alias("line"), ln["tag"].alias("tag"), F.regexp_count(F.regexp_replace(ln["text"], english.LIST_LEAD, ""), F.lit(word)).cast("bigint").alias("n")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), first_line, n_words: runs of prose lines."""
    rows = structured(docs).select("doc_id", F.posexplode(paragraph_array(counted_lines(F.col("lines")))).alias("paragraph", "p"))
    return rows.select("doc_id", "paragraph", F.col("p.first").alias("first_line"), F.col("p.n").alias("n_words"))


def run_starts(keys: Column, least: int) -> Column:
    """Indices (from 0) at which runs of ``least`` or more equal keys start; a null belongs to no run."""
    return let(keys, lambda all_: _starts(all_, least))


def _starts(keys: Column, least: int) -> Column:
    def starts(i: Column) -> Column:
        own = F.get(keys, i)
        goes_on = own.isNotNull()
        for k in range(1, least):
            goes_on = goes_on & (F.get(keys, i + k) == own)
        return F.coalesce(goes_on & ((i == 0) | ~F.coalesce(F.get(keys, i - 1) == own, F.lit(False))), F.lit(False))

    places = F.when(F.size(keys) >= least, F.sequence(F.lit(0), F.size(keys) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, starts)


def runs(rows: DataFrame, key: list[str], order: str, least: int) -> DataFrame:
    """Maximal runs of consecutive ``order`` values within a key: first, last, n."""
    at = Window.partitionBy(*key).orderBy(order)
    island = rows.withColumn("__island", F.col(order) - F.row_number().over(at))
    return island.groupBy(*key, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("__island")


def quote_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, first, last, n of maximal runs of ``>`` lines."""
    return runs(lines(docs).where(F.col("text").rlike(english.QUOTE_LINE)), ["doc_id"], "line", 1)


def table_cells(docs: DataFrame) -> DataFrame:
    """doc_id, line, pos, cell of pipe-led table rows; separator rows are skipped."""
    rows = lines(docs).where(F.col("text").rlike(r"^[ \t]*\|") & ~F.col("text").rlike(english.TABLE_SEPARATOR))
    return rows.select("doc_id", "line", F.posexplode(cells_of(F.col("text"))).alias("pos", "cell"))
