"""Mixed-language documents, resource units and masked tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lengths
from ..functions.text import PLACEHOLDER
from ..rules.persian import LETTERS
from . import findings, mask, persian_structure, segment, structure

#: Share of letters from which a document is of one language.
CLEAR = 0.8


def without_ignored(text: Column) -> Column:
    """Lines of ignored blocks are empty, their markers too; the number of lines stays."""

    @F.arrow_udf("string")
    def drop(texts: pa.Array) -> pa.Array:
        return pa.array([_dropped(t) for t in texts.to_pylist()], pa.string())

    marked = F.contains(text, F.lit("lint-ignore"))
    return F.when(marked, drop(F.when(marked, text))).otherwise(text)


def _dropped(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b in mask.ignored(text):
        out += [text[at:a], "\n" * text.count("\n", a, b)]
        at = b
    return "".join([*out, text[at:]])


def without_names(text: Column, names: list[str]) -> Column:
    """Without a profile's Latin names, which do not decide the language."""
    if not names:
        return text
    return F.regexp_replace(text, r"(?iU)\b(?:" + "|".join(rf"\Q{n}\E" for n in names) + r")\b", "")


def _own(text: Column, names: list[str], whole: Column) -> Column:
    """A stretch's own language; that of the document where its letters tie or are none."""
    body = without_names(text, names)
    fa, en = lengths.persian_letters(body), lengths.latin_letters(body)
    return F.when(fa > en, "fa").when(en > fa, "en").otherwise(whole)


def with_languages(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """doc_id, whole (fa or en: the majority where mixed), lines (line, text, language): all in the document's row."""
    body = segment.clean(F.col("text"))
    counted = docs.select("doc_id", body.alias("body"), lengths.persian_letters(without_names(body, names or [])).alias("fa"), lengths.latin_letters(without_names(body, names or [])).alias("en"))
    decided = lengths.language(F.col("fa"), F.col("en"))
    rows = counted.select("doc_id", "body", F.when(decided == "mixed", F.when(F.col("fa") >= F.col("en"), "fa").otherwise("en")).otherwise(decided).alias("whole"))
    lines = F.transform(F.split("body", "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), _own(t, names or [], F.col("whole")).alias("language")))
    return rows.select("doc_id", "whole", lines.alias("lines"))


def line_languages(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """doc_id, line, text, language."""
    return with_languages(docs, names).select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.*")


def split_documents(docs: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The Persian and the English halves: the other language's lines, and in table rows its cells, are blank, so places keep their numbers."""
    rows = with_languages(docs, names)

    def half(language: str) -> DataFrame:
        def cells(ln: Column) -> Column:
            kept = F.transform(F.split(ln["text"], r"(?<!\\)\|"), lambda c: F.when((F.trim(c) == "") | (_own(c, names or [], ln["language"]) == language), c).otherwise(F.repeat(F.lit(" "), F.length(c))))
            return F.array_join(kept, "|")

        kept = F.transform("lines", lambda ln: F.when(F.ltrim(ln["text"]).startswith("|"), cells(ln)).when(ln["language"] == language, ln["text"]).otherwise(""))
        return rows.select("doc_id", F.array_join(kept, "\n").alias("text"))

    return half("fa"), half("en")


def mixed_findings(docs: DataFrame, settings: findings.Settings = findings.Settings()) -> DataFrame:
    """Findings of both languages' halves, with their language, in the order of places."""
    persian, english = split_documents(docs)
    a = findings.persian_findings(persian, settings).withColumn("language", F.lit("fa"))
    b = findings.english_findings(english, settings).withColumn("language", F.lit("en"))
    return findings.merged_order(a.unionByName(b))


def merged_stats(stats: DataFrame) -> DataFrame:
    """Per document the counts of both languages added, averages weighted by their sentences."""
    return stats.groupBy("doc_id").agg(F.sum("n_sentences").alias("n_sentences"), F.sum("n_words").alias("n_words"), (F.sum(F.col("avg_words") * F.col("n_sentences")) / F.sum("n_sentences")).alias("avg_words"), F.max("max_words").alias("max_words"))


def unit_findings(units: DataFrame, settings: findings.Settings = findings.Settings()) -> DataFrame:
    """Findings of resource values (doc_id, unit_key, value, line): file lines, columns within the value."""
    keyed = units.withColumn("__id", F.xxhash64("doc_id", "unit_key", "line"))
    values = keyed.select(F.col("__id").alias("doc_id"), masked_value(F.col("value")).alias("text"))
    english = findings.english_findings(values, settings)
    persian = findings.persian_findings(values, settings)
    found = english.unionByName(persian).withColumnRenamed("doc_id", "__id").withColumnRenamed("line", "value_line")
    rows = found.join(keyed.select("__id", "doc_id", "unit_key", F.col("line").alias("file_line")), "__id")
    return rows.select("doc_id", "unit_key", (F.col("file_line") + F.col("value_line") - 1).alias("line"), "col", "code", "severity", "text")


def file_mixes(units: DataFrame) -> DataFrame:
    """Mixes over all values of a file: spellings and quotation marks."""
    files = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), F.col("value").alias("text")))).alias("lines"))
    rows = files.withColumn("body", F.array_join(F.transform("lines", lambda ln: ln["text"]), "\n"))
    return structure.document_findings(rows, [structure.spelling_mix(F.col("lines"), F.col("body")), structure.quote_mix(F.col("lines"))])


def file_registers(units: DataFrame, settings: findings.Settings) -> DataFrame:
    """Register and address over all values of a file."""
    return persian_structure.file_findings(units, settings)


# ---- Fixed values: what stands for something else in a resource value. ----
_VALUE_MARK = r"%(?:\d+\$)?[-+ 0#]*\d*(?:\.\d+)?[sdifgxXc@u%]|\$t\([^()\n]{0,200}\)|&[A-Za-z]+;|&#\d+;|\$\{[^{}\n]*\}|\{\{[^{}\n]*\}\}"
_CHOICES = ("plural", "select", "selectordinal")


class _Message:
    """A resource message with arguments in braces, read once from left to right."""

    def __init__(self, value: str):
        self.value = value
        self.out = list(value)

    def _cover(self, a: int, b: int, mark: str = mask.SOFT) -> None:
        for k in range(a, b):
            if self.out[k] != "\n":
                self.out[k] = mark

    def read(self) -> str:
        """Arguments are masked; the branches of a choice stay, each ended like a sentence, and their number signs go."""
        value = self.value
        open_: list[tuple[str, int]] = []  # "choice", "branch", "number" or "plain", and where it began
        i = 0
        while i < len(value):
            inside = open_[-1][0] if open_ else ""
            c = value[i]
            if c == "{" and inside == "choice":
                self.out[i] = mask.BLOCK
                open_.append(("number" if self._kind(open_[-1][1]) != "select" else "branch", i))
            elif c == "{":
                kind = self._kind(i)
                end = value.find("{", i + 1) if kind in _CHOICES else -1
                open_.append(("choice" if kind in _CHOICES else "plain", i))
                if end > 0:
                    self._cover(i, end)
                    i = end
                    continue
            elif c == "}" and open_:
                kind, begun = open_.pop()
                if kind in ("branch", "number"):
                    self.out[i] = mask.BLOCK
                elif kind == "choice":
                    self._cover(i, i + 1)
                else:
                    self._cover(begun, i + 1)
            elif inside == "choice" or (c == "#" and inside == "number"):
                self._cover(i, i + 1)
            i += 1
        return "".join(self.out)

    def _kind(self, at: int) -> str:
        head = self.value[at + 1 : at + 200].split("{")[0].split("}")[0].split(",")
        return head[1].strip() if len(head) > 1 else ""


def masked_message(value: str | None) -> str | None:
    """A resource value of the same length without links, tags, marks and arguments."""
    import regex

    if not value:
        return value
    text = mask.masked(value.replace("{", "\x01").replace("}", "\x02")).replace("\x01", "{").replace("\x02", "}")
    text = regex.sub(_VALUE_MARK, lambda m: mask.SOFT * len(m[0]), text)
    return _Message(text).read() if "{" in text else text


def masked_value(value: Column) -> Column:
    @F.arrow_udf("string")
    def read(values: pa.Array) -> pa.Array:
        return pa.array([masked_message(v) for v in values.to_pylist()], pa.string())

    gate = value.rlike(mask.GATE + "|[%&$]")
    return F.when(gate, read(F.when(gate, value))).otherwise(value)


def masked_tokens(text: Column, language: str) -> Column:
    """Tokens for phrase statistics; links, addresses, tags, numbers, acronyms and (in English) names are null."""
    mark = "\x01"
    body = F.regexp_replace(F.translate(text, "يىك", "ییک"), r"(?iU)(?:https?://|www\.)\S+|\S+@\S+\.\S+|[@#]\S+|\S*\d\S*", f" {mark} ")
    raw = F.regexp_extract_all(body, F.lit(rf"{mark}|[\p{{L}}]+(?:[\x{{200C}}'’-][\p{{L}}]+)*"), F.lit(0))
    if language == "en":
        low = F.filter(raw, lambda t: ~t.rlike("^[A-Z]"))
        hidden = lambda t: (t == mark) | ((F.length(t) > 1) & (F.upper(t) == t)) | (t.rlike("^[A-Z]") & ~F.array_contains(low, F.lower(t)))
        return F.transform(raw, lambda t: F.when(~hidden(t), F.lower(t)))
    return F.transform(raw, lambda t: F.when(t != mark, t))


def coverage(docs: DataFrame) -> DataFrame:
    """doc_id, placeholders, persian_share of every document."""
    text = segment.clean(F.col("text"))
    return docs.select("doc_id", F.regexp_count(text, F.lit(PLACEHOLDER)).cast("long").alias("placeholders"), lengths.persian_ratio(F.regexp_count(text, F.lit(f"[{LETTERS}]")), F.regexp_count(text, F.lit("[A-Za-z]"))).alias("persian_share"))
