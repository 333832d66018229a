"""Persian document rules: registers, address, chains of particles, rhythm and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.persian import ADDRESS_SHOMA, ADDRESS_TO, LETTERS, SUMMARY_HEADING, ZWNJ
from . import segment
from .findings import Settings
from .structure import (
    EMOJI,
    EMOJI_GATE,
    FOUND,
    NONE,
    caption_headers,
    count_in,
    document_findings,
    each,
    emoji_bullets,
    flat_rhythm_spread,
    found,
    long_sentences,
    marks_over,
    of_tag,
    own_lines,
    same_opening_triples,
    whole,
)

_LZ = f"[{LETTERS}{ZWNJ}]"
_NOT_AFTER, _NOT_BEFORE = f"(?<!{_LZ})", f"(?!{_LZ})"

# ---- Fixed values: marks of the colloquial and the formal register. ----
COLLOQUIAL = rf"{_NOT_AFTER}ن?می‌?(?:شه|کنه|خوام|ره|گه|دونم|تونی){_NOT_BEFORE}|{_NOT_AFTER}(?:ب?کنین|اون|اگه|رو){_NOT_BEFORE}|خونه|زمستون|خوشمزه‌?ست"
FORMAL = rf"{_NOT_AFTER}ن?می‌?(?:شود|کند|خواهم|رود|گوید|دانم|توانی){_NOT_BEFORE}|{_NOT_AFTER}(?:کنید|است|اگر){_NOT_BEFORE}|خانه{_NOT_BEFORE}|زمستان"
# ---- Fixed values: words around the pronoun of address. ----
PRONOUN_NEXT = "را رو هم که خودت عزیز جان جون تنها باید".split()
PRONOUN_AFTER = "به با برای واسه مثل مال پیش کنار عاشق همراه جای بدون بی منتظر مخصوص".split()
PRONOUN_LINKS = "هم که خودت".split()
_QUOTED = "«[^«»\n]*»"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def address_pattern(form: str) -> str:
    """The forms of one address: its words, its suffix behind a half space, and for the familiar one its pronoun where it is no place."""
    if form == "shoma":
        return rf"{_NOT_AFTER}{_any(ADDRESS_SHOMA)}{_NOT_BEFORE}|(?<=[{LETTERS}]){ZWNJ}(?:تان|تون){_NOT_BEFORE}"
    gap = f"[^{LETTERS}{ZWNJ}]{{1,30}}"
    verb = _any([w for w in ADDRESS_TO if w != "بده"])
    before = rf"(?<={_NOT_AFTER}{_any(PRONOUN_AFTER)}{gap})"
    behind = rf"(?=[\s{ZWNJ}]{{0,60}}(?:$|[،؛.!؟?:»)\]]))|(?={gap}(?:{_any(PRONOUN_NEXT)}|{verb}){_NOT_BEFORE})|(?={gap}{_any(PRONOUN_LINKS)}{_NOT_BEFORE}{gap}{verb}{_NOT_BEFORE})"
    pronoun = rf"{_NOT_AFTER}تو{_NOT_BEFORE}"
    return rf"{_NOT_AFTER}{_any(ADDRESS_TO)}{_NOT_BEFORE}|(?<=[{LETTERS}]){ZWNJ}ت{_NOT_BEFORE}|{before}{pronoun}|{pronoun}(?:{behind})"


ADDRESS = {form: address_pattern(form) for form in ("to", "shoma")}


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, line, ord, tag, text, n_words."""
    return segment.sentences(docs, "fa")


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, _QUOTED, "")


def marks(text: Column, pattern: str) -> Column:
    """The distinct marks of a register outside quotations, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_unquoted(text), F.lit(pattern), F.lit(0))))


def registers(docs: DataFrame) -> DataFrame:
    """doc_id, colloquial, formal: distinct marks of both registers outside quotations."""
    text = segment.clean(F.col("text"))
    return docs.select("doc_id", marks(text, COLLOQUIAL).alias("colloquial"), marks(text, FORMAL).alias("formal"))


def register_rule(own: Column, register: str = "any") -> Column:
    """Marks of the other register, or of both where any will do."""
    body = F.array_join(F.transform(own, lambda ln: ln["text"]), "\n")
    colloquial, formal = _unquoted(body).rlike(COLLOQUIAL), _unquoted(body).rlike(FORMAL)
    if register == "formal":
        return whole(colloquial, "register")
    if register == "colloquial":
        return F.concat(whole(formal, "register"))
    return whole(colloquial & formal, "mixed-register")


def address_rule(lines: Column, want: str) -> Column:
    """One finding a line that addresses the reader in the other form, outside quotations."""
    if want not in ADDRESS:
        return NONE().cast(FOUND)
    other = ADDRESS["to" if want == "shoma" else "shoma"]
    return each(F.filter(lines, lambda ln: _unquoted(ln["text"]).rlike(other)), "address")


def address_forms(text: Column, form: str, most: int = 4) -> Column:
    """The distinct forms of an address in a text, in order of first use."""
    return F.slice(F.array_distinct(F.regexp_extract_all(_unquoted(text), F.lit(ADDRESS[form]), F.lit(0))), 1, most)


def chains(sents: Column) -> Column:
    """Sentences with three or more ``ke``, and with two or more ``ra``."""
    ke = F.filter(sents, lambda s: count_in(s["text"], rf"{_NOT_AFTER}که{_NOT_BEFORE}") >= 3)
    ra = F.filter(sents, lambda s: count_in(s["text"], rf"{_NOT_AFTER}را{_NOT_BEFORE}") >= 2)
    return F.concat(each(ke, "ke-chain"), each(ra, "ra-chain"))


def rhetorical_opening(sents: Column) -> Column:
    first = F.get(of_tag(sents, "prose"), F.lit(0))
    return F.when(F.coalesce(F.rtrim(first["text"]).endswith("؟"), F.lit(False)), F.array(found(first["line"], "rhetorical-open"))).otherwise(NONE()).cast(FOUND)


def persian_rules(settings: Settings) -> list[Column]:
    """All document rules of a structured row."""
    lines, sents, own = F.col("lines"), F.col("sents"), F.col("own")
    parts = [
        long_sentences(sents, settings.max_words, "long-sentence"), chains(sents), same_opening_triples(sents), flat_rhythm_spread(sents), rhetorical_opening(sents),
        register_rule(own, settings.register), address_rule(lines, settings.address), emoji_bullets(lines, LETTERS), each(F.filter(lines, lambda ln: ln["text"].rlike(SUMMARY_HEADING)), "final-word"),
        marks_over(own, "[!！]", settings.exclaim_max, "bangs"), marks_over(own, EMOJI, settings.emoji_max, "emoji", EMOJI_GATE),
    ]
    return parts + ([caption_headers(lines, "caption-header")] if settings.format == "caption" else [])


def persian_document_findings(docs: DataFrame, settings: Settings = Settings(max_words=24)) -> DataFrame:
    """doc_id, line, code, severity of all document rules of texts with Persian letters: one scan of the texts."""
    rows = segment.structured(docs.where(F.col("text").rlike(f"[{LETTERS}]")), "fa", settings.kind)
    return document_findings(rows.withColumn("own", own_lines(F.col("lines"), settings.kind)), persian_rules(settings))


def file_findings(units: DataFrame, settings: Settings) -> DataFrame:
    """Register and address over all values of a file together: units have doc_id, line, value; address findings keep their lines."""
    whole_file = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line").cast("int").alias("line"), F.col("value").alias("text")))).alias("lines"))
    return document_findings(whole_file.withColumn("own", F.col("lines")), [register_rule(F.col("own"), settings.register), address_rule(F.col("lines"), settings.address)])
