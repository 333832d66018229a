"""Small text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.english import AI_STEMS

PLACEHOLDER = r"\[[^\[\]\n]{1,120}\](?!\()"
#: Words of both scripts before and after normalising.
_ARABIC, _PERSIAN = "يىك٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "ییک01234567890123456789"


def placeholders(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PLACEHOLDER)).cast("long")


def persian_normal(text: Column) -> Column:
    """Persian letters and Latin digits for Arabic ones, without vowel marks, joiners and repeated spaces."""
    plain = F.regexp_replace(F.translate(text, _ARABIC, _PERSIAN), r"[\x{064B}-\x{0655}\x{0670}\x{0640}\x{200D}]", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def slug(title: Column) -> Column:
    """A heading's anchor: lower case, without marks, spaces as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"(?U)[^\w\- ]", ""), " ", "-")


def truncated(text: Column, chars: int, mark: str = " …") -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars - len(mark)), F.lit(mark))).otherwise(text)


def like_case(word: Column, pattern: Column) -> Column:
    """A word in the case of another: all capitals, a first capital, or as it is."""
    first = F.substring(pattern, 1, 1)
    return F.when((F.length(pattern) > 1) & (F.upper(pattern) == pattern), F.upper(word)).when(F.upper(first) == first, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)


def lemma(word: Column) -> Column:
    """A crude stem: the listed stem that a word begins with, else the word without common endings, seven letters at most."""
    listed = F.regexp_extract(F.lower(word), f"^({'|'.join(AI_STEMS)})", 1)
    return F.when(listed != "", listed).otherwise(F.substring(F.regexp_replace(F.lower(word), "(?:ing|ed|es|s|ly|ment)$", ""), 1, 7))


def percent_encoded(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def percent_decoded(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def excerpt(text: Column, start: Column, end: Column, around: int = 15) -> Column:
    first = F.greatest(F.lit(1), start + 1 - around)
    return F.substring(text, first, end + around - first + 1)


def number_normal(value: Column) -> Column:
    """A number without thousands marks, zeros in front, and zeros behind the point."""
    plain = F.replace(F.translate(value, _ARABIC + "٬٫", _PERSIAN + ",."), F.lit(","), F.lit(""))
    tail = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "[.]$", "")).otherwise(plain)
    bare = F.regexp_replace(tail, "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def quote_normal(value: Column) -> Column:
    """A quotation in lower case with plain marks and single spaces, without marks around it."""
    plain = F.regexp_replace(F.translate(value, "“”‘’", "\"\"''"), r"(?U)\s+", " ")
    return F.lower(F.regexp_replace(plain, r"^[ \"'.,;:!?]+|[ \"'.,;:!?]+$", ""))


def half_up(value: Column, places: int = 2) -> Column:
    """A decimal rounded half up."""
    unit = 10**places
    return F.floor(value.cast("decimal(38,12)") * unit + F.lit("0.5").cast("decimal(2,1)")) / unit


def pointer(keys: Column) -> Column:
    """A path of keys as a JSON pointer."""
    return F.concat(F.lit("/"), F.array_join(F.transform(keys, lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), "/"))
