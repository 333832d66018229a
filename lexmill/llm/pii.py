r"""Personal data by patterns, checksums and context, in DataFrame functions only.

Each kind has a pattern that proposes spans, a validator on the matched
text (digit counts, octets, Luhn, mod-97) and a score that words shortly
before the span raise; in a list of such spans, parted by separators only, the
words before the first count for all.  The patterns are written so that a search is linear
in the text: possessive runs, and look-behinds that let a match start only
where a left-most search could (``\G`` is the end of the match before).

Spans are in code points, half open.  Null and empty texts have none;
repeated rows are read each for itself, and columns beside ``text`` are not
read, so their names may clash.  The work is linear in a text, whatever the
number of its spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import BLOCK, before_each, let
from .common import text_or_empty

#: Code points before a span in which context words count.
CONTEXT_CHARS = 40
#: Spans of the kinds beyond the base ones need this score.
MIN_SCORE = 0.6


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    back = F.reverse(_digits(hit))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(back, i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an account number passes the ISO 7064 mod 97-10 check."""
    plain = F.regexp_replace(hit, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        char = F.substring(moved, i, F.lit(1))
        code = F.ascii(char)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    gate: str
    score: float
    context: str
    base: bool


#: In the order in which spans with one start are listed.
KINDS = (
    Kind(
        "email",
        rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda hit: F.lit(True),
        "@[A-Za-z0-9-]",
        0.9,
        "mail|contact|kontakt|correo|courriel|write to",
        True,
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda hit: F.coalesce(hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), F.lit(False)),
        r"[0-9]\.[0-9]",
        0.7,
        r"\bip\b|address|host|server|login",
        True,
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
        luhn,
        "[0-9](?:[ -]?[0-9]){13}",
        0.8,
        "card|karte|carte|tarjeta|visa|credit|payment",
        True,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda hit: F.length(_digits(hit)).between(10, 15),
        r"\+[0-9]",
        0.7,
        "phone|call|tel|mobil|fax|whatsapp|llam",
        True,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}+(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        mod97,
        r"[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}",
        0.8,
        "iban|account|konto|compte|cuenta",
        False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda hit: F.lit(True),
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        0.4,
        r"\bssn\b|social security|tax ?(?:id|number)",
        False,
    ),
    Kind(
        "secret",
        r"(?i)(?<![A-Za-z0-9_])(?:(?:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?\"?[A-Za-z0-9/+_.~-]{8,}+\"?|AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))",
        lambda hit: hit.rlike("[0-9]"),
        "(?i)(?:password|passwd|pwd|secret|token|key)[ ]?[=:]|AKIA[0-9A-Z]{16}",
        0.7,
        "key|login|credential|access",
        False,
    ),
)

#: What may stand between the spans of a list.
_LISTED = r"^[\s,;:/|&.()-]{0,8}(?:(?:and|or|und|oder|et|ou|y|o)[\s,;:]{1,4})?$"
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


_PLACE = "struct<size:int,tail:string>"
_NAMED = "struct<named:boolean,listed:boolean>"


def _tail(*parts: Column) -> Column:
    return F.substring(F.concat(*parts), -CONTEXT_CHARS, CONTEXT_CHARS)


def _go_on(a: Column, b: Column) -> Column:
    """The size and the last characters of two stretches of text."""
    return F.struct((a["size"] + b["size"]).alias("size"), F.when(F.length(b["tail"]) >= CONTEXT_CHARS, b["tail"]).otherwise(_tail(a["tail"], b["tail"])).alias("tail"))


def _name_on(a: Column, b: Column) -> Column:
    """Whether spans are named, and whether they are one list with what stands before them."""
    return F.struct((b["named"] | (b["listed"] & a["named"])).alias("named"), (a["listed"] & b["listed"]).alias("listed"))


def _placed(kind: Kind, rank: int, text: Column) -> Column:
    """Valid spans of one kind in text order: positions and contexts come from the pieces between the matches."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(hits, F.slice(pieces, 1, F.size(hits)), lambda hit, before: F.struct(hit.alias("hit"), before.alias("before")))

    def with_context(all_: Column) -> Column:
        stretches = F.transform(all_, lambda p: F.struct((F.length(p["before"]) + F.length(p["hit"])).alias("size"), _tail(p["before"], p["hit"]).alias("tail")).cast(_PLACE))
        ahead = before_each(stretches, F.struct(F.lit(0).alias("size"), F.lit("").alias("tail")), _PLACE, _go_on)
        return F.zip_with(
            all_,
            ahead,
            lambda p, a: F.struct(
                (a["size"] + F.length(p["before"])).alias("start"),
                p["hit"].alias("hit"),
                F.struct(_tail(a["tail"], p["before"]).rlike(f"(?i)(?:{kind.context})").alias("named"), p["before"].rlike(f"(?i){_LISTED}").alias("listed")).cast(_NAMED).alias("own"),
            ),
        )

    def spans(found: Column) -> Column:
        ahead = before_each(F.transform(found, lambda f: f["own"]), F.struct(F.lit(False).alias("named"), F.lit(True).alias("listed")), _NAMED, _name_on)
        scored = F.zip_with(
            found,
            ahead,
            lambda f, a: F.struct(
                f["start"].alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind.name).alias("kind"),
                (f["start"] + F.length(f["hit"])).alias("end"),
                F.least(F.lit(1.0), F.lit(kind.score) + F.when(_name_on(a, f["own"])["named"], F.lit(0.3)).otherwise(F.lit(0.0))).alias("score"),
                f["hit"].alias("hit"),
            ),
        )
        good = F.filter(scored, lambda s: kind.valid(s["hit"]) if kind.base else kind.valid(s["hit"]) & (s["score"] >= MIN_SCORE))
        return F.transform(good, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "kind", "end", "score"))))

    return F.when(text.rlike(kind.gate), let(let(pairs, with_context), spans)).otherwise(F.array()).cast(_SPAN)


def with_spans(docs: DataFrame, name: str = "pii") -> DataFrame:
    """The input columns and an array of spans (start, rank, kind, end, score), by start and kind."""
    text = text_or_empty()
    found = F.array_sort(F.concat(*(_placed(kind, rank, text) for rank, kind in enumerate(KINDS))))
    any_kind = text.rlike("[0-9@=:]")
    return docs.withColumn(name, F.when(any_kind, found).otherwise(F.array()).cast(_SPAN))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans listed."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    base = [k.name for k in KINDS if k.base]
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(listed(F.filter("pii", lambda s: s["rank"] < len(base))), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The input rows with every span replaced by a mark of its kind; of overlapping spans the first names it."""
    found = with_spans(docs, "__pii")
    text = F.col("text")

    def marked(spans: Column) -> Column:
        reach = before_each(F.transform(spans, lambda s: s["end"]), F.lit(0), "int", lambda a, b: F.greatest(a, b))
        placed = F.zip_with(spans, reach, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        return let(F.filter(placed, lambda s: s["start"] >= s["at"]), pieces)

    def pieces(fresh: Column) -> Column:
        # The text is cut into stretches of many spans first, and these at their spans.
        last = F.floor((F.size(fresh) - 1) / BLOCK).cast("int")

        def stretch(k: Column) -> Column:
            own = F.slice(fresh, k * BLOCK + 1, BLOCK)
            first = F.element_at(own, 1)["at"]
            part = F.substring(text, first + 1, F.element_at(own, -1)["start"] - first)
            return let(part, lambda p: F.transform(own, lambda s: F.concat(F.substring(p, s["at"] - first + 1, s["start"] - s["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), last), stretch)), "")

    end = F.array_max(F.transform("__pii", lambda s: s["end"]))
    clean = F.concat(marked(F.col("__pii")), F.substring(text, end + 1, F.length(text)))
    return found.withColumn("text", F.when(F.size("__pii") > 0, clean).otherwise(text)).select(*docs.columns)
