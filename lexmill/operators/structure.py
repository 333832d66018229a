"""Document rules over lines, sentences and words: counts, runs, densities and mixes.

Every rule is an expression on the arrays of ``segment.structured`` and gives
an array of findings (line, code, severity); document-level ones have line 0.
All rules of a document are one projection of its row: one scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lengths
from ..functions.spans import let, total_before_each
from ..functions.text import lemma, like_case
from ..rules import english
from . import segment
from .findings import Settings, spelled_as

FOUND = "array<struct<line:bigint,code:string,severity:string>>"
NONE = F.array


def found(line: Column, code: str, severity: str = "warning") -> Column:
    return F.struct(line.cast("bigint").alias("line"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def each(rows: Column, code: str, severity: str = "warning", line: Callable[[Column], Column] = lambda r: r["line"]) -> Column:
    """A finding for each row of an array."""
    return F.transform(rows, lambda r: found(line(r), code, severity)).cast(FOUND)


def whole(condition: Column, code: str, severity: str = "warning", line: Column | None = None) -> Column:
    """One finding if a condition holds, of the document or a line."""
    return F.when(condition, F.array(found(F.lit(0) if line is None else line, code, severity))).otherwise(NONE()).cast(FOUND)


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b)


def count_in(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def of_tag(sents: Column, *tags: str) -> Column:
    return F.filter(sents, lambda s: s["tag"].isin(*tags))


def total_words(sents: Column) -> Column:
    return summed(F.transform(sents, lambda s: s["n"]))


def own_lines(lines: Column, kind: str) -> Column:
    """Lines that are the author's own words: in Markdown not those of block quotes."""
    return F.filter(lines, lambda ln: ~ln["text"].rlike(english.QUOTE_LINE)) if kind == "md" else lines


def marks_of(lines: Column, pattern: str) -> Column:
    return summed(F.transform(lines, lambda ln: count_in(ln["text"], pattern)))


def long_sentences(sents: Column, cap: int, code: str = "en-long-sentence") -> Column:
    return each(F.filter(sents, lambda s: s["n"] > cap), code)


def numeral_starts(sents: Column) -> Column:
    """Sentences of running text that start with a numeral that is not a year."""
    number = lambda s: F.regexp_extract(s["text"], english.NUMERAL_START, 1)
    return each(F.filter(of_tag(sents, "prose"), lambda s: (number(s) != "") & ~number(s).rlike(english.YEAR)), "en-numeral-start")


def rhetorical_opening(sents: Column) -> Column:
    first = F.get(of_tag(sents, "prose"), F.lit(0))
    return whole(F.coalesce(first["text"].rlike(f"(?iU){english.RHETORICAL}"), F.lit(False)), "en-rhetorical-open", line=first["line"])


def _opening(s: Column, fold: bool) -> Column:
    """A sentence's first word, where sentences follow one another: in prose, and in items of three words or more that are not only a link."""
    item = (s["tag"] == "item") & (s["n"] >= 3)
    if fold:
        item = item & ~s["text"].rlike(english.LINK_ONLY)
    return F.when((s["tag"] == "prose") | item, F.lower(s["first"]) if fold else s["first"])


def same_opening(sents: Column) -> Column:
    """One finding for each run of three or more sentences with one first word."""
    starts = segment.run_starts(F.transform(sents, lambda s: _opening(s, True)), 3)
    return F.transform(starts, lambda i: found(F.get(sents, i)["line"], "en-same-opening")).cast(FOUND)


def same_opening_triples(sents: Column) -> Column:
    """The Persian form: every three consecutive sentences with one first word."""

    def triples(keys: Column) -> Column:
        places = F.when(F.size(keys) >= 3, F.sequence(F.lit(0), F.size(keys) - 3)).otherwise(F.array().cast("array<int>"))
        same = F.filter(places, lambda i: (F.get(keys, i) == F.get(keys, i + 1)) & (F.get(keys, i) == F.get(keys, i + 2)))
        return F.transform(same, lambda i: found(F.get(sents, i)["line"], "same-opening"))

    return let(F.transform(sents, lambda s: _opening(s, False)), triples).cast(FOUND)


def _rhythm(sents: Column) -> Column:
    return F.transform(of_tag(sents, "prose"), lambda s: s["n"].cast("bigint"))


def running_deviation(values: Column) -> Column:
    """The population standard deviation as SQL's ``stddev_pop`` finds it: in doubles, from running means in the order of the values."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1.0
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - s["mean"]) * (x - mean)).alias("squares"))

    return F.aggregate(F.transform(values, lambda x: x.cast("double")), start, step, lambda s: F.sqrt(F.when(s["n"] > 0, s["squares"] / s["n"])))


def flat_rhythm(sents: Column, deviation: Callable[[Column], Column] | None = None) -> Column:
    """Six sentences or more whose lengths deviate by less than three words (population).

    In whole numbers, n * sum of squares - square of sum < 9 n * n; a ``deviation`` in doubles may round
    exactly three to less.
    """
    size = lambda n: F.size(n).cast("bigint")
    exact = lambda n: size(n) * summed(F.transform(n, lambda x: x * x)) - summed(n) * summed(n) < 9 * size(n) * size(n)
    less = (lambda n: deviation(n) < 3) if deviation else exact
    return whole(let(_rhythm(sents), lambda n: (F.size(n) >= 6) & less(n)), "en-flat-rhythm")


def flat_rhythm_spread(sents: Column) -> Column:
    """The Persian form: five sentences or more within four words."""
    return whole(let(_rhythm(sents), lambda n: (F.size(n) >= 5) & (F.array_max(n) - F.array_min(n) <= 4)), "flat-rhythm")


def long_paragraphs(lines: Column, cap: int = 150) -> Column:
    return each(F.filter(segment.paragraph_array(segment.counted_lines(lines)), lambda p: p["n"] > cap), "en-long-paragraph", line=lambda p: p["first"])


def passive_density(sents: Column, most: int = 5) -> Column:
    """The first passive sentences of documents where over a fifth of five sentences or more are passive."""
    passive = F.filter(sents, lambda s: s["text"].rlike(f"(?iU){english.PASSIVE}"))
    return let(passive, lambda p: F.when((F.size(sents) >= 5) & (5 * F.size(p) > F.size(sents)), F.slice(each(p, "en-passive"), 1, most)).otherwise(NONE()).cast(FOUND))


def connectors(lines: Column, words: Column) -> Column:
    """Sentence-initial connectors, twice or more and over one in 200 words."""
    likely = F.filter(lines, lambda ln: F.contains(ln["text"], F.lit("ly,")) | F.contains(ln["text"], F.lit("ore,")) | F.contains(ln["text"], F.lit("over,")))
    hits = F.flatten(F.transform(likely, lambda ln: F.array_repeat(ln["line"], F.regexp_count(ln["text"], F.lit(f"(?U){english.ADDITIONALLY}")))))
    return let(hits, lambda h: F.when((F.size(h) >= 2) & (200 * F.size(h) > words), F.transform(h, lambda n: found(n, "en-additionally"))).otherwise(NONE()).cast(FOUND))


def dash_density(lines: Column, words: Column) -> Column:
    """Two em dashes or more in a paragraph, at the second; else two or more and over one in 150 words of the document."""
    counted = F.transform(lines, lambda ln: F.struct(ln["line"].alias("line"), (ln["tag"] == "blank").alias("blank"), count_in(ln["text"], "—").alias("n")))
    start = F.struct(F.lit(0).cast("bigint").alias("here"), F.lit(0).cast("bigint").alias("all"), F.lit(None).cast("int").alias("second"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, ln: Column) -> Column:
        here = F.when(ln["blank"], F.lit(0)).otherwise(s["here"]).cast("bigint")
        second = F.when((s["all"] < 2) & (s["all"] + ln["n"] >= 2), ln["line"]).otherwise(s["second"])
        out = F.when((here < 2) & (here + ln["n"] >= 2), F.concat(s["out"], F.array(ln["line"]))).otherwise(s["out"])
        return F.struct((here + ln["n"]).cast("bigint").alias("here"), (s["all"] + ln["n"]).cast("bigint").alias("all"), second.alias("second"), out.alias("out"))

    def flagged(s: Column) -> Column:
        sparse = F.when((s["all"] > 1) & (150 * s["all"] > words), F.array(s["second"])).otherwise(F.array().cast("array<int>"))
        return F.transform(F.when(F.size(s["out"]) > 0, s["out"]).otherwise(sparse), lambda n: found(n, "en-dash-density")).cast(FOUND)

    return let(F.aggregate(counted, start, step), flagged)


def bold_overuse(own: Column, words: Column) -> Column:
    return whole(let(marks_of(own, english.BOLD), lambda n: (n >= 2) & (100 * n > words)), "en-bold-overuse")


def inline_headers(lines: Column) -> Column:
    starts = segment.run_starts(F.transform(lines, lambda ln: F.when(ln["text"].rlike(f"(?U){english.INLINE_HEADER}"), F.lit(1))), 3)
    return F.transform(starts, lambda i: found(i + 1, "en-inline-header-bullets")).cast(FOUND)


def marks_over(own: Column, pattern: str, most: int, code: str, gate: str | None = None) -> Column:
    """Marks of a kind over a limit; a gate is a cheaper pattern of one character that every mark has."""
    lines = F.filter(own, lambda ln: ln["text"].rlike(gate)) if gate else own
    return whole(marks_of(lines, pattern) > most, code)


#: One emoji, with what joins it: flags, keycaps, skin tones and joined sequences count once. Java 17 has no emoji property, so blocks stand for it.
EMOJI_GATE = r"[\x{20E3}-\x{10FFFF}]"
EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|(?:[\x{231A}\x{231B}\x{23E9}-\x{23EC}\x{2614}\x{2615}\x{26A1}\x{2705}\x{2728}\x{274C}\x{2753}-\x{2757}\x{2764}\x{2795}-\x{2797}\x{2B50}\x{2B55}"
    r"\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F7E0}-\x{1F7EB}\x{1F90C}-\x{1F9FF}\x{1FA70}-\x{1FAFF}])(?:\x{FE0F}|[\x{1F3FB}-\x{1F3FF}])?(?:\x{200D}.\x{FE0F}?)*"
)


def quote_mix(lines: Column) -> Column:
    """Straight and curly marks in one text, at the first of the rarer kind."""
    counts = F.struct(marks_of(lines, "[\"']").alias("straight"), marks_of(lines, "[“”‘’]").alias("curly"))

    def mixed(n: Column) -> Column:
        first = lambda pattern: F.get(F.filter(lines, lambda ln: ln["text"].rlike(pattern)), F.lit(0))["line"]
        line = F.when(n["straight"] < n["curly"], first("[\"']")).otherwise(first("[“”‘’]"))
        return whole((n["straight"] > 0) & (n["curly"] > 0), "en-quote-mix", line=line)

    return let(counts, mixed)


_SEPARATE = r"(?<![A-Za-z'’\-]){}(?![A-Za-z'’\-])"
_INITIAL = r"(?m)(?:^[ \t]*(?:>[ \t]?)*(?:#{1,6}|[-*+•]|\d{1,3}[.)])?[ \t]*|[.!?:\"“‘'\x{E001}]\s*)([A-Z][A-Za-z]*)(?![A-Za-z'’\-])"


def spelled_words(body: Column) -> Column:
    """Lower-case words that show a spelling, in text order but for those that begin a sentence, which come last: other capitals are names."""
    low = F.regexp_extract_all(body, F.lit(_SEPARATE.format("[a-z]+")), F.lit(0))
    return F.concat(low, F.transform(F.regexp_extract_all(body, F.lit(_INITIAL), F.lit(1)), F.lower))


def _forms(side: str, *families: str, but: bool = False) -> Column:
    return F.array(*(F.lit(f) for f, (family, s, _) in english.SPELLING_FORMS.items() if s == side and (not families or (family in families) != but)))


def _spelling(body: Column, use: Callable[[Column], Column]) -> Column:
    """``use(words)`` on the listed forms of a text, or null if it has none: most texts fail one hashed intersection."""
    return let(F.array_intersect(spelled_words(body), F.array(*map(F.lit, english.SPELLING_FORMS))), lambda w: F.when(F.size(w) > 0, use(w)))


def spelling_mix(lines: Column, body: Column) -> Column:
    """US and UK evidence in one text, -ize and -ise forms, or both members of a pair; -ize alone is no US evidence."""
    ize = ("ize-ise", "yze-yse")
    other = F.create_map(*(F.lit(x) for f, (_, _, o) in english.SPELLING_FORMS.items() for x in (f, o)))

    def mixed(w: Column) -> Column:
        us, uk = F.arrays_overlap(w, _forms("us", *ize, but=True)), F.arrays_overlap(w, _forms("uk"))
        izes, ises = F.arrays_overlap(w, _forms("us", "ize-ise")), F.arrays_overlap(w, _forms("uk", "ize-ise"))
        pair = F.arrays_overlap(w, F.transform(w, lambda x: F.element_at(other, x)))
        british = F.array_intersect(w, _forms("uk"))
        line = F.get(F.filter(lines, lambda ln: F.arrays_overlap(F.regexp_extract_all(F.lower(ln["text"]), F.lit("[a-z]+"), F.lit(0)), F.when(F.size(british) > 0, british).otherwise(w))), F.lit(0))["line"]
        return whole((us & uk) | (izes & ises) | pair, "en-spelling-mix", "error", line=F.coalesce(line, F.lit(0)))

    return F.coalesce(_spelling(body, mixed), NONE().cast(FOUND))


def spelling_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, us, uk, ize, ise and the variant that the counts point to; documents without evidence have none."""
    rows = docs.select("doc_id", segment.read_prose(segment.clean(F.col("text"))).alias("body"))
    listed = F.array(*map(F.lit, english.SPELLING_FORMS))
    # One hashed intersection leaves the few forms that a text has; only these are looked for among its words.
    rows = rows.select("doc_id", spelled_words(F.col("body")).alias("all")).select("doc_id", "all", F.array_intersect("all", listed).alias("own"))
    rows = rows.select("doc_id", F.when(F.size("own") > 0, F.filter("all", lambda w: F.array_contains("own", w))).otherwise(F.array().cast("array<string>")).alias("w"))
    n = lambda forms: F.when(F.size("w") > 0, F.size(F.filter("w", lambda w: F.array_contains(forms, w)))).otherwise(0).cast("bigint")
    ize = ("ize-ise", "yze-yse")
    rows = rows.select("doc_id", n(_forms("us")).alias("us"), n(_forms("uk")).alias("uk"), n(_forms("us", "ize-ise")).alias("ize"), n(_forms("uk", "ize-ise")).alias("ise"), n(_forms("us", *ize, but=True)).alias("plain"))
    guess = F.when((F.col("uk") > 0) & (F.col("plain") == 0), F.when((F.col("ize") > 0) & (F.col("ise") == 0), "uk-ize").otherwise("uk")).when((F.col("us") > 0) & (F.col("uk") == 0), "us")
    return rows.select("doc_id", "us", "uk", "ize", "ise", guess.alias("variant"))


def spelling_hits(words: DataFrame) -> DataFrame:
    """doc_id, pos, word, family, side, counterpart: words joined with the forms (about 1,500, whatever the corpus)."""
    forms = words.sparkSession.createDataFrame([(w, *x) for w, x in english.SPELLING_FORMS.items()], "form string, family string, side string, counterpart string")
    return words.join(F.broadcast(forms), F.lower("word") == F.col("form")).drop("form")


def spelling_variants(words: DataFrame, target: str) -> DataFrame:
    """doc_id, pos, word, write: forms off a target of us, uk or uk-ize, which keeps -ize and both of -yze and -yse."""
    write = {f: t for f in english.SPELLING_FORMS if (t := spelled_as(f, target))}
    forms = words.sparkSession.createDataFrame(list(write.items()), "form string, to string")
    hits = words.join(F.broadcast(forms), F.lower("word") == F.col("form"))
    return hits.select("doc_id", "pos", "word", like_case(F.col("to"), F.col("word")).alias("write"))


def isbn_valid(number: Column) -> Column:
    """ISBN-10 or ISBN-13 check digits."""
    plain = F.upper(F.regexp_replace(number, "[^0-9Xx]", ""))
    digits = F.transform(F.split(plain, "(?<=.)(?=.)"), lambda c: F.when(c == "X", 10).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
    ten = F.aggregate(F.transform(digits, lambda d, i: d * (10 - i)), F.lit(0), lambda a, b: a + b) % 11 == 0
    thirteen = F.aggregate(F.transform(digits, lambda d, i: d * (1 + 2 * (i % 2))), F.lit(0), lambda a, b: a + b) % 10 == 0
    return F.when(plain.rlike("^[0-9]{9}[0-9X]$"), ten).when(plain.rlike("^[0-9]{13}$"), thirteen).otherwise(F.lit(False))


_ISBN = r"(?i)\bISBN(?:-1[03])?:?[ \t]*([0-9X][0-9X -]{8,16}[0-9X])\b"


def isbns(lines: Column) -> Column:
    """ISBNs: a warning to check them, an error where the check digit is wrong."""

    def of_line(ln: Column) -> Column:
        numbers = F.regexp_extract_all(ln["text"], F.lit(_ISBN), F.lit(1))
        return F.transform(numbers, lambda n: F.struct(ln["line"].cast("bigint").alias("line"), F.lit("en-citation-check").alias("code"), F.when(isbn_valid(n), "warning").otherwise("error").alias("severity")))

    likely = F.filter(lines, lambda ln: F.contains(F.upper(ln["text"]), F.lit("ISBN")))
    return F.flatten(F.transform(likely, of_line)).cast(FOUND)


_ABBR = r"(?U)(.?)(?<![\w\-])([A-Z]{2,6}s?)(?![\w\-]|\.\w)(?=(.{0,2}))"


def undefined_abbreviations(lines: Column, words: Column, known: list[str] = english.KNOWN_ABBREVIATIONS) -> Column:
    """The first use of an abbreviation that is not expanded there, in documents of 80 words or more; headings are labels, lines in capitals are no problem."""
    capital_line = lambda t: (F.regexp_count(t, F.lit(r"\b[A-Z]{2,}\b")) >= 3) & ~t.rlike("[a-z]{3,}")

    def of_line(ln: Column) -> Column:
        part = lambda k: F.regexp_extract_all(ln["text"], F.lit(_ABBR), F.lit(k))
        zipped = F.arrays_zip(part(1).alias("before"), part(2).alias("token"), part(3).alias("after"))
        skip = capital_line(ln["text"])
        return F.transform(zipped, lambda z: F.struct(ln["line"].alias("line"), F.regexp_replace(z["token"], "(?<=[A-Z]{2})s$", "").alias("abbr"), ((z["before"] != "(") & (z["after"] != " (") & ~skip).alias("open")))

    body = F.filter(lines, lambda ln: (ln["tag"] != "heading") & ln["text"].rlike("[A-Z]{2}"))
    listed = F.array(*map(F.lit, known))

    def first_uses(all_: Column) -> Column:
        first = let(F.transform(all_, lambda a: a["abbr"]), lambda names: F.filter(all_, lambda a, i: F.array_position(names, a["abbr"]) == i + 1))
        return each(F.filter(first, lambda a: a["open"] & ~F.array_contains(listed, a["abbr"]) & ~a["abbr"].rlike(english.ROMAN)), "en-undefined-abbr")

    return F.when(words >= 80, let(F.flatten(F.transform(body, of_line)), first_uses)).otherwise(NONE()).cast(FOUND)


_VOCABULARY = f"(?iU)(?:{english.AI_VOCABULARY}|{english.BUZZWORDS})"


def vocabulary_density(body: Column, words: Column, width: int = 300, step: int = 150) -> Column:
    """A window of ``width`` words, stepping by ``step``, with three distinct listed words, or five with buzzwords; texts of 150 words or more."""
    count = lambda t: F.regexp_count(t, F.lit(english.WORD))
    hits = F.regexp_extract_all(body, F.lit(_VOCABULARY), F.lit(0))
    gaps = F.split(body, _VOCABULARY, -1)

    def judged(all_: Column) -> Column:
        before = total_before_each(F.transform(all_, lambda h: count(h["gap"]) + count(h["hit"])))
        listed = lambda w: F.when(w.rlike(f"(?iU)^(?:{english.AI_VOCABULARY})$"), lemma(w))
        placed = F.zip_with(all_, before, lambda h, n: F.struct((n + count(h["gap"]) + 1).alias("at"), lemma(h["hit"]).alias("lemma"), listed(h["hit"]).alias("vocabulary")))
        last = F.greatest(F.lit(0), F.floor((count(body) - step - 1) / step).cast("int"))

        def dense(p: Column) -> Column:
            inside = lambda k: F.filter(p, lambda h: (h["at"] >= k * step) & (h["at"] < k * step + width))
            distinct = lambda xs: F.size(F.array_distinct(F.filter(xs, lambda x: x.isNotNull())))
            full = lambda xs: (distinct(F.transform(xs, lambda h: h["vocabulary"])) >= 3) | (distinct(F.transform(xs, lambda h: h["lemma"])) >= 5)
            return F.exists(F.sequence(F.lit(0), last), lambda k: full(inside(k)))

        return let(placed, dense)

    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    gate = (words >= 150) & body.rlike(_VOCABULARY)
    return whole(F.when(gate, let(pairs, judged)).otherwise(F.lit(False)), "en-ai-vocab-density", "error")


def emoji_bullets(lines: Column, letters: str) -> Column:
    """Lines led by an emoji before letters, where a document has two of them or more."""
    lead = F.filter(lines, lambda ln: ln["text"].rlike(rf"^[ \t]*(?:[-*•][ \t]*)?(?:{EMOJI}).*[A-Za-z{letters}]"))
    return let(lead, lambda rows: F.when(F.size(rows) >= 2, each(rows, "emoji-bullet")).otherwise(NONE()).cast(FOUND))


def caption_headers(lines: Column, code: str) -> Column:
    return each(F.filter(lines, lambda ln: ln["text"].rlike(english.CAPTION_HEADER)), code)


def sentence_stats(sents: Column) -> Column:
    """n_sentences, n_words, avg_words, min_words, max_words."""
    n = F.transform(sents, lambda s: s["n"].cast("bigint"))
    return F.struct(F.size(n).cast("bigint").alias("n_sentences"), summed(n).alias("n_words"), (summed(n) / F.nullif(F.size(n), F.lit(0))).alias("avg_words"), F.array_min(n).alias("min_words"), F.array_max(n).alias("max_words"))


def reading_stats(docs: DataFrame, kind: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_words, n_syllables, reading_ease, reading_grade; syllables are counted once for each distinct word of the corpus."""
    rows = segment.structured(docs, "en", kind)
    stats = rows.select("doc_id", sentence_stats(F.col("sents")).alias("s")).select("doc_id", "s.n_sentences", "s.n_words")
    # A word inside one sentence each, so masked text and labels that no sentence holds do not count.
    words = rows.select("doc_id", F.explode(F.flatten(F.transform("sents", lambda s: F.regexp_extract_all(F.lower(s["text"]), F.lit(english.WORD), F.lit(0))))).alias("word"))
    words = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    distinct = words.select("word").distinct().withColumn("syllables", lengths.syllables(F.col("word")))
    total = words.join(distinct, "word").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("syllables")).alias("n_syllables"))
    c = F.col
    out = stats.join(total, "doc_id")
    return out.withColumns({"reading_ease": lengths.reading_ease(c("n_words"), c("n_syllables"), c("n_sentences")), "reading_grade": lengths.reading_grade(c("n_words"), c("n_syllables"), c("n_sentences"))})


def readability(stats: DataFrame, target: float = 10.0) -> DataFrame:
    """Grade and ease findings of documents of 100 words or more."""
    hits = F.filter(
        F.array(
            F.when(F.round("reading_grade", 1) > target, found(F.lit(0), "en-readability-grade")),
            F.when(F.round("reading_ease", 1) < 30, found(F.lit(0), "en-readability-fre")),
        ),
        lambda f: f.isNotNull(),
    )
    return stats.where("n_words >= 100").select("doc_id", F.explode(hits).alias("f")).select("doc_id", "f.*")


def english_rules(settings: Settings) -> list[Column]:
    """All document rules of a structured row."""
    lines, sents, body = F.col("lines"), F.col("sents"), F.col("body")
    own, words = F.col("own"), F.col("n_words")
    parts = [
        long_sentences(sents, settings.max_words), same_opening(sents), flat_rhythm(sents), rhetorical_opening(sents), passive_density(sents),
        connectors(lines, words), dash_density(lines, words), marks_over(own, "!", settings.exclaim_max, "en-bangs"), marks_over(own, EMOJI, settings.emoji_max, "en-emoji", EMOJI_GATE),
        quote_mix(own), spelling_mix(lines, body), undefined_abbreviations(lines, words), vocabulary_density(body, words), isbns(lines),
    ]
    if settings.kind in ("md", "text", "html"):
        parts.append(long_paragraphs(lines))
    if settings.kind == "md":
        parts += [bold_overuse(own, words), inline_headers(lines)]
    if settings.format not in english.NUMERAL_START_OFF:
        parts.append(numeral_starts(sents))
    if settings.format == "caption":
        parts.append(caption_headers(lines, "en-caption-header"))
    return parts


def document_findings(rows: DataFrame, rules: list[Column]) -> DataFrame:
    """doc_id, line, code, severity of a structured table's rows."""
    return rows.select("doc_id", F.explode(F.concat(*rules)).alias("f")).select("doc_id", "f.*")


def english_document_findings(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, line, code, severity of all document rules: one scan of the texts."""
    rows = segment.structured(docs, "en", settings.kind)
    rows = rows.withColumns({"own": own_lines(F.col("lines"), settings.kind), "n_words": total_words(F.col("sents"))})
    out = document_findings(rows, english_rules(settings))
    if settings.format in english.READ_FORMATS:
        out = out.unionByName(readability(reading_stats(docs, settings.kind), settings.reading_grade_max))
    return out


def contraction_counts(docs: DataFrame) -> DataFrame:
    """doc_id, contractions, negative, expanded: counts outside code and links."""
    body = segment.read_prose(segment.clean(F.col("text")), "md")
    return docs.select("doc_id", *(count_in(body, f"(?iU){p}").alias(name) for name, p in (("contractions", english.CONTRACTION), ("negative", english.NEGATIVE_CONTRACTION), ("expanded", english.EXPANDED))))


def first_rows(rows: DataFrame, key: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of every key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
