"""Joins of findings, facts, policies and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lengths import hashtags, is_gsm7, items, length_in, sms_units
from ..functions.text import number_normal, quote_normal
from ..rules.english import NOT_NAMES
from .mask import URL


def numbers(docs: DataFrame) -> DataFrame:
    """doc_id, value of the distinct numbers of a text, without thousands commas."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))
    return docs.select("doc_id", F.explode(found).alias("value"))


def names(docs: DataFrame) -> DataFrame:
    """doc_id, value of the distinct capitalised words that do not start a sentence."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<=[a-z,] )[A-Z][a-z]+"), F.lit(0)))
    return docs.select("doc_id", F.explode(found).alias("value"))


def not_in_facts(values: DataFrame, facts: DataFrame) -> DataFrame:
    """Values that no fact has: an anti-join on the lower-cased value."""
    known = facts.select(F.lower("value").alias("__v")).distinct()
    return values.join(known, F.lower("value") == F.col("__v"), "left_anti")


def lexicon_hits(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, pos, word, category, hint: words joined with a dictionary (word, category) and its optional hints."""
    return words.join(lexicon.withColumnRenamed("word", "__w"), F.lower("word") == F.col("__w")).drop("__w")


def channel_findings(docs: DataFrame, limits: DataFrame, language: str = "en") -> DataFrame:
    """doc_id, channel, field, length, code, severity of texts over a channel's length, fold or item limits: errors where the limit is verified.

    docs: doc_id, text, channel, field; limits: channel, field, unit, max_chars,
    visible_chars, max_items, status, and if known kind, item_max_chars,
    latin_max_chars (the limit of the same field for a message that GSM-7 can
    write) and max_segments.  An unknown unit counts characters.
    """
    has = set(limits.columns)
    optional = {"kind": "string", "item_max_chars": "int", "latin_max_chars": "int", "max_segments": "int"}
    limits = limits.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in has})
    rows = docs.join(limits, ["channel", "field"]).withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    latin = (F.col("kind") == "sms") & F.col("latin_max_chars").isNotNull() & is_gsm7(F.col("t"))
    rows = rows.withColumn("most", F.when(latin, F.col("latin_max_chars")).otherwise(F.col("max_chars")))
    unit = F.lower(F.coalesce("unit", F.lit("char")))
    rows = rows.withColumn("length", length_in(F.col("t"), unit)).withColumn("severity", F.when(F.col("status") == "verified", "error").otherwise("warning"))
    # A message's limit is in parts if it is small, else in units.
    parts = F.coalesce("max_segments", F.when(F.col("most").between(1, 20), F.col("most")))
    over = F.when(unit == "segment", (F.col("length") > parts) | (parts.isNull() & (sms_units(F.col("t")) > F.col("most")))).otherwise((unit != "items") & (F.col("length") > F.col("most")))
    seen = F.when(unit.isin("char", "grapheme", "utf16", "weighted"), F.col("length")).otherwise(F.length("t"))
    own = F.when(F.lower("field").contains("hashtag"), hashtags(F.col("t"))).otherwise(items(F.col("t")))
    long_items = F.slice(F.filter(own, lambda x: F.length(x) > F.col("item_max_chars")), 1, 3)
    lead = "en-" if language == "en" else ""
    one = lambda condition, code, severity: F.when(F.coalesce(condition, F.lit(False)), F.array(F.struct(F.lit(lead + code).alias("code"), severity.alias("severity")))).otherwise(F.array())
    found = [one(over, "channel-length", F.col("severity")), one((unit != "segment") & (seen > F.col("visible_chars")), "channel-visible", F.lit("warning"))]
    if language == "en":
        found.append(one(F.size(own) > F.col("max_items"), "channel-items", F.col("severity")))
        found.append(F.coalesce(F.transform(long_items, lambda x: F.struct(F.lit("en-channel-items").alias("code"), F.col("severity"))), F.array()))
    return rows.select("doc_id", "channel", "field", "length", F.explode(F.concat(*found)).alias("f")).select("doc_id", "channel", "field", "length", "f.code", "f.severity")


def _facts(text: Column) -> dict[str, Column]:
    """What a text states, by kind, in the form in which it is compared."""
    found = lambda p, k=0: F.regexp_extract_all(text, F.lit(p), F.lit(k))
    return {
        "number": F.transform(found(r"(?<![\w.])[0-9۰-۹٠-٩][0-9۰-۹٠-٩,٬]*(?:[.٫][0-9۰-۹٠-٩]+)?"), number_normal),
        "name": F.filter(F.transform(found(r"(?<=[A-Za-z0-9,;:][ \t])[A-Z][a-zA-Z'’\-]*[a-zA-Z]\b"), F.lower), lambda n: ~n.isin([w.lower() for w in NOT_NAMES])),
        "url": F.transform(found(URL), lambda u: F.regexp_replace(F.lower(u), r"[.,;:!?)\]}'\"/]+$", "")),
        "quote": F.filter(F.transform(found(r"[“\"]([^“”\"\n]{12,300})[”\"]", 1), quote_normal), lambda q: F.size(F.split(q, " ")) >= 3),
    }


def fact_findings(docs: DataFrame, briefs: DataFrame) -> DataFrame:
    """doc_id, kind, value, code, severity: numbers, names, links and quotations of a text that its brief (doc_id, facts) does not have, each once.

    Documents without a brief are not checked.
    """
    rows = docs.select("doc_id", "text").join(briefs.select("doc_id", F.col("facts").alias("__facts")), "doc_id")
    own, known = _facts(F.coalesce("text", F.lit(""))), _facts(F.coalesce("__facts", F.lit("")))
    words = F.transform(F.regexp_extract_all(F.lower("__facts"), F.lit(r"[a-z0-9][a-z0-9'’\-]*"), F.lit(0)), lambda w: F.regexp_replace(w, "’", "'"))
    missing = {
        "number": F.array_except(own["number"], known["number"]),
        "name": F.array_except(F.transform(own["name"], lambda n: F.regexp_replace(n, "’", "'")), words),
        "url": F.filter(F.array_distinct(own["url"]), lambda u: ~F.contains(F.lower("__facts"), u)),
        "quote": F.filter(F.array_distinct(own["quote"]), lambda q: ~F.contains(quote_normal(F.col("__facts")), q)),
    }
    named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    all_ = F.flatten(F.array(*(F.transform(F.array_distinct(values), named(kind)) for kind, values in missing.items())))
    return rows.select("doc_id", F.explode(all_).alias("f")).select("doc_id", "f.kind", "f.value", F.lit("en-fact-not-in-brief").alias("code"), F.lit("error").alias("severity"))


def first_definition(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of definitions with one key the first wins."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def layered(base: DataFrame, over: DataFrame, key: list[str], value: str) -> DataFrame:
    """A full outer override: the upper layer's value where it has one."""
    return base.join(over.withColumnRenamed(value, "__over"), key, "full").select(*key, F.coalesce("__over", value).alias(value))


def with_overlay(findings: DataFrame, severities: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Findings under a severity overlay (code, level), with ``hidden``: off drops, shadow and held-out ones hide, else the level replaces.

    A finding of a listed phrase (``pid``, where the findings have it) takes the level of the phrase first.  held: code.
    """
    levels = severities.select("code", "level")
    rows = findings.join(levels, "code", "left")
    if "pid" in findings.columns:
        own = levels.select(F.col("code").alias("pid"), F.col("level").alias("__own"))
        rows = rows.join(own, "pid", "left").withColumn("level", F.coalesce("__own", "level")).drop("__own")
    rows = rows.where(F.coalesce(F.col("level") != "off", F.lit(True)))
    hidden = F.coalesce(F.col("level") == "shadow", F.lit(False))
    rows = rows.withColumn("severity", F.when(F.col("level").isin("error", "warning"), F.col("level")).otherwise(F.col("severity")))
    if held is not None:
        marked = held.select(F.col("code").alias("__check"), F.lit(True).alias("__held"))
        check = F.coalesce("pid", "code") if "pid" in findings.columns else F.col("code")
        rows = rows.join(marked, check == F.col("__check"), "left")
        hidden = hidden | F.coalesce("__held", F.lit(False))
    return rows.withColumn("hidden", hidden).select(*findings.columns, "hidden")


def phrase_findings(docs: DataFrame, phrases: DataFrame, most: int = 4) -> DataFrame:
    """doc_id, pos, phrase, code, severity: listed phrases (phrase, id, state) in a text, by n-grams joined with the list."""
    tokens = F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:[\x{200C}'’\-][\p{L}\p{N}]+)*"), F.lit(0)), lambda t: t)
    rows = docs.select("doc_id", tokens.alias("t"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t"))), lambda i: i + n - 1 <= F.size("t")), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("t", i, n), " ").alias("phrase")))))
    found = rows.select("doc_id", F.explode(grams).alias("g")).select("doc_id", "g.pos", "g.phrase")
    listed = phrases.select(F.lower("phrase").alias("phrase"), "id", F.when(F.col("state") == "error", "error").otherwise("warning").alias("severity")).dropDuplicates(["phrase"])
    return found.join(listed, "phrase").select("doc_id", "pos", "phrase", F.lit("hub-tell").alias("code"), "severity")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "يك", "یک")), r"(?U)[\s\x{200C}]+", " "))


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))


def task_ranking(requests: DataFrame, signals: DataFrame, exclusions: DataFrame | None = None, most: int = 3, fallback: str = "other") -> DataFrame:
    """request_id, task, score, place, ambiguous: the tasks whose signals stand in a request as whole words.

    A task scores 10, 4 a word and a hundredth a character (60 at most) of its
    longest signal, and its priority; 100 more if the request names it, 12 more
    if a signal is where the text goes, 20 less if one of its exclusions stands
    there.  Requests without a task of a positive score get the fallback.

    requests: request_id, text; signals: task, signal, priority; exclusions:
    task, signal.  Signals meet requests by their first word, not all by all.
    """
    asked = requests.select("request_id", F.col("text").alias("raw"), _normal(F.col("text")).alias("t"))
    tokens = asked.select("request_id", "raw", "t", F.explode(F.array_distinct(_words_of(F.col("t")))).alias("first"))

    def met(listed: DataFrame) -> DataFrame:
        keyed = listed.withColumn("s", _normal(F.col("signal"))).withColumn("first", F.get(_words_of(F.col("s")), F.lit(0)))
        whole = F.concat(F.lit(r"(?U)(?<!\w)\Q"), "s", F.lit(r"\E(?!\w)"))
        return tokens.join(keyed, "first").where(F.regexp_like("t", whole))

    toward = F.regexp_like("t", F.concat(F.lit(r"(?:for|into|as|به|برای)\s+(?:a\s+|an\s+|the\s+)?\Q"), "s", F.lit(r"\E")))
    best = F.max_by(F.struct("s", F.size(F.split("s", " ")).alias("words"), F.length("s").alias("size")), F.length("s"))
    rows = met(signals).groupBy("request_id", "task").agg(best.alias("b"), F.max("priority").alias("priority"), F.max(toward).alias("toward"), F.max(F.contains("raw", "task")).alias("named"))
    if exclusions is not None:
        rows = rows.join(met(exclusions).select("request_id", "task", F.lit(20).alias("out")).distinct(), ["request_id", "task"], "left")
    else:
        rows = rows.withColumn("out", F.lit(0))
    hundredths = 1000 + 400 * F.col("b.words") + F.least(F.col("b.size"), F.lit(60)) + 100 * F.coalesce("priority", F.lit(0)) + F.when(F.col("named"), 10_000).otherwise(0) + F.when(F.col("toward"), 1200).otherwise(0) - 100 * F.coalesce("out", F.lit(0))
    rows = rows.select("request_id", "task", (hundredths / 100).alias("score"))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "task")
    ranked = rows.withColumn("place", F.row_number().over(order)).withColumn("top", F.max("score").over(Window.partitionBy("request_id"))).withColumn("next", F.lead("score").over(order))
    good = ranked.where((F.col("top") > 0) & (F.col("place") <= most))
    good = good.select("request_id", "task", "score", "place", F.coalesce((F.col("place") == 1) & (F.col("score") - F.col("next") < 2), F.lit(False)).alias("ambiguous"))
    none = requests.select("request_id").join(good.select("request_id").distinct(), "request_id", "left_anti")
    return good.unionByName(none.select("request_id", F.lit(fallback).alias("task"), F.lit(0.0).alias("score"), F.lit(1).alias("place"), F.lit(True).alias("ambiguous")))


def latest_before(memory: DataFrame, at: Column, hours: int = 6) -> DataFrame:
    """Per language the last text remembered within some hours: an as-of lookup."""
    fresh = memory.where((F.col("ts") <= at) & (F.col("ts") > at - F.expr(f"INTERVAL {hours} HOURS")))
    return fresh.groupBy("lang").agg(F.max_by("text", "ts").alias("text"), F.max("ts").alias("ts"))
