"""Requests and outputs: operations, fact locks, output checks, playbook search, channel lookup, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- Fixed values: operations in the order they are tried. ----
OPERATIONS = (
    ("export", r"\bexport\b|خروجی بگیر|خروجی بده|خروجی json|خروجی csv"),
    ("prepare_for_publication", r"prepare for publication|آماده انتشار|آماده سازی انتشار"),
    ("score", r"\bscore\b|نمره بده|امتیاز بده"),
    ("review", r"\breview\b|\baudit\b|بازبینی|بررسی کن|نقد کن"),
    ("translate", r"\btranslate\b|ترجمه کن|ترجمه به"),
    ("adapt", r"\badapt\b|\brepurpose\b|تطبیق|تبدیل کن|برای .{0,30} کوتاه کن"),
    ("rewrite", r"\brewrite\b|\bshorten\b|\bimprove\b|بازنویسی|بهتر کن|کوتاه کن|ویرایش کن"),
    ("plan", r"\boutline\b|plan (?:a|an|the|this) |طرح ریزی|طرح کلی"),
)
NUMBER = r"(?<![\w.])[0-9][0-9,]*(?:\.[0-9]+)?%?"
URL = r"https?://[^\s<>\"')\]]+"


def operation_of(request: Column) -> Column:
    """The operation a request asks for; writing if none is named."""
    low = F.lower(F.trim(request))
    out = F.when(low.rlike(r"^(?:please\s+)?(?:write|draft|create)\b") | (low.contains("بنویس") & ~low.contains("بازنویسی")), "write")
    for name, pattern in OPERATIONS:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("write")


def fact_locks(sources: DataFrame) -> DataFrame:
    """pack_id, value, kind of the numbers and links that a text must keep; each value once."""
    text = F.coalesce("text", F.lit(""))
    found = lambda kind, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda v: F.struct(v.alias("value"), F.lit(kind).alias("kind")))
    rows = sources.select("pack_id", F.posexplode(F.concat(found("number", NUMBER), found("url", URL))).alias("n", "lock")).select("pack_id", "n", "lock.*")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("pack_id", "value").orderBy("n"))).where("k = 1").select("pack_id", "value", "kind")


def output_problems(outputs: DataFrame, locks: DataFrame, sections: DataFrame, forbidden: DataFrame) -> DataFrame:
    """pack_id, problem, value: missing sections, lost locks, forbidden additions.

    outputs: pack_id, content (map of section to text); sections: pack_id,
    section; forbidden: pack_id, phrase.
    """
    text = F.array_join(F.map_values("content"), "\n")
    body = outputs.select("pack_id", "content", text.alias("body"))
    missing = sections.join(body, "pack_id").where(F.trim(F.coalesce(F.try_element_at("content", F.col("section")), F.lit(""))) == "").select("pack_id", F.lit("missing section").alias("problem"), F.col("section").alias("value"))
    lost = locks.join(body, "pack_id").where(~F.contains("body", "value")).select("pack_id", F.concat(F.lit("lost "), "kind").alias("problem"), "value")
    added = forbidden.join(body, "pack_id").where(F.contains(F.lower("body"), F.lower("phrase"))).select("pack_id", F.lit("forbidden addition").alias("problem"), F.col("phrase").alias("value"))
    return missing.unionByName(lost).unionByName(added)


def placeholder_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """unit_key of strings whose placeholders changed, or that only one side has."""
    marks = F.array_sort(F.regexp_extract_all("value", F.lit(r"\{[A-Za-z0-9_.]*\}|%(?:\d+\$)?[sd@]|\$\{[^}]*\}"), F.lit(0)))
    a = before.select("unit_key", marks.alias("a"))
    b = after.select("unit_key", marks.alias("b"))
    return a.join(b, "unit_key", "full").where(F.col("a").isNull() | F.col("b").isNull() | (F.col("a") != F.col("b"))).select("unit_key")


def playbook_search(queries: DataFrame, sections: DataFrame, most: int = 5) -> DataFrame:
    """query_id, anchor, score, place: exact anchors first, then shared words over the query's words, a quarter more for the task.

    queries: query_id, text, task; sections: anchor, title, task.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda t: F.length(t) > 1))
    q = queries.select("query_id", F.col("text").alias("q"), F.col("task").alias("qt"), F.explode(tokens(F.col("text"))).alias("t"))
    s = sections.select("anchor", "title", F.col("task").alias("st"), F.explode(tokens(F.concat_ws(" ", "title", "anchor"))).alias("t"))
    hits = q.join(s, "t").groupBy("query_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.first("q").alias("q"), F.max((F.col("qt") == F.col("st")).cast("int")).alias("same"))
    size = F.size(tokens(F.col("q")))
    rows = hits.withColumn("score", F.when(F.lower("q") == F.col("anchor"), F.lit(9.0)).otherwise(F.col("n") / size + 0.25 * F.coalesce("same", F.lit(0))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "anchor"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("query_id", "anchor", "score", "place")


def channel_lookup(requests: DataFrame, channels: DataFrame) -> DataFrame:
    """query, channel, how: an exact name, else names that contain the request, else none.

    Containment meets by the request's first three characters, which a name has in one of its places.
    """
    exact = requests.join(channels, F.lower("query") == F.lower("channel")).select("query", "channel", F.lit("exact").alias("how"))
    rest = requests.join(exact.select("query"), "query", "left_anti").withColumn("gram", F.substring(F.lower("query"), 1, 3))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("channel")))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(places, lambda i: F.substring(F.lower("channel"), i, n)))))
    part = rest.join(channels.select("channel", F.explode(grams).alias("gram")), "gram").where(F.contains(F.lower("channel"), F.lower("query"))).select("query", "channel", F.lit("part").alias("how"))
    none = rest.join(part.select("query").distinct(), "query", "left_anti").select("query", F.lit(None).cast("string").alias("channel"), F.lit("none").alias("how"))
    return exact.unionByName(part).unionByName(none)


def channel_page(limits: DataFrame, region: str | None = None, field: str | None = None, most: int = 20) -> DataFrame:
    """Channel limits of a region and field, with their total before the limit."""
    rows = limits
    if region is not None:
        rows = rows.where(F.col("region") == region)
    if field is not None:
        rows = rows.where(F.col("field") == field)
    # A catalogue of channels is small and one page of it is shown.
    return rows.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).orderBy("channel", "field").limit(most)


def text_differences(pairs: DataFrame) -> DataFrame:
    """case_id, kind, added, removed: numbers, names and quotations that only one of two texts has."""
    kinds = {"number": NUMBER, "name": r"(?<=[a-z,] )[A-Z][a-z]+", "quote": "[\"“][^\"“”\n]{2,300}[\"”]"}
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.array_except(found(F.col("final"), p), found(F.col("shown"), p)).alias("added"), F.array_except(found(F.col("shown"), p), found(F.col("final"), p)).alias("removed")) for k, p in kinds.items()))
    return pairs.select("case_id", F.explode(rows).alias("r")).select("case_id", "r.*")
