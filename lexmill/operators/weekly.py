"""Outcome statistics: sampling by hash, bounded weekly aggregation, phrase selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- Fixed values: contribution bounds. ----
WORDS_CAP, HITS_CAP, KEPT_CAP, HO_CAP, PLACEBO_CAP, PARAM_CAP, HEALTH_CAP, CELLS_CAP = 200_000, 200, 10, 10, 200, 10, 1_000, 600
MIN_OUTCOMES, MIN_LINTS = 3, 20


def phrase_id(prefix: str, language: Column, category: Column, phrase: Column) -> Column:
    """Prefix and the first ten hex digits of the hash of language, category and phrase."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", language, category, phrase), 256), 1, 10))


def holdout_value(salt: bytes, *parts: Column) -> Column:
    """0 to 99 from the first four bytes of a salted hash."""
    joined = F.concat(F.lit(salt), F.encode(F.concat_ws("|", *parts), "utf-8"))
    return (F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long") % 100).cast("long")


def canary_bucket(value: Column) -> Column:
    """0 to 9999 from eight bytes of a hash, unsigned."""
    return (F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("decimal(20,0)") % 10_000).cast("long")


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def floor_fifty(n: Column) -> Column:
    return F.least(F.lit(WORDS_CAP), n - n % 50).cast("long")


def apportion(rows: DataFrame, keys: list[str], part: str, value: str, cap: int) -> DataFrame:
    """Adds ``share``: values of a group over the cap are scaled to it by the largest remainder.

    Integers only: floor(value * cap / total), then one more for the parts
    with the largest remainders, ties by the part as a string.
    """
    group = Window.partitionBy(*keys)
    v = F.col(value).cast("long")
    out = rows.withColumn("__total", F.sum(v).over(group))
    out = out.withColumn("__floor", F.when(F.col("__total") <= cap, v).otherwise(F.floor(v * cap / F.col("__total").cast("decimal(20,0)")).cast("long")))
    out = out.withColumn("__rest", F.when(F.col("__total") <= cap, F.lit(0).cast("long")).otherwise(v * cap - F.col("__floor") * F.col("__total")))
    out = out.withColumn("__left", F.when(F.col("__total") <= cap, F.lit(0).cast("long")).otherwise(F.lit(cap) - F.sum("__floor").over(group)))
    rank = F.row_number().over(group.orderBy(F.desc("__rest"), F.col(part).cast("string")))
    return out.withColumn("share", F.col("__floor") + F.when(rank <= F.col("__left"), 1).otherwise(0)).drop("__total", "__floor", "__rest", "__left")


def big_enough(outcomes: Column, lints: Column) -> Column:
    return (outcomes >= MIN_OUTCOMES) | (lints >= MIN_LINTS)


def ranked_cells(cells: DataFrame, keys: list[str], order: list[Column], most: int = CELLS_CAP) -> DataFrame:
    """The first cells of every key; a report's own size limit."""
    return cells.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def selected_phrases(rows: DataFrame, cases: int = 2, days: int = 2, most: int = 20, cap: int = 5) -> DataFrame:
    """Phrases deleted in enough cases on enough days, with their main group: lang, ng, fg, del, kept (both capped), place.

    rows: lang, ng, day, fg, deleted, kept: one row for each case and phrase.
    """
    gone, kept = F.col("deleted") > 0, F.col("kept") > 0
    per = rows.groupBy("lang", "ng").agg(F.count_if(gone).alias("del"), F.count_distinct(F.when(gone, F.col("day"))).alias("days"), F.count_if(kept).alias("kept"))
    per = per.where((F.col("del") >= cases) & (F.col("days") >= days))
    main = rows.where(gone).groupBy("lang", "ng", "fg").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang", "ng").orderBy(F.desc("n"), group_rank(F.col("fg")))
    main = main.withColumn("r", F.row_number().over(order)).where("r = 1").select("lang", "ng", "fg")
    out = per.join(main, ["lang", "ng"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("del"), "ng"))).where(F.col("place") <= most)
    return out.select("lang", "ng", "fg", F.least(F.lit(cap), "del").cast("long").alias("del"), F.least(F.lit(cap), "kept").cast("long").alias("kept"), "place")


def base_rates(outcomes: DataFrame) -> DataFrame:
    """Per language the rounded totals of shown and deleted tokens."""
    out = outcomes.groupBy("lang").agg(F.sum("ta").alias("ta"), F.sum("td").alias("td"))
    return out.select("lang", floor_fifty(F.col("ta")).alias("ta"), F.least(floor_fifty(F.col("td")), floor_fifty(F.col("ta"))).alias("td"))


def playbook_totals(outcomes: DataFrame, order: str, most: int = 50) -> DataFrame:
    """pb, lang, n, first_pass, edit_hundredths, revisions, errors over the first outcomes of a playbook and language, in event order: bounds of a contribution."""
    at = Window.partitionBy("pb", "lang").orderBy(order)
    first = outcomes.withColumn("__k", F.row_number().over(at)).where(F.col("__k") <= most)
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("edit_ratio", F.lit(0.0))))
    hundredths = F.floor(ratio.cast("decimal(20,10)") * 100).cast("long")
    within = lambda c, cap: F.greatest(F.lit(0), F.least(F.lit(cap), F.coalesce(c, F.lit(0)))).cast("long")
    return first.groupBy("pb", "lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("revisions", F.lit(0)) == 0).alias("first_pass"),
        F.sum(hundredths).alias("edit_hundredths"),
        F.sum(within(F.col("revisions"), 5)).alias("revisions"),
        F.sum(within(F.col("errors"), 10)).alias("errors"),
    )


# ---- Fixed values: groups and languages in their order, events and their reasons. ----
GROUPS, LANGUAGES = ("short", "long", "ui", "none"), ("fa", "en")
HEALTH_KINDS = ("selftest_ok", "selftest_fail", "overlay_exception", "revert", "sync_ok", "sync_fail")
HEALTH_REASONS = {"cap_reject": ("violation", "gap"), "verify_fail": ("fork", "mismatch", "local")}
PARAMS_CAP_ROWS, PLAYBOOK_ROWS = 200, 100
EVENTS = (
    "week string, seq long, t string, lang string, fg string, w long, hits map<string,long>, cells map<string,struct<kept:long,ho:long,hg:long>>, pl struct<n:long,g:long>, "
    "params map<string,map<string,struct<n:long,g:long>>>, base struct<ta:long,td:long>, er double, pb string, rev long, fe long, k string, r string"
)


def group_rank(fg: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, GROUPS)), fg)


def _group(fg: Column) -> Column:
    return F.when(fg.isin(*GROUPS), fg).otherwise("none")


def known_id(lang: Column, ident: Column) -> Column:
    """Whether a language may report an id: rules by their prefix, phrases by their language."""
    phrase = F.substring(ident, 1, 3).isin("lx-", "ht-")
    own = F.when(phrase, F.substring(ident, 4, 2) == lang).when(lang == "en", ident.startswith("en-")).otherwise(~ident.startswith("en-"))
    return ident.rlike("^[a-z0-9-]{1,40}$") & ~ident.startswith("ng-") & own


def final_words(base: Column, er: Column, most: int = 4_000) -> Column:
    """Words of a final text, from the tokens shown and deleted and the edit ratio; the shown ones where nothing matched."""
    ta, td = F.coalesce(base["ta"], F.lit(0)), F.coalesce(base["td"], F.lit(0))
    matched = F.greatest(F.lit(0), ta - F.greatest(F.lit(0), td))
    estimate = F.bround(2.0 * matched / (1.0 - er) - ta)
    return F.when(ta < 0, 0).when(er.isNull() | (er >= 0.995) | (matched == 0), ta).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), estimate))).cast("long")


def _share(part: Column, of: Column, total: Column) -> Column:
    """part * of / total half up, at most ``of``, in whole numbers."""
    return F.least(of, F.floor((2 * part * of + total).cast("decimal(38,0)") / (2 * F.greatest(total, F.lit(1))).cast("decimal(38,0)")).cast("long"))


def report(events: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """The weekly report of an event log (``EVENTS``): volume, cells, placebo, params, playbooks, health and counts, by week.

    Every contribution is bounded, shares of a bound go by the largest
    remainder, and weeks with fewer than three outcomes and twenty checks
    report nothing.  known: lang, id of what may be reported.
    """
    rows = events.withColumn("fg", _group(F.col("fg")))
    counts = rows.groupBy("week").agg(F.count_if((F.col("t") == "out") & F.col("lang").isin(*LANGUAGES)).alias("out"), F.count_if((F.col("t") == "lint") & F.col("lang").isin(*LANGUAGES)).alias("lint"))
    enough = counts.where(big_enough(F.col("out"), F.col("lint"))).select("week")
    rows = rows.join(enough, "week", "left_semi")
    checks, outcomes = rows.where((F.col("t") == "lint") & F.col("lang").isin(*LANGUAGES)), rows.where((F.col("t") == "out") & F.col("lang").isin(*LANGUAGES))
    return {"counts": counts, "volume": _volume(checks, outcomes), "cells": _cells(checks, outcomes, known), "placebo": _placebo(outcomes), "params": _params(outcomes), "playbooks": _playbooks(outcomes), "health": _health(rows)}


def _volume(checks: DataFrame, outcomes: DataFrame) -> DataFrame:
    shown = checks.where("w > 0").select("week", "lang", "fg", F.col("w").alias("shown"), F.lit(0).cast("long").alias("final"))
    final = outcomes.select("week", "lang", "fg", F.lit(0).cast("long").alias("shown"), final_words(F.col("base"), F.col("er")).alias("final"))
    out = shown.unionByName(final).groupBy("week", "lang", "fg").agg(F.sum("shown").alias("shown"), F.sum("final").alias("final"))
    return out.select("week", "lang", "fg", floor_fifty(F.col("shown")).alias("words_shown"), floor_fifty(F.col("final")).alias("words_final")).where("words_shown > 0 or words_final > 0")


def _cells(checks: DataFrame, outcomes: DataFrame, known: DataFrame | None) -> DataFrame:
    key = ["week", "lang", "id", "fg"]
    none = F.lit(0).cast("long")
    hits = checks.select("week", "lang", "fg", F.explode("hits").alias("id", "n")).where("n > 0").select(*key, F.col("n").alias("hits"), none.alias("kept"), none.alias("ho"), none.alias("hg"))
    one = lambda c: F.greatest(none, F.coalesce(c, none))
    cells = outcomes.select("week", "lang", "fg", F.explode("cells").alias("id", "c"))
    cells = cells.select(*key, none.alias("hits"), one(F.col("c.kept")).alias("kept"), one(F.col("c.ho")).alias("ho"), F.least(one(F.col("c.ho")), one(F.col("c.hg"))).alias("hg"))
    rows = hits.unionByName(cells).where(known_id(F.col("lang"), F.col("id")))
    if known is not None:
        rows = rows.join(known.select("lang", "id").distinct(), ["lang", "id"], "left_semi")
    rows = rows.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("hits", "kept", "ho", "hg"))).where("hits > 0 or kept > 0 or ho > 0")
    for value, cap in (("hits", HITS_CAP), ("kept", KEPT_CAP), ("ho", HO_CAP)):
        rows = apportion(rows, ["week", "lang", "id"], "fg", value, cap).withColumn(f"{value}_share", F.col("share").cast("long")).drop("share")
    gained = F.when(F.col("ho") > 0, _share(F.col("hg"), F.col("ho_share"), F.col("ho"))).otherwise(none)
    rows = rows.select(*key, F.col("hits_share").alias("hits"), F.col("kept_share").alias("kept"), F.col("ho_share").alias("ho"), gained.alias("hg")).where("hits > 0 or kept > 0 or ho > 0")
    return ranked_cells(rows, ["week"], [F.desc("ho"), F.desc("kept"), F.desc("hits"), F.col("lang"), F.col("id"), F.col("fg")])


def in_cell_order(cells: DataFrame) -> DataFrame:
    """With ``place``: by language, id and group, in the fixed order of languages and groups."""
    order = Window.partitionBy("week").orderBy(F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")), "id", group_rank(F.col("fg")))
    return cells.withColumn("place", F.row_number().over(order))


def _placebo(outcomes: DataFrame) -> DataFrame:
    g = F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(F.col("pl.g"), F.lit(0)), F.col("pl.n")))
    rows = outcomes.where(F.col("pl.n") > 0).groupBy("week", "lang", "fg").agg(F.sum("pl.n").alias("n"), F.sum(g).alias("g"))
    cap = F.lit(PLACEBO_CAP).cast("long")
    return rows.select("week", "lang", "fg", F.least(cap, "n").alias("n"), F.when(F.col("n") > cap, F.expr(f"g * {PLACEBO_CAP} div n")).otherwise(F.col("g")).alias("g"))


def _params(outcomes: DataFrame) -> DataFrame:
    rows = outcomes.select("week", "lang", "fg", F.explode("params").alias("id", "buckets")).where(F.col("id").rlike(r"^(fa|en):[a-z0-9-]{1,40}[.][a-z0-9_]{1,32}$") & F.col("id").startswith(F.concat("lang", F.lit(":"))))
    rows = rows.select("week", "id", "fg", F.explode("buckets").alias("b", "v")).where(F.col("b").rlike("^[0-9]{1,4}$") & (F.col("v.n") > 0)).withColumn("b", F.col("b").cast("long")).where("b <= 1000")
    g = F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(F.col("v.g"), F.lit(0)), F.col("v.n")))
    rows = rows.groupBy("week", "id", "fg", "b").agg(F.sum("v.n").alias("n"), F.sum(g).alias("g")).withColumn("part", F.concat(F.lit("('"), "fg", F.lit("', "), F.col("b").cast("string"), F.lit(")")))
    rows = apportion(rows, ["week", "id"], "part", "n", PARAM_CAP).where("share > 0")
    rows = rows.select("week", "id", "fg", "b", F.col("share").cast("long").alias("n"), _share(F.col("g"), F.col("share").cast("long"), F.col("n")).alias("g"))
    return ranked_cells(rows, ["week"], [F.col("id"), group_rank(F.col("fg")), F.col("b")], PARAMS_CAP_ROWS)


def _playbooks(outcomes: DataFrame) -> DataFrame:
    rows = outcomes.where(F.col("pb").rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & (F.length("pb") <= 64))
    rows = rows.select(F.concat_ws("|", "week", "pb").alias("pb"), "lang", "seq", F.col("rev").alias("revisions"), F.col("er").alias("edit_ratio"), F.col("fe").alias("errors"))
    out = playbook_totals(rows, "seq").withColumn("week", F.substring_index("pb", "|", 1)).withColumn("id", F.substring_index("pb", "|", -1)).drop("pb")
    return ranked_cells(out, ["week"], [F.col("id"), F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang"))], PLAYBOOK_ROWS)


def _health(rows: DataFrame) -> DataFrame:
    """week, kind, reason (empty for kinds without), n: every kind, also those that did not happen."""
    listed = [(k, "") for k in HEALTH_KINDS] + [(k, r) for k, reasons in HEALTH_REASONS.items() for r in reasons]
    seen = rows.where(F.col("t") == "health").select("week", F.col("k").alias("kind"), F.when(F.col("k").isin(*HEALTH_REASONS), F.coalesce("r", F.lit(""))).otherwise("").alias("reason"))
    counts = seen.groupBy("week", "kind", "reason").agg(F.least(F.lit(HEALTH_CAP).cast("long"), F.count(F.lit(1))).alias("n"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r).alias("reason")) for k, r in listed))
    every = rows.select("week").distinct().select("week", F.explode(kinds).alias("x")).select("week", "x.kind", "x.reason")
    return every.join(counts, ["week", "kind", "reason"], "left").select("week", "kind", "reason", F.coalesce("n", F.lit(0)).alias("n"))


def shrunk(cells: DataFrame, most_bytes: int = 64 * 1024) -> DataFrame:
    """The most informative cells of a week whose rows fit a size."""
    body = cells.withColumn("__size", F.octet_length(F.to_json(F.struct(*cells.columns))) + 1)
    order = Window.partitionBy("week").orderBy(F.desc("ho"), F.desc("kept"), F.desc("hits"), "lang", "id", "fg")
    return body.withColumn("__all", F.sum("__size").over(order)).where(F.col("__all") <= most_bytes).drop("__size", "__all")


def week_end(week: Column) -> Column:
    """The day after an ISO week (YYYY-Www): its Monday, seven days on."""
    january = F.make_date(F.substring(week, 1, 4).cast("int"), F.lit(1), F.lit(4))
    monday = F.date_sub(january, F.weekday(january))
    return F.date_add(monday, 7 * F.substring(week, 7, 2).cast("int"))


def within_retention(events: DataFrame, today: Column, days: int = 14) -> DataFrame:
    """Events whose week ended no more than some days ago."""
    return events.where(F.date_add(week_end(F.col("week")), days) >= today)
