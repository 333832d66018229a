"""Positions of regular-expression matches, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
#: Items that one fold takes: a fold copies what it has found at every step, so folds stay short.
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before_each(items: Column, zero: Column, kind: str, join: Callable[[Column, Column], Column]) -> Column:
    """What stands before every item of an array: ``zero`` joined with all earlier items.

    ``join`` is associative, ``zero`` is neutral to it, and both are of the
    items' type ``kind``.  Blocks are folded apart and then carried on, so the
    work grows with the items, not with their square.
    """

    def fold(part: Column) -> Column:
        start = F.struct(zero.cast(kind).alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(acc: Column, item: Column) -> Column:
            return F.struct(join(acc["state"], item).cast(kind).alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out"))

        return F.aggregate(part, start, step)

    def carried(folded: Column) -> Column:
        ahead = fold(F.transform(folded, lambda f: f["state"]))["out"]
        return F.flatten(F.zip_with(folded, ahead, lambda f, state: F.transform(f["out"], lambda own: join(state, own).cast(kind))))

    def blocks(all_: Column) -> Column:
        last = F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(all_, k * BLOCK + 1, BLOCK)))

    return let(items, lambda all_: let(blocks(all_), carried))


def total_before_each(items: Column) -> Column:
    """The sum of all earlier items, for every item."""
    return before_each(items, F.lit(0), "int", lambda a, b: a + b)


def match_spans(text: Column, pattern: str) -> Column:
    """Spans (start, end, text) of all matches in code points, end exclusive.

    The pieces between the matches give the positions.  With a group ``at``
    that ends where the match ends, the span is that group.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    at = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if "(?<at>" in pattern else hits
    pieces = F.split(text, pattern, -1)
    rows = F.arrays_zip(hits.alias("hit"), at.alias("at"), F.slice(pieces, 1, F.size(hits)).alias("gap"))

    def placed(all_: Column) -> Column:
        size = lambda r: F.length(r["gap"]) + F.length(r["hit"])
        return F.zip_with(
            all_,
            total_before_each(F.transform(all_, size)),
            lambda r, before: F.struct((before + size(r) - F.length(r["at"])).alias("start"), (before + size(r)).alias("end"), r["at"].alias("text")),
        )

    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(F.array()).cast(SPAN)


def line_of(text: Column, start: Column) -> Column:
    """1-based line of a position."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    """1-based column of a position."""
    before = F.substring(text, F.lit(1), start)
    return F.length(F.substring_index(before, "\n", -1)) + 1
