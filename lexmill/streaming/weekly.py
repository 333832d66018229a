"""Structured Streaming forms of the event log: weeks, late data, duplicates, budgets, memory with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Days a closed week stays open for late events; outcomes a week; hours a text is remembered.
LATE_DAYS, WEEK_OUTCOMES, MEMORY_HOURS = 14, 20, 6


def weekly_counts(events: DataFrame, *keys: str) -> DataFrame:
    """week_start, keys, n of ISO weeks; weeks start on Monday, four days after the epoch's Thursday."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    marked = events.withWatermark("ts", f"{LATE_DAYS} days") if events.isStreaming else events
    return marked.groupBy(week.alias("week"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("week.start").alias("week_start"), *keys, "n")


def distinct_events(events: DataFrame, key: str) -> DataFrame:
    """Each event id once, as far as late data may repeat it."""
    if events.isStreaming:
        return events.withWatermark("ts", f"{LATE_DAYS} days").dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """key, start, end, n of sessions without a longer gap."""
    marked = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    rows = marked.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def within_budget(outcomes: DataFrame, key: str = "user_id", most: int = WEEK_OUTCOMES) -> DataFrame:
    """The first outcomes of a key in each week, by arrival; the counter of a week goes when the next begins."""
    schema = f"{key} long, event_id long, ts timestamp"

    def count(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        week, used = state.get if state.exists else (-1, 0)
        for batch in batches:
            kept = []
            for row in batch.sort_values(["ts", "event_id"]).itertuples(index=False):
                now = (row.ts.date().toordinal() - 1) // 7
                if now != week:
                    week, used = now, 0
                if used < most:
                    used += 1
                    kept.append((keys[0], row.event_id, row.ts))
            if kept:
                yield pd.DataFrame(kept, columns=[key, "event_id", "ts"])
        state.update((week, used))

    return outcomes.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(count, schema, "week long, used long", "append", GroupStateTimeout.NoTimeout)


def remembered(texts: DataFrame, key: str = "lang", hours: int = MEMORY_HOURS) -> DataFrame:
    """Each text with the one remembered before it for its key, if that is not too old."""
    schema = f"{key} string, ts timestamp, text string, before string"

    def recall(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, 0)
        for batch in batches:
            rows = []
            for row in batch.sort_values("ts").itertuples(index=False):
                now = int(row.ts.timestamp())
                rows.append((keys[0], row.ts, row.text, last if last is not None and now - at <= hours * 3600 else None))
                last, at = row.text, now
            yield pd.DataFrame(rows, columns=[key, "ts", "text", "before"])
        state.update((last, at))

    return texts.select(key, "ts", "text").groupBy(key).applyInPandasWithState(recall, schema, "text string, at long", "append", GroupStateTimeout.NoTimeout)
