"""Reports, event appends and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PACKET_CHARS = 60_000


def json_report(findings: DataFrame, version: int = 2) -> DataFrame:
    """One JSON object a document: version, issues in order, and a summary."""
    issue = F.struct("place", "line", "col", "code", "severity", "text")
    rows = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(issue)).alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"))
    return rows.select("doc_id", F.to_json(F.struct(F.lit(version).alias("version"), "issues", F.struct("errors", "warnings").alias("summary"))).alias("report"))


def summary(findings: DataFrame, most: int = 15, chars: int = 4000) -> DataFrame:
    """The first issues of each document as text."""
    top = findings.where(F.col("place") <= most)
    line = F.concat_ws(" ", F.concat(F.lit("line "), F.col("line").cast("string")), "severity", "code", "text")
    rows = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("rows"))
    return rows.select("doc_id", F.substring(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), 1, chars).alias("summary"))


def text_report(findings: DataFrame, files: DataFrame) -> DataFrame:
    """path, report: a document's findings as text, errors first, under its path and counts."""
    line = F.concat_ws(" ", F.concat(F.lit("  "), F.lpad(F.coalesce(F.col("line").cast("string"), F.lit("-")), 5, " ")), F.rpad("severity", 7, " "), "code", F.col("text"))
    rows = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("rows"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"))
    out = files.select("doc_id", "path").join(rows, "doc_id", "left")
    head = F.concat(F.col("path"), F.lit(": "), F.coalesce("errors", F.lit(0)).cast("string"), F.lit(" errors, "), F.coalesce("warnings", F.lit(0)).cast("string"), F.lit(" warnings"))
    return out.select("path", F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("report"))


def write_fixed(fixed: DataFrame, path: str) -> None:
    """Write texts (encoding, text) back in their encoding: UTF-8, UTF-8 with a mark, or UTF-16; line ends are those of the text."""
    mark = F.lit("\ufeff")
    marked = F.when(F.col("encoding") == "UTF-8", F.col("text")).otherwise(F.concat(mark, "text"))
    content = F.when(F.col("encoding").startswith("UTF-16"), F.encode(marked, "UTF-16LE")).otherwise(F.encode(marked, "UTF-8"))
    fixed.select(*(c for c in fixed.columns if c != "text"), content.alias("content")).write.mode("overwrite").parquet(path)


def bounded_hits(events: DataFrame, most_bytes: int = 16 * 1024) -> DataFrame:
    """Events whose map of hits fits a line: an event over it loses the rarer half of its ids, again and again until it fits."""
    size = lambda hits: F.octet_length(F.to_json(hits))
    ranked = F.array_sort(F.transform(F.map_entries("hits"), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key"), e["value"].alias("value"))))
    n = F.size("hits")
    halves = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.greatest(F.lit(0), F.floor(n / F.pow(F.lit(2), k)).cast("int")))
    cut = lambda k: F.map_from_entries(F.transform(F.slice(ranked, 1, k), lambda e: F.struct(e["key"], e["value"])))
    fitting = F.filter(halves, lambda k: size(cut(k)) <= most_bytes)
    return events.withColumn("hits", F.when(F.col("hits").isNull() | (size(F.col("hits")) <= most_bytes), F.col("hits")).otherwise(cut(F.get(fitting, F.lit(0)))))


def append_events(events: DataFrame, path: str) -> None:
    """Append to a table partitioned by week; the commit protocol makes it atomic."""
    bounded_hits(events).write.mode("append").partitionBy("epoch").parquet(path)


def packets(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One packet a key: one array element a line, as many of the first rows as fit."""
    body = rows.withColumn("__line", F.to_json(F.struct(*[c for c in rows.columns if c not in keys])))
    at = Window.partitionBy(*keys).orderBy(*order)
    body = body.withColumn("__n", F.row_number().over(at)).withColumn("__size", F.sum(F.length("__line") + 2).over(at)).where(F.col("__size") <= MAX_PACKET_CHARS - 4)
    parts = body.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__n", "__line"))).alias("__rows"))
    return parts.select(*keys, F.concat(F.lit("[\n"), F.array_join(F.transform("__rows", lambda r: r["__line"]), ",\n"), F.lit("\n]")).alias("packet"))


def csv_safe(value: Column) -> Column:
    """A cell that a spreadsheet does not read as a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def exported(outputs: DataFrame, how: str) -> DataFrame:
    """pack_id, body of outputs (pack_id, content: map of section to text) as json, markdown, text or csv."""
    entries = F.map_entries("content")
    bodies = {
        "json": F.to_json("content"),
        "markdown": F.array_join(F.transform(entries, lambda e: F.concat(F.lit("## "), e["key"], F.lit("\n\n"), e["value"])), "\n\n"),
        "text": F.array_join(F.transform(entries, lambda e: e["value"]), "\n\n"),
        "csv": F.array_join(F.concat(F.array(F.lit("section,text")), F.transform(entries, lambda e: F.to_csv(F.struct(csv_safe(e["key"]).alias("s"), csv_safe(e["value"]).alias("t")), {"escape": '"'}))), "\n"),
    }
    return outputs.select("pack_id", bodies[how].alias("body"))
