"""Delimited files, channel data, event logs and word lists."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lengths import nfc
from ..functions.text import slug

# ---- Fixed values: headers of text and of key columns. ----
TEXT_HEADER = re.compile(r"title|name|desc|text|copy|body|note|label|message|caption|headline|عنوان|نام|شرح|توضیح|متن", re.I)
KEY_HEADER = re.compile(r"^(?:id|sku|key|code|slug|handle|شناسه|کد)$", re.I)
MAX_EVENT_BYTES = 16 * 1024


def delimiter_of(header: str) -> str:
    """The most frequent of the usual delimiters outside quotes; a comma if there is none."""
    plain = re.sub(r'"[^"]*"', "", header)
    counts = {d: plain.count(d) for d in ",;\t|"}
    best = max(counts, key=lambda d: counts[d])
    return best if counts[best] else ","


def picked_columns(columns: list[str]) -> tuple[str | None, list[str]]:
    """The key column and the text columns by their headers; without any, all but the key."""
    key = next((c for c in columns if KEY_HEADER.match(c.strip())), None)
    texts = [c for c in columns if c != key and TEXT_HEADER.search(c)]
    return key, texts or [c for c in columns if c != key]


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, unit_key (row n/code/column), value, line of the text cells of delimited files with a header; empty cells are left out.

    Rows and lines are numbered within their own file, line feeds inside quoted
    cells included: each file is read whole, as its rows have no other places.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInArrow(_cells, "file string, unit_key string, value string, line long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(f, *cell) for f, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True) for cell in cells_of(text or "")]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["file", "unit_key", "value", "line"])


def cells_of(text: str) -> Iterator[tuple[str, str, int]]:
    """unit_key, value and first line of the text cells of one delimited file; the header is row 1."""
    text = text.lstrip("\ufeff")
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(text.partition("\n")[0]))
    header = next(reader, [])
    key, texts = picked_columns(header)
    begun = reader.line_num
    for n, row in enumerate(reader, 2):
        line, begun = begun + 1, reader.line_num
        code = row[header.index(key)].strip() if key and header.index(key) < len(row) else ""
        for name in texts:
            at = header.index(name)
            if at < len(row) and row[at].strip():
                yield "/".join(x for x in (f"row {n}", code, name) if x), row[at], line


CHANNELS = T.StructType(
    [
        T.StructField("group", T.StringType()),
        T.StructField("channels", T.MapType(T.StringType(), T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.StructType([T.StructField("unit", T.StringType()), T.StructField("max_chars", T.LongType()), T.StructField("visible_chars", T.LongType()), T.StructField("max_items", T.LongType()), T.StructField("item_max_chars", T.LongType()), T.StructField("status", T.StringType())])))]))),
    ]
)


def channel_limits(spark: SparkSession, path: str) -> DataFrame:
    """channel, alias (group/channel), field and limits of JSON files; the first file that names a channel wins."""
    rows = spark.read.schema(CHANNELS).option("multiLine", True).json(path).select("group", F.col("_metadata.file_name").alias("file"), F.explode("channels").alias("channel", "spec"))
    first = Window.partitionBy("channel").orderBy("file")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    rows = rows.select("channel", F.concat_ws("/", "group", "channel").alias("alias"), F.explode("spec.fields").alias("field", "f"))
    return rows.select("channel", "alias", "field", "f.*")


EVENT = T.StructType(
    [
        T.StructField("t", T.StringType()), T.StructField("e", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("fg", T.StringType()), T.StructField("w", T.LongType()),
        T.StructField("hits", T.MapType(T.StringType(), T.LongType())), T.StructField("pb", T.StringType()), T.StructField("rev", T.LongType()), T.StructField("er", T.DoubleType()), T.StructField("fe", T.LongType()),
        T.StructField("k", T.StringType()), T.StructField("r", T.StringType()), T.StructField("_corrupt", T.StringType()),
    ]
)


def events(spark: SparkSession, path: str) -> DataFrame:
    """Parsed event lines; broken ones, too long ones and those without a valid week are left out."""
    rows = spark.read.text(path).where(F.octet_length("value") <= MAX_EVENT_BYTES)
    rows = rows.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("v")).select("v.*")
    return rows.where("_corrupt is null and t in ('lint', 'out', 'health')").where(F.col("e").rlike("^[0-9]{4}-W(?:0[1-9]|[1-4][0-9]|5[0-3])$")).drop("_corrupt")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: one a line, without comments and blanks."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("word")).where("word != ''")


def ngram_index(spark: SparkSession, path: str, language: str, sensitive: DataFrame | None = None) -> DataFrame:
    """id, phrase of lines whose id is the hash of the phrase, of four words at most, without the words of a sensitive list (word)."""
    rows = spark.read.text(path).where(~F.ltrim("value").startswith("#")).select(F.split(F.trim("value"), r"\s+", 2).alias("p")).where("size(p) = 2").select(F.col("p")[0].alias("id"), F.col("p")[1].alias("phrase"))
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(language), F.lit("ng"), nfc("phrase")), 256), 1, 10)
    rows = rows.where((F.size(F.split("phrase", " ")) <= 4) & (F.col("id") == F.concat(F.lit(f"ng-{language}-"), digest)))
    if sensitive is None:
        return rows
    bad = rows.select("id", F.explode(F.split(F.lower("phrase"), " ")).alias("w")).join(sensitive.select(F.lower("word").alias("w")).distinct(), "w", "left_semi").select("id")
    return rows.join(bad.distinct(), "id", "left_anti")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, first, last, level, title, anchor of Markdown sections; headings inside fenced code are none.

    A fold over a document's headings, last one first, keeps where the next
    heading of each level or a higher one begins.
    """
    from ..operators.segment import clean

    lines = F.transform(F.split(clean(F.col("text")), "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    fence = lambda ln: ln["text"].rlike("^[ \t]{0,3}(?:```|~~~)")
    head = "struct<line:int,text:string>"
    start = F.struct(F.lit(False).alias("open"), F.array().cast(f"array<{head}>").alias("out"))

    def step(s: Column, ln: Column) -> Column:
        heading = ~s["open"] & ln["text"].rlike(r"^[ \t]{0,3}#{1,6}[ \t]+\S")
        return F.struct(F.when(fence(ln), ~s["open"]).otherwise(s["open"]).alias("open"), F.when(heading, F.concat(s["out"], F.array(ln.cast(head)))).otherwise(s["out"]).alias("out"))

    rows = docs.select("doc_id", lines.alias("lines")).select("doc_id", F.size("lines").alias("end"), F.aggregate("lines", start, step, lambda s: s["out"]).alias("heads"))
    level = lambda t: F.length(F.regexp_extract(t, "(#{1,6})", 1))
    title = lambda t: F.trim(F.regexp_replace(t, "^[ \t]*#{1,6}[ \t]+|[ \t]+#*[ \t]*$", ""))
    section = "struct<first:int,last:int,level:int,title:string>"
    nexts = F.array_repeat(F.col("end") + 1, 6)
    begin = F.struct(nexts.alias("next"), F.array().cast(f"array<{section}>").alias("out"))

    def close(s: Column, h: Column) -> Column:
        own = level(h["text"])
        made = F.struct(h["line"].alias("first"), (F.element_at(s["next"], own) - 1).alias("last"), own.alias("level"), title(h["text"]).alias("title")).cast(section)
        # This heading ends the sections of its level and of those below it.
        return F.struct(F.transform(s["next"], lambda n, i: F.when(i + 1 >= own, h["line"]).otherwise(n)).alias("next"), F.concat(s["out"], F.array(made)).alias("out"))

    found = F.aggregate(F.reverse("heads"), begin, close, lambda s: F.reverse(s["out"]))
    out = rows.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")
    return out.withColumn("anchor", slug(F.col("title")))


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    """lang, code, level, issued of the overlays in a folder; of one code the overlay of the last name wins, and keeps the first date."""
    schema = "issued string, lang map<string,struct<severity:map<string,string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), "issued", F.explode("lang").alias("lang", "spec"))
    rows = rows.select("file", "issued", "lang", F.explode("spec.severity").alias("code", "level"))
    return rows.groupBy("lang", "code").agg(F.max_by("level", "file").alias("level"), F.min("issued").alias("issued"))
