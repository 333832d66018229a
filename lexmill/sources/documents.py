"""Files as documents: kind from the name, decoding by byte-order mark, skipped folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values: extensions by kind, and folders that hold no copy. ----
KINDS = {
    "md": ("md", "markdown", "mdx"),
    "html": ("html", "htm", "xhtml"),
    "locale": ("json", "arb", "po", "pot", "xlf", "xliff", "strings", "xml"),
    "csv": ("csv", "tsv"),
}
SKIPPED = ("node_modules", "__pycache__", "venv", ".venv", "site-packages")
#: Files that hold no copy, and results of a fixer.
LOCK_FILES = ("package-lock.json", "npm-shrinkwrap.json", "composer.lock")
FIXED = r"\.fixed\.[^./]+$"
MAX_BYTES = 1 << 20


def kind_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(extension.isin(list(KINDS["md"])), "md")
    for kind in ("html", "locale", "csv"):
        out = out.when(extension.isin(list(KINDS[kind])), kind)
    return out.otherwise("text")


def decoded(content: Column) -> Column:
    """UTF-16 with a byte-order mark, else UTF-8 without one; line feeds only."""
    mark = F.hex(F.substring(content, 1, 2))
    text = F.when(mark == "FFFE", F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16LE")).when(mark == "FEFF", F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16BE")).otherwise(content.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, "^\\ufeff", ""), "\r\n?", "\n")


def expanded(path: Column, root: str = "") -> Column:
    """Whether a walk reads a file: not in a hidden or skipped folder below the root, no lock file, no result of a fixer."""
    inside = F.substring(path, F.lit(1) + F.when(F.contains(path, F.lit(root)), F.locate(root, path) + len(root) - 1).otherwise(0), F.length(path)) if root else path
    skipped = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    name = F.substring_index(path, "/", -1)
    return ~inside.rlike(rf"/(?:{skipped}|\.[^/]+)/") & ~F.lower(name).isin(*LOCK_FILES) & ~name.rlike(FIXED)


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id, path, kind, text of the files under a folder; large files and skipped folders are left out by the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    files = files.where((F.col("length") <= MAX_BYTES) & expanded(F.col("path"), path))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", kind_of(F.col("path")).alias("kind"), decoded(F.col("content")).alias("text"))


def from_table(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", kind: str = "text") -> DataFrame:
    return df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.lit(kind).alias("kind"))


def eligible(path: Column, length: Column) -> Column:
    """Whether a written file is checked: a known extension, not too large, one that a walk reads."""
    known = [e for group in KINDS.values() for e in group] + ["txt"]
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(known) & (length <= MAX_BYTES) & expanded(path)
