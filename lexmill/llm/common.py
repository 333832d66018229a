"""Shared plumbing of the corpus operators: shared scratch tables, guards, digests."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: str | None = None
#: Scratch paths with their sessions, and the open scopes' paths.
_PATHS: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []
#: Scratch tables that are still held, with their paths.
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

#: Arrow batches of long texts stay small, so a worker holds a few MB at a time.
ARROW_ROWS = 512
ARROW_BYTES = "8m"
#: Ids broadcast as a table, at most; and bits of a broadcast bitmap.
BROADCAST_IDS = 200_000
BITMAP_BITS = 1 << 28


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and let local workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); an own temporary one only where it is unset and all runs on this machine."""
    global _OWN_DIR
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="lexmill-")
    return f"file://{_OWN_DIR}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes with the scope it is made in, or at exit."""
    path = f"{scratch_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex}"
    _PATHS[path] = spark
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def release(path: str) -> None:
    spark = _PATHS.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch
        pass


@atexit.register
def _release_all() -> None:
    for path in list(_PATHS):
        release(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Frees the tables made inside when it ends, but those written by the function it gives."""
    paths: list[str] = []
    _SCOPES.append(paths)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        path = paths.pop()
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)
        return out

    try:
        yield keep
    finally:
        _SCOPES.pop()
        for path in paths:
            release(path)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def free(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote; other tables are left alone."""
    if path := _TABLES.pop(df, None):
        release(path)


class _Bits:
    """A hashed bitmap of ids: says no only where an id is none of them."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size

    def holds(self, hashed: np.ndarray) -> np.ndarray:
        at = hashed.view(np.uint64) & np.uint64(self.size - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1


def maybe_in(ids: DataFrame, column: str, value: Column) -> Column:
    """Whether a value may be one of the ids of a written table: a filter before an exact join, of bounded size.

    The bitmap has 16 bits an id, up to ``BITMAP_BITS``; beyond that it only passes more.
    """
    spark = ids.sparkSession
    size = 1 << 16
    while size < min(BITMAP_BITS, 16 * ids.count()):
        size *= 2
    at = F.xxhash64(F.col(column).cast("long")).bitwiseAND(size - 1)
    bits = ids.select(at.alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
    table_ = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(size >> 6, np.uint64)
    words[table_.column("word").to_numpy()] = table_.column("bits").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(_Bits(words, size))

    # Arrow arrays, not pandas: its import would cost every worker 40 MB.
    @F.arrow_udf("boolean")
    def may(hashed: pa.Array) -> pa.Array:
        return pa.array(held.value.holds(hashed.to_numpy(zero_copy_only=False)))

    return may(F.xxhash64(value.cast("long")))


def without_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is none of a written table's; a null id is none.

    Rows that the bitmap clears stay where they are; the others meet the table itself.
    """
    if ids.isEmpty():
        return rows
    n = ids.count()
    right = ids.select(F.col(ids.columns[0]).cast("long").alias("__id"))
    same = rows[column].cast("long") == right["__id"]
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(right), same, "left_anti")
    marked = rows.select(F.struct(*rows.columns).alias("row"), F.col(column).cast("long").alias("id")).withColumn("may", maybe_in(ids, ids.columns[0], F.col("id")))
    clear = marked.where("not may").select("row.*")
    return clear.unionByName(marked.where("may").join(right, F.col("id") == F.col("__id"), "left_anti").select("row.*"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
