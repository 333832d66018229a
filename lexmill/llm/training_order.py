"""Training-order materialisation: fixed-stride shards in a keyed random order.

The texts of a file split form one stream of token ids, every text closed by
``layout.end``, cut into sequences of a fixed length; only a split's last
sequence is padded.  ``Layout.of`` a vocabulary gives its ids, of two bytes
each or of four for large vocabularies; ranks of a public vocabulary are read
by its own library.  Texts are encoded twice, to count the tokens of each
split and to cut them, which costs less than keeping them.  The two ids after
the vocabulary's, which no text has, close and pad.  A layout without a
vocabulary takes the bytes of the texts as tokens.  Sequences are numbered
along the splits; a keyed Feistel permutation with cycle-walking maps the
numbers one to one onto global slots.  A range of slots is a shard, written
as one file whose records all have the same length, so slot ``s`` stands at
byte ``(s mod shard_rows) * stride`` of shard ``s div shard_rows``, and a
reader can stop and resume anywhere.  A writing task takes a range of shards.

A record is the sequence's number (8 bytes), the doc_id at its first token
(8), that token's place in the document's tokens (8), the number of tokens
(4), the tokens (all little-endian), and a line feed.  Null and empty texts
are a lone end; a null doc_id is stored as ``NO_ID`` and read as null;
repeated rows are texts of their own; other columns are not read, whatever
their names.  An empty table has no shards.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytekit as bk
from .bpe import id_packer, tokenizer_of
from .common import materialise, prepare, scratch_path, text_or_empty

#: Byte values that no UTF-8 text has, for layouts without a vocabulary.
PAD, END = 0xFE, 0xFF
NO_ID = -(1 << 63)
#: Record bytes that a writing task gets on average, at most.
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Layout:
    """Tokens of a sequence, sequences of a shard, and the permutation's key."""

    tokens: int = 2048
    shard_rows: int = 4096
    key: int = 0x1D872B41F3A5C96E
    #: Splits up to this number are broadcast (100 bytes each); more are joined by shuffle.
    broadcast_splits: int = 50_000
    #: Path of the tokenizer whose ids the tokens are, their type, and the ids that close a text and pad a sequence.
    vocabulary: str | None = None
    item: str = "u1"
    end: int = END
    pad: int = PAD
    #: For ranks: the pattern of pre-tokens, and the special strings with their ids.
    pattern: str = ""
    special: tuple[tuple[str, int], ...] = ()

    @classmethod
    def of(cls, vocabulary: str, pattern: str = "", special: tuple[tuple[str, int], ...] = (), **others) -> Layout:
        """A layout of the ids of a tokenizer, or of ranks with a pattern and special strings."""
        size = 1 + (max([*_ranks(vocabulary).values(), *(i for _, i in special)]) if pattern else max(tokenizer_of(vocabulary).text_of))
        return cls(vocabulary=vocabulary, item="<u2" if size + 2 <= 1 << 16 else "<u4", end=size, pad=size + 1, pattern=pattern, special=special, **others)

    @property
    def width(self) -> int:
        return np.dtype(self.item).itemsize

    @property
    def record(self) -> np.dtype:
        return np.dtype([("number", "<i8"), ("doc_id", "<i8"), ("place", "<i8"), ("n_tokens", "<i4"), ("tokens", self.item, (self.tokens,))])

    @property
    def stride(self) -> int:
        return self.record.itemsize + 1


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=1)
def _library(path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    import tiktoken

    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens=dict(special))


def packer_of(layout: Layout) -> Callable[[str], bytes]:
    """Ids of a text as numbers of the layout's type, joined."""
    if not layout.pattern:
        return id_packer(layout.vocabulary, layout.item)
    encode = _library(layout.vocabulary, layout.pattern, layout.special).encode_to_numpy
    return lambda text: encode(text, allowed_special="all").astype(layout.item).tobytes()


class Feistel:
    """A keyed permutation of 0 .. n-1."""

    ROUNDS = 6

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = bk.mix64(np.arange(1, self.ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _rounds(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (bk.mix64(right + key) & self.mask)
        return (left << self.half) | right

    def _undo(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ (bk.mix64(left + key) & self.mask), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, np.uint64))
        while True:  # a cycle through the domain returns to it
            outside = np.flatnonzero(out >= np.uint64(self.n))
            if not len(outside):
                return out.astype(np.int64)
            out[outside] = step(out[outside])

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self._rounds)

    def indices(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._undo)


class _Packer:
    """The stream of one split: full sequences come out as texts go in, the padded rest at the end."""

    def __init__(self, layout: Layout, base: int):
        self.layout, self.number = layout, base
        self.stream = np.empty(0, layout.item)
        # Documents that begin in the held stream, and where; the first may have begun before it.
        self.docs, self.begins = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, texts: bk.Texts, ids: np.ndarray) -> np.ndarray:
        rows = texts.rows
        data, offsets = texts.data.view(self.layout.item), texts.offsets // self.layout.width
        joined = np.full(len(data) + rows, self.layout.end, self.layout.item)
        joined[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets))] = data
        self.docs = np.concatenate([self.docs, ids])
        self.begins = np.concatenate([self.begins, len(self.stream) + offsets[:-1] + np.arange(rows)])
        self.stream = np.concatenate([self.stream, joined])
        return self._cut(len(self.stream) // self.layout.tokens)

    def finish(self) -> np.ndarray:
        rest = len(self.stream)
        if not rest:
            return np.empty(0, self.layout.record)
        self.stream = np.concatenate([self.stream, np.full(self.layout.tokens - rest, self.layout.pad, self.layout.item)])
        out = self._cut(1)
        out["n_tokens"] = rest
        return out

    def _cut(self, n: int) -> np.ndarray:
        tokens = self.layout.tokens
        out = np.zeros(n, self.layout.record)
        if not n:
            return out
        first = np.arange(n) * tokens
        at = np.searchsorted(self.begins, first, side="right") - 1
        out["number"] = np.arange(self.number, self.number + n)
        out["doc_id"], out["place"], out["n_tokens"] = self.docs[at], first - self.begins[at], tokens
        out["tokens"] = self.stream[: n * tokens].reshape(n, tokens)
        self.number += n
        self.stream = self.stream[n * tokens :]
        open_doc = int(np.searchsorted(self.begins, n * tokens, side="right")) - 1
        self.docs, self.begins = self.docs[open_doc:], self.begins[open_doc:] - n * tokens
        return out


def _places(batch: pa.RecordBatch, *columns: str) -> list[tuple[tuple, int, int]]:
    """Runs of rows of one place: the place, first row, row behind the last."""
    places = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    cuts = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]] + [len(places)]
    return [(places[lo], lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _encoded(layout: Layout) -> Callable[[pa.Array], pa.Array]:
    if not layout.vocabulary:
        return lambda texts: texts
    pack = packer_of(layout)
    return lambda texts: pa.array(map(pack, texts.to_pylist()), pa.binary())


def _counts(layout: Layout):
    """Per run of rows of a split: its tokens, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoded(layout)
        for batch in batches:
            runs = _places(batch, "file", "block")
            sizes = pc.binary_length(encode(batch.column("tokens"))).to_numpy()
            n = [int(sizes[lo:hi].sum()) // layout.width + hi - lo for _, lo, hi in runs]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p, _, _ in runs], pa.string()), pa.array([p[1] for p, _, _ in runs], pa.int64()), pa.array(n, pa.int64())], names=["file", "block", "n"])

    return run


def _records(layout: Layout, total: int):
    width = layout.record.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, encode = Feistel(total, layout.key), _encoded(layout)
        where, packer = None, _Packer(layout, 0)

        def put(rows: np.ndarray) -> pa.RecordBatch:
            ends = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int64) * width).astype(np.int32))
            body = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(np.ascontiguousarray(rows).view(np.uint8).reshape(-1))])
            return pa.RecordBatch.from_arrays([pa.array(order.slots(rows["number"]) if len(rows) else rows["number"].astype(np.int64)), body], names=["slot", "record"])

        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for place, lo, hi in _places(batch, "file", "block", "base"):
                if place != where:
                    yield put(packer.finish())
                    where, packer = place, _Packer(layout, place[2])
                for texts in bk.slices(encode(batch.column("tokens").slice(lo, hi - lo))):
                    yield put(packer.add(texts, ids[lo + texts.lo : lo + texts.hi]))
        yield put(packer.finish())

    return run


def write_shards(docs: DataFrame, path: str, layout: Layout = Layout()) -> int:
    """Write all sequences of the texts to shards in ``path``; returns their number."""
    spark = docs.sparkSession
    prepare(spark)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("tokens")]
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialise(docs.select("doc_id", "text"), "ordered")
    conf = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(conf, None)
    # Both passes must cut the files alike, however many cores there are by then.
    spark.conf.set(conf, before or str(spark.sparkContext.defaultParallelism))
    try:
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        counted = docs.select(*columns, *place).select("file", "block", "tokens").mapInArrow(bk.tidy(_counts(layout)), "file string, block long, n long")
        splits = counted.groupBy("file", "block").agg(F.sum("n").alias("n")).select("file", "block", F.ceil(F.col("n") / layout.tokens).cast("long").alias("n"))
        splits = materialise(splits, "splits")
        running = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
        bases = splits.select("file", "block", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
        facts = splits.agg(F.count(F.lit(1)).alias("splits"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        if not facts.total:
            return 0
        rows = docs.select(*columns, *place, F.col("_metadata.row_index").alias("row"))
        if facts.splits <= layout.broadcast_splits:
            rows = rows.join(F.broadcast(bases), ["file", "block"])
        else:
            rows = rows.join(bases, ["file", "block"]).sortWithinPartitions("file", "block", "row")
        records = rows.select("doc_id", "tokens", "file", "block", "base").mapInArrow(bk.tidy(_records(layout, facts.total)), "slot long, record binary")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts.total * layout.stride // TASK_BYTES))
        shards = -(-facts.total // layout.shard_rows)
        dealt = records.withColumn("shard", F.expr(f"slot div {layout.shard_rows}"))
        # A task writes a range of shards, each whole.
        dealt = dealt.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} AS int)"))
        ordered = dealt.sortWithinPartitions("shard", "slot").select(F.col("record").cast("string").alias("value"), "shard")
        ordered.write.partitionBy("shard").option("lineSep", "\n").option("maxRecordsPerFile", 0).option("compression", "none").text(path)
        return facts.total
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)


def _read(layout: Layout, first: int, last: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                rows = raw.reshape(-1, layout.stride)[:, :-1]
                slot = shard * layout.shard_rows + np.arange(len(rows))
                keep = np.flatnonzero((slot >= first) & (slot < (last if last is not None else slot[-1] + 1)))
                for lo in range(0, len(keep), 1024):
                    some = keep[lo : lo + 1024]
                    part = np.ascontiguousarray(rows[some]).view(layout.record).reshape(-1)
                    bodies = [t[:n].tobytes() for t, n in zip(part["tokens"], part["n_tokens"], strict=True)]
                    ids = pa.array(part["doc_id"], mask=part["doc_id"] == NO_ID)
                    yield pa.RecordBatch.from_arrays([pa.array(slot[some]), pa.array(part["number"]), ids, pa.array(part["place"]), pa.array(part["n_tokens"].astype(np.int64)), pa.array(bodies, pa.binary())], names=["slot", "number", "doc_id", "place", "n_tokens", "tokens"])

    return run


def read_shards(spark: SparkSession, path: str, layout: Layout = Layout(), first: int = 0, last: int | None = None) -> DataFrame:
    """slot, number, doc_id, place, n_tokens and tokens (bytes of the ids) of the slots from ``first`` up to ``last`` (not included); other shards are not opened."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path)
    shard = F.regexp_extract("path", "shard=([0-9]+)", 1).cast("long")
    files = files.select(shard.alias("shard"), "content").where(F.col("shard") >= first // layout.shard_rows)
    if last is not None:
        files = files.where(F.col("shard") * layout.shard_rows < last)
    return files.mapInArrow(bk.tidy(_read(layout, first, last)), "slot long, number long, doc_id long, place long, n_tokens long, tokens binary")


def materialised_order(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Write the shards in the shared folder and read them back: slot, shard, offset, number, doc_id, place, n_tokens, tokens_sha256."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    total = write_shards(docs, path, layout)
    if not total:
        return spark.createDataFrame([], "slot long, shard long, offset long, number long, doc_id long, place long, n_tokens long, tokens_sha256 string")
    return read_shards(spark, path, layout).select(
        "slot",
        F.floor(F.col("slot") / layout.shard_rows).cast("long").alias("shard"),
        ((F.col("slot") % layout.shard_rows) * layout.stride).cast("long").alias("offset"),
        "number",
        "doc_id",
        "place",
        "n_tokens",
        F.sha2("tokens", 256).alias("tokens_sha256"),
    )
