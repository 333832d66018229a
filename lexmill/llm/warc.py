"""WARC archives: writing with payload deduplication, and boundary-chain reading.

Writing is one text-sink job: a record is a string, and the line separator
is the second half of the record's end.  Of records with equal payloads of
``REVISIT_BYTES`` or more, the one with the smallest page_id is a response
and the others revisit it; a page_id that stands on several rows with that
payload gives as many responses.

Reading splits archives at every occurrence of the version line, also
inside payloads.  Each piece that starts with a readable header proposes an
edge from its offset to the offset after its declared length.  Per archive,
pointer jumping from the file's start keeps the records on the chain;
pieces off the chain are parts of the payload before them.

A null html is an empty payload, a null url gives no target header, and a
null page_id reads back as null.  Repeated rows are records of their own;
columns beside page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytekit as bk
from .common import materialise, maybe_in, prepare, scratch_path

VERSION = "WARC/1.1\r\n"
REVISIT_BYTES = 100
RECORDS_PER_FILE = 20_000
#: Repeated payloads that are broadcast (100 bytes each), at most; more are joined with a salt.
BROADCAST_DIGESTS = 50_000
SALTS = 32
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, its size and digest, record_type and refers_to of every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    groups = base.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialise(groups.select("payload_digest", "response_id", F.xxhash64("payload_digest").alias("id")), "repeated")
    revisit = F.coalesce((F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("page_id") != F.col("response_id")), F.lit(False))
    joined = _with_response(base, repeated)
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("response_id")))


def _with_response(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with the response of their payload, if it repeats: payloads that a bitmap clears stay where they are, the others are dealt by digest and a salt."""
    if repeated.count() <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(repeated.drop("id")), "payload_digest", "left")
    marked = rows.withColumn("may", maybe_in(repeated, "id", F.xxhash64("payload_digest")))
    salted = repeated.drop("id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = marked.where("may").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "salt"], "left").drop("salt")
    return marked.where("not may").withColumn("response_id", F.lit(None).cast("long")).unionByName(met).drop("may")


def _header(name: str, value) -> F.Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    rows = records(pages)
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("payload")))
    urn = lambda page: F.concat(F.lit("<urn:lexmill:page:"), page.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(VERSION),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:lexmill:page:null>"))),
        _header("WARC-Target-URI", F.regexp_replace("url", "[\r\n\t ]+", "%20")),
        _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _header("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _header("WARC-Refers-To", urn(F.col("refers_to"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )
    writer = rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)


def parse_header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of the header that starts a piece, and its length; None if there is none."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit():
        return None
    return fields, end + 4


def _page(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def summary(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload of a whole record."""
    kind = fields.get("warc-type", "")
    _, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        size, digest, payload = int(fields.get("x-payload-length", 0)), fields.get("warc-payload-digest", "").rpartition(":")[2], b""
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, kind, _page(fields.get("warc-refers-to")), payload


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PIECES = f"file string, block long, at long, size long, span long, whole boolean, {_RECORD}"


def _pieces(payloads: bool):
    """Every piece's place in its split, declared span, and, if it is a whole record by itself, what it says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = None, 0
        extra = len(VERSION)
        for batch in batches:
            rows: list[tuple] = []
            for file, block, piece in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if (file, block) != where:
                    where, at = (file, block), 0
                span, whole, said = None, False, (None,) * 7
                parsed = parse_header(piece)
                if parsed:
                    fields, head = parsed
                    length = int(fields["content-length"])
                    span = head + length + 4
                    whole = len(piece) in (span, span + extra) and piece[head + length : span] == b"\r\n\r\n"
                    if whole:
                        said = summary(fields, piece[head : head + length])
                        if not payloads:
                            said = (*said[:6], None)
                rows.append((file, block, at, len(piece), span, whole, *said))
                at += len(piece) + extra
            columns = list(zip(*rows, strict=True)) or [[]] * 13
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return run


_ARROW = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("span", pa.int64()), ("whole", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the sorted offsets lie on the chain from the first, by pointer jumping; successors may be -1 or nowhere."""
    n = len(offset)
    on = np.zeros(n + 1, bool)
    on[0] = n > 0
    place = np.minimum(np.searchsorted(offset, successor), n - 1) if n else np.empty(0, np.int64)
    jump = np.append(np.where((successor > offset) & (offset[place] == successor), place, n), n) if n else np.array([0])
    for _ in range(max(1, int(n).bit_length())):
        on[jump[on]] = True
        jump = jump[jump]
    return on[:n]


def _chain(pieces: pd.DataFrame) -> pd.DataFrame:
    """For one archive: the record on the chain that each piece belongs to."""
    extra = len(VERSION)
    pieces = pieces.sort_values(["block", "at"], kind="stable")
    length = pieces["size"].to_numpy() + extra
    # A piece starts behind its version line; the piece before the first version line is none.
    begin = np.concatenate([[0], np.cumsum(length)[:-1]]) - extra
    span = pieces["span"].to_numpy(dtype=float, na_value=np.nan)
    successor = np.where(np.isnan(span), -1, begin + extra + np.nan_to_num(span, nan=0)).astype(np.int64)
    real = begin >= 0
    first = np.flatnonzero(real)
    on = np.zeros(len(begin), bool)
    if len(first) and begin[first[0]] == 0:
        on[first] = reachable(begin[first], successor[first])
    record = np.maximum.accumulate(np.where(on, np.arange(len(begin)), -1))
    # Behind the chain's end there are no records.
    inside = (record >= 0) & (begin < successor[np.maximum(record, 0)])
    out = pieces[["file", "block", "at"]].assign(record=begin[np.maximum(record, 0)], order=np.arange(len(begin)), lead=on)[inside]
    out["parts"] = out.groupby("record")["record"].transform("size")
    return out


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of archives in a folder; ``payloads`` also returns the payload bytes (empty for revisits)."""
    prepare(spark)
    raw = spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    columns = [c.split()[0] for c in _RECORD.split(", ")]
    pieces = raw.mapInArrow(bk.tidy(_pieces(payloads)), _PIECES)
    if not payloads:
        pieces = materialise(pieces.drop("payload").withColumn("payload", F.lit(None).cast("binary")), "pieces")
    # Offsets alone meet per archive: 40 bytes for each piece of a file of bounded size.
    chain = pieces.select("file", "block", "at", "size", "span").groupBy("file").applyInPandas(_chain, "file string, block long, at long, record long, order long, lead boolean, parts long")
    chain = materialise(chain, "chain")
    place = ["file", "block", "at"]
    single = pieces.where("whole").join(chain.where("lead and parts = 1").select(*place), place, "left_semi").select(*columns)
    several = chain.where("parts > 1")
    if several.isEmpty():
        return single
    # Payloads that hold the version line: their pieces are read again and joined.
    again = raw.mapInArrow(bk.tidy(_bodies), "file string, block long, at long, piece binary").join(several, place)
    joined = again.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("order", "piece"))).alias("pieces"))
    return single.unionByName(joined.select("pieces").mapInArrow(bk.tidy(_join(payloads)), _RECORD))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where, at = None, 0
    for batch in batches:
        places = []
        for file, block, size in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), pa.compute.binary_length(batch.column("piece")).to_pylist(), strict=True):
            if (file, block) != where:
                where, at = (file, block), 0
            places.append(at)
            at += size + len(VERSION)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(places, pa.int64()), batch.column("piece")], names=["file", "block", "at", "piece"])


def _join(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(_ARROW)[6:])
        for batch in batches:
            rows = []
            for pieces in batch.column("pieces").to_pylist():
                whole = VERSION.encode().join(p["piece"] for p in pieces)
                fields, head = parse_header(whole)
                said = summary(fields, whole[head : head + int(fields["content-length"])])
                rows.append(said if payloads else (*said[:6], None))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
