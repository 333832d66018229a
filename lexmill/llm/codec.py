"""BPE encoding and decoding of whole texts by prefix dynamic programming.

Null texts encode as empty; repeated rows are encoded each; columns beside
``doc_id`` and ``text`` are not read, whatever their names.  Decoding joins the tokens' texts by one space,
as a vocabulary without a decoder does; special strings in a text become
their special ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit as bk
from .bpe import Tokenizer, code_cache, tokenizer_of
from .common import prepare, text_or_empty


def decode(tokenizer: Tokenizer, ids: list[int]) -> str:
    return " ".join([tokenizer.text_of[i] for i in ids])


def _encode(path: str, names: list[str], full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, code = tokenizer_of(path), code_cache(path).__getitem__
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for text in texts:
                pairs: list[tuple[str, str]] = []
                for k, part in enumerate(tokenizer.parts(text)):
                    if k % 2:
                        pairs.append((str(tokenizer.special[part]), part))
                    else:
                        pairs += map(code, tokenizer.pieces(part))
                ids, decoded = " ".join([a for a, _ in pairs]), " ".join([b for _, b in pairs])
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if full:
                    out["ids"].append(list(map(int, ids.split())))
                    out["decoded"].append(decoded)
            arrays = [pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            if full:
                arrays += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], names=[*names, *list(out)[: len(arrays)]])

    return run


def encode(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; with ``full`` also the ids and the decoded text."""
    prepare(docs.sparkSession)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if full:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("__text"))
    return narrow.mapInArrow(bk.tidy(_encode(path, ["doc_id"], full)), T.StructType(fields))
