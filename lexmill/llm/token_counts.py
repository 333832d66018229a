"""Exact token counts of texts and of all their prefixes.

The prefix dynamic programme of a pre-token gives the number of tokens of
each of its prefixes; ``PrefixSteps`` strings these together into the token
count at every prefix of a text, stored as steps of two bytes from one prefix
to the next.  ``prefix_table`` keeps the steps of every text, and truncation
and budget questions (``budget``) are look-ups in them, without the text and
without encoding again.  Only pre-tokens whose prefixes split differently
(white-space runs, contractions, special strings) get their own treatment.

Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows are counted
each; columns beside ``doc_id`` and ``text`` are not read, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit as bk
from .bpe import PieceCache, Tokenizer, mapped, tokenizer_of
from .common import prepare, text_or_empty


class PrefixCounts:
    """``counts[i]``: tokens of the first ``i`` code points of a text."""

    def __init__(self, tokenizer: Tokenizer, text: str):
        if tokenizer.folded:
            raise ValueError("prefix counts need a tokenizer without a normaliser")
        self._tokenizer = tokenizer
        self.text = text
        self.counts = [0]
        self._settled = 0  # tokens of the pieces so far, as they stand in the whole text
        parts = tokenizer.parts(text)
        for k, part in enumerate(parts):
            if k % 2:
                self._special(part, parts[k - 1])
            else:
                self._plain(part)

    def _local(self, piece: str) -> list[int]:
        """Counts of a piece's prefixes at code-point borders, each prefix being one pre-token."""
        by_byte = self._tokenizer.encoder.prefix_counts(mapped(piece))
        if piece.isascii():
            return by_byte
        return [by_byte[b - 1] for b in accumulate(len(c.encode()) for c in piece)]

    def alone(self, piece: str) -> list[int]:
        """Counts of a piece's prefixes; those of a contraction are pieces of their own."""
        if piece[0] == "'" and len(piece) <= 3:
            return [self._whole(piece[: i + 1]) for i in range(len(piece))]
        return self._local(piece)

    def joined(self, run: str, piece: str) -> list[int]:
        """Counts of a white-space run with the prefixes of the next piece that go on with it."""
        return self._local(run + piece)[len(run) :] if piece.isspace() else self._local(run + piece[0])[-1:]

    def _whole(self, text: str) -> int:
        encode = self._tokenizer.encoder.encode
        return sum(len(encode(mapped(p))) for p in self._tokenizer.pieces(text))

    def _plain(self, part: str) -> None:
        run, before_run = "", 0  # white space that a prefix may end in as one longer run
        for piece in self._tokenizer.pieces(part):
            base = self._settled
            local = self.alone(piece)
            self._settled += local[-1]
            here = [base + c for c in local]
            if run and piece[0].isspace():
                joined = self.joined(run, piece)
                here[: len(joined)] = [before_run + c for c in joined]
            self.counts += here
            if piece.isspace():
                run, before_run = run + piece, before_run if run else base
            else:
                run = ""

    def _special(self, mark: str, before: str) -> None:
        """Prefixes inside a special string are plain text that joins what stands before it."""
        pieces = self._tokenizer.pieces(before)
        tail = "".join(pieces[-3:])
        known = self._settled - self._whole(tail)
        self.counts += [known + self._whole(tail + mark[:i]) for i in range(1, len(mark))]
        self._settled += 1
        self.counts.append(self._settled)

    @property
    def total(self) -> int:
        return self._settled

    def fits(self, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens."""
        return next(i for i in range(len(self.counts) - 1, -1, -1) if self.counts[i] <= limit)


_SECOND_SPACE = re.compile(r"(?<=\s)\s")


class PrefixSteps:
    """Steps of the token count from each prefix of a text to the next; its caches are a task's own."""

    def __init__(self, tokenizer: Tokenizer):
        self._tokenizer = tokenizer
        self._empty = PrefixCounts(tokenizer, "")
        self._of = PieceCache(lambda piece: bytes(self._empty.alone(piece))).__getitem__
        self._behind = PieceCache(self._behind_run, longest=2)

    def _behind_run(self, pair: tuple[str, str]) -> tuple[np.ndarray, int]:
        """Steps of a piece behind a white-space piece, and the tokens that the pieces have over the last prefix, where both are one run."""
        run, piece = pair
        settled = self._empty.alone(run)[-1]
        counts = [settled + c for c in self._empty.alone(piece)]
        whole = counts[-1]
        joined = self._empty.joined(run, piece)
        counts[: len(joined)] = joined
        return np.diff(np.array([settled, *counts])), whole - counts[-1]

    def _whole(self, text: str) -> np.ndarray:
        return np.diff(np.array(PrefixCounts(self._tokenizer, text).counts))

    def __call__(self, text: str) -> np.ndarray:
        if len(self._tokenizer.parts(text)) > 1:
            return self._whole(text)
        pieces = self._tokenizer.find(text)
        if not pieces:
            return np.empty(0, np.int16)
        try:
            found = list(map(self._of, pieces))
        except ValueError:  # a pre-token of more tokens than a byte counts
            return self._whole(text)
        count = np.frombuffer(b"".join(found), np.uint8).astype(np.int16)
        size = np.fromiter(map(len, found), np.int64, len(found))
        start = np.cumsum(size) - size
        steps = np.empty_like(count)
        np.subtract(count[1:], count[:-1], out=steps[1:])
        steps[start] = count[start]
        # A prefix may end in a white-space run that the whole text divides: there a piece goes on with the one before it.
        second = [m.start() for m in _SECOND_SPACE.finditer(text)]
        if second:
            at = np.searchsorted(start, second)
            at = at[at < len(start)]
            at = np.unique(at[np.isin(start[at], second)]).tolist()
            for i, k in enumerate(at):
                if i and at[i - 1] == k - 1:
                    return self._whole(text)
                own, owed = self._behind[pieces[k - 1], pieces[k]]
                steps[start[k] : start[k] + size[k]] = own
                if owed:
                    steps[start[k + 1]] += owed
        return steps


def longest_prefix(steps: np.ndarray, limit: int) -> tuple[int, int]:
    """Tokens of a whole text, and code points of its longest prefix of at most ``limit`` tokens."""
    total = int(steps.sum(dtype=np.int64))
    if total <= limit:
        return total, len(steps)
    within = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= limit)
    return total, int(within[-1]) + 1 if len(within) else 0


def _steps(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = PrefixSteps(tokenizer_of(path))
        for batch in batches:
            found = pa.array((steps(text).astype("<i2").tobytes() for text in batch.column("text").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), found], names=["doc_id", "n_bytes", "steps"])

    return run


def _count(path: str | None, limit: int):
    """Counts and cuts, from texts or from stored steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = PrefixSteps(tokenizer_of(path)) if path else lambda raw: np.frombuffer(raw, "<i2")
        for batch in batches:
            found = [longest_prefix(steps(x), limit) for x in batch.column("text" if path else "steps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], names=_COUNTED)

    return run


_COUNTED = ["doc_id", "n_bytes", "n_tokens", "fit_chars"]


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))


def _counted(rows: DataFrame, path: str | None, limit: int) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTED])
    return rows.mapInArrow(bk.tidy(_count(path, limit)), schema).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, and steps: how the token count grows from each prefix to the next (two bytes a code point)."""
    return _texts(docs).mapInArrow(bk.tidy(_steps(path)), "doc_id long, n_bytes long, steps binary")


def budget(table: DataFrame, limit: int) -> DataFrame:
    """What ``token_counts`` returns, for any limit, from a prefix table."""
    prepare(table.sparkSession)
    return _counted(table.select("doc_id", "n_bytes", "steps"), None, limit)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the code points of the longest prefix within the limit."""
    return _counted(_texts(docs), path, limit)
