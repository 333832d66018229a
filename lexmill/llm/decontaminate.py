"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items are indexed in one suffix automaton over
words.  Training words stream through it; the longest match ending at each
word is tracked, and a word is hit if it lies inside an occurrence of a
window (``window`` consecutive item words, or a whole shorter item).  A
vectorised filter on adjacent word pairs first finds the stretches where a
match can reach a window at all, so the automaton reads only those.

Benchmarks of any size: items are dealt to shards, whose automata have a
bounded size and are built on executors.  The texts pass a few automata in
one chained, shuffle-free plan.  If there are more, each few make a pass of
their own over the texts that keeps only the hits, under the texts' hashes; a
bitmap tells the texts that have any, and only those meet their hits.  The
driver holds one automaton at a time, in pickled form.

Null and empty texts have no words and no hits; items without words never
occur; items with a null id give hits but are not listed; repeated items
and rows count as themselves.  Input columns of any name pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit as bk
from .common import materialise, maybe_in, prepare, scratch


@dataclass(frozen=True)
class ContaminationLimits:
    """A text is contaminated if hits make up ``1 / coverage_inverse`` of its words; spans longer than ``max_span`` words are removed."""

    window: int = 13
    coverage_inverse: int = 20
    max_span: int = 12
    #: Text of a shard's items on average, and shards that the texts pass at once.
    shard_bytes: int = 1 << 20
    pass_shards: int = 4


class SuffixAutomaton:
    """A generalised suffix automaton over lists of hashed words."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.window = window
        vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.empty(0, np.uint64)
        self.vocabulary = vocabulary
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        ends: list[list[int]] = []
        pairs = [np.empty(0, np.uint64)]
        for _, hashes in items:
            last, path = 0, []
            for word in np.searchsorted(vocabulary, hashes).tolist():
                last = self._extend(last, word)
                path.append(last)
            ends.append(path)
            pairs.append(self.pair_keys(hashes))
        self.pairs = np.unique(np.concatenate(pairs))
        self.sketch = np.zeros(1 << 20, bool)
        self.sketch[(self.pairs & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.shortest = min((min(window, len(h)) for _, h in items if len(h)), default=0)
        self.singles = np.unique(np.array([h[0] for _, h in items if len(h) == 1], np.uint64))
        self._annotate(items, ends)

    @staticmethod
    def pair_keys(hashes: np.ndarray) -> np.ndarray:
        return bk.mix64(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:]) if len(hashes) > 1 else np.empty(0, np.uint64)

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, word, known)
        made = self._new(length[last] + 1, {}, -1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = made
            at = link[at]
        if at < 0:
            link[made] = 0
            return made
        target = nxt[at][word]
        link[made] = target if length[target] == length[at] + 1 else self._split(at, word, target)
        return made

    def _split(self, at: int, word: int, target: int) -> int:
        copy = self._new(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _annotate(self, items, ends) -> None:
        """Items of each state that holds a window, and the nearest suffix that is a whole short item."""
        link, length, window = self.link, self.length, self.window
        owners: list[set[int]] = [set() for _ in link]
        short: list[list[int]] = [[] for _ in link]
        for k, path in enumerate(ends):
            for state in path:
                while state > 0 and length[state] >= window and k not in owners[state]:
                    owners[state].add(k)
                    state = link[state]
            if path and len(path) < window:
                short[self._holding(path[-1], len(path))].append(k)
        self.owners = [frozenset(x) for x in owners]
        self.short, self.short_length = short, [0] * len(link)
        self.short_up = [0] * len(link)
        for state in sorted(range(1, len(link)), key=length.__getitem__):
            up = link[state]
            self.short_up[state] = up if up > 0 and short[up] else self.short_up[max(up, 0)]
            if short[state]:
                self.short_length[state] = len(ends[short[state][0]])
        self.names = [name for name, _ in items]

    def _holding(self, state: int, size: int) -> int:
        while state > 0 and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def stretches(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges where every adjacent pair is one of the items', long enough for some window."""
        n = len(hashes)
        if not n or not self.shortest:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        joined = np.zeros(n + 1, bool)  # joined[i]: words i-1 and i form a pair
        if n > 1:
            key = self.pair_keys(hashes)
            maybe = np.flatnonzero(self.sketch[(key & np.uint64(0xFFFFF)).astype(np.int64)] & (row[1:] == row[:-1]))
            joined[maybe[np.isin(key[maybe], self.pairs)] + 1] = True
        begin = ~joined[:-1]
        stop = ~joined[1:]
        first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        keep = last - first >= max(2, self.shortest)
        if len(self.singles):
            alone = np.flatnonzero(last - first == 1)
            keep[alone[np.isin(hashes[first[alone]], self.singles)]] = True
        return first[keep], last[keep]

    def scan(self, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (merged, half open) of one stretch, and the items whose windows occur in it."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        ids = np.where(self.vocabulary[at] == hashes, at, -1).tolist()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        for i, word in enumerate(ids):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            else:
                state = matched = 0
                continue
            reach = 0
            if matched >= window:
                reach = window
                holder = self._holding(state, window)
                if holder not in seen:
                    seen.add(holder)
                    found |= self.owners[holder]
            up = state if self.short[state] else self.short_up[state]
            while up:
                size = self.short_length[up]
                if size <= matched:
                    reach = max(reach, size)
                    found.update(self.short[up])
                up = self.short_up[up]
            if reach:
                lo = i + 1 - reach
                while spans and spans[-1][1] >= lo:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, i + 1))
        return spans, found


class Packed:
    """An automaton in pickled form, opened on first use and then held by the worker."""

    def __init__(self, blob: bytes):
        self.blob = blob

    @property
    def automaton(self) -> SuffixAutomaton:
        opened = self.__dict__.get("opened")
        if opened is None:
            opened = self.__dict__["opened"] = pickle.loads(self.blob)
            self.blob = b""
        return opened


def _built(window: int):
    def run(items: pa.Table) -> pa.Table:
        held = []
        for name, raw in zip(items.column("item_id").to_pylist(), items.column("text").to_pylist(), strict=True):
            data = raw.encode()
            texts = bk.Texts(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))
            w = bk.words(texts, bk.ALNUM)
            if len(w.start):
                held.append((name, bk.span_hashes(texts.data, w.start, w.end, bk.LOWERED)))
        return pa.table({"automaton": pa.array([pickle.dumps(SuffixAutomaton(held, window), pickle.HIGHEST_PROTOCOL)] if held else [], pa.binary())})

    return run


def shards(benchmark: DataFrame, limits: ContaminationLimits) -> Iterator[Packed]:
    """Automata of about ``shard_bytes`` of item text each, one after the other."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // limits.shard_bytes))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    built = materialise(dealt.groupBy("shard").applyInArrow(_built(limits.window), "automaton binary"), "automata")
    for row in built.toLocalIterator():
        yield Packed(bytes(row.automaton))


SCANNED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_first", T.ArrayType(T.LongType(), False)),
        T.StructField("hit_last", T.ArrayType(T.LongType(), False)),
        T.StructField("items", T.ArrayType(T.StringType(), False)),
    ]
)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _scan(automaton_of, names: list[str]):
    """A pass over the texts; hits and items of earlier passes are kept and merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of.value.automaton
        for batch in batches:
            for texts in bk.slices(batch.column("text")):
                w = bk.words(texts, bk.ALNUM)
                hashes = bk.span_hashes(texts.data, w.start, w.end, bk.LOWERED)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(texts.rows)]
                items: list[set[str]] = [set() for _ in range(texts.rows)]
                part = batch.slice(texts.lo, texts.rows)
                if "items" in batch.schema.names:
                    for i, (a, b, c) in enumerate(zip(part.column("hit_first").to_pylist(), part.column("hit_last").to_pylist(), part.column("items").to_pylist(), strict=True)):
                        spans[i], items[i] = list(zip(a, b, strict=True)), set(c)
                for lo, hi in zip(*automaton.stretches(hashes, w.row), strict=True):
                    hit, found = automaton.scan(hashes[lo:hi])
                    if hit:
                        row = w.row[lo]
                        base = lo - w.first[row]
                        spans[row] += [(int(a + base), int(b + base)) for a, b in hit]
                        items[row] |= {automaton.names[k] for k in found if automaton.names[k] is not None}
                merged = [_merge(x) for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in names),
                        pa.array(w.counts.astype(np.int64)),
                        pa.array([[a for a, _ in x] for x in merged], pa.list_(pa.int64())),
                        pa.array([[b for _, b in x] for x in merged], pa.list_(pa.int64())),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    names=[*names, *SCANNED.names],
                )

    return run


def _passed(texts: DataFrame, names: list[str], automata: list) -> DataFrame:
    """The texts with what a few automata find in them."""
    carried, out = list(texts.schema.fields), texts
    for held in automata:
        out = out.mapInArrow(bk.tidy(_scan(held, names)), T.StructType([*carried, *SCANNED.fields]))
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several passes found in one text."""
    for batch in batches:
        first, last, items = [], [], []
        for found in batch.column("found").to_pylist():
            spans = _merge([s for f in found for s in zip(f["hit_first"], f["hit_last"], strict=True)])
            first.append([a for a, _ in spans])
            last.append([b for _, b in spans])
            items.append(sorted({i for f in found for i in f["items"]}))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(first, pa.list_(pa.int64())), pa.array(last, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["key", *SCANNED.names[1:]])


def _in_passes(texts: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The texts with what was found under their hashes."""
    rows = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.collect_list(F.struct(*SCANNED.names[1:])).alias("found"))
    schema = T.StructType([T.StructField("key", T.StringType()), *SCANNED.fields[1:]])
    hits = materialise(rows.mapInArrow(bk.tidy(_merged), schema).withColumn("id", F.xxhash64("key")), "hits")
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]++")).cast("long").alias("n_words")
    marked = texts.select("*", n_words, key.alias("key")).withColumn("may", maybe_in(hits, "id", F.xxhash64("key")))
    nothing = {c.name: F.array().cast(c.dataType) for c in SCANNED.fields[1:]}
    columns = [*texts.columns, *SCANNED.names]
    clear = marked.where("not may").withColumns(nothing).select(columns)
    met = marked.where("may").join(hits.drop("id"), "key", "left")
    return clear.unionByName(met.select(*texts.columns, "n_words", *(F.coalesce(F.col(c), empty).alias(c) for c, empty in nothing.items())))


def scan(docs: DataFrame, benchmark: DataFrame, limits: ContaminationLimits = ContaminationLimits()) -> DataFrame:
    """The input row but its text as one struct, the text, word count, hit word ranges (half open) and item ids."""
    spark = docs.sparkSession
    prepare(spark)
    out = docs.select(F.struct(F.lit(0).alias("__row"), *(F.col(c) for c in docs.columns if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))
    with scratch(spark) as keep:
        found: list[DataFrame] = []
        held: list = []
        for packed in shards(benchmark, limits):
            if len(held) == limits.pass_shards:
                found.append(_hits_of(out, held, keep))
                held = []
            held.append(spark.sparkContext.broadcast(packed))
        if found:
            found.append(_hits_of(out, held, keep))
    if found:
        out = _in_passes(out, found)
    else:
        out = _passed(out, ["row", "text"], held or [spark.sparkContext.broadcast(Packed(pickle.dumps(SuffixAutomaton([], limits.window))))])
    n_hit = F.aggregate(F.zip_with("hit_last", "hit_first", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    out = out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (limits.coverage_inverse * F.col("n_hit") >= F.col("n_words")))


def _hits_of(texts: DataFrame, automata: list, keep) -> DataFrame:
    """One pass: what its automata find, one row for each text with a hit."""
    rows = _passed(texts.select("text"), ["text"], automata).where("size(hit_first) > 0")
    out = keep(rows.select(F.sha2("text", 256).alias("key"), *SCANNED.names[1:]).dropDuplicates(["key"]), "pass")
    for held in automata:
        held.destroy()
    return out


def _columns(names: list[str], without: tuple[str, ...] | list[str] = ()) -> list[F.Column]:
    return [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names if c not in without]


def contamination(docs: DataFrame, benchmark: DataFrame, limits: ContaminationLimits = ContaminationLimits()) -> DataFrame:
    """The input columns, then n_words, n_hit, n_items, items and contaminated, which replace input columns of these names."""
    added = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    return scan(docs, benchmark, limits).select(*_columns(docs.columns, added), *added)


def items_digest() -> F.Column:
    return F.sha2(F.array_join(F.array_sort("items"), ","), 256)


def _cut(max_span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, (text, first, last) in enumerate(zip(texts, batch.column("hit_first").to_pylist(), batch.column("hit_last").to_pylist(), strict=True)):
                spans = [(a, b) for a, b in zip(first, last, strict=True) if b - a > max_span]
                if text and spans:
                    raw = text.encode()
                    one = bk.Texts(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
                    w = bk.words(one, bk.ALNUM)
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(raw[at : int(w.start[a])])
                        at = int(w.end[b - 1])
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, limits: ContaminationLimits = ContaminationLimits(), drop: bool = True) -> DataFrame:
    """The input columns without contaminated texts (``drop``), or with their spans longer than ``max_span`` removed.

    Texts under the coverage limit are returned unchanged.
    """
    found = scan(docs, benchmark, limits)
    if drop:
        return found.where(~F.col("contaminated")).select(*_columns(docs.columns))
    nothing = F.array().cast("array<bigint>")
    spans = [F.when(F.col("contaminated"), F.col(c)).otherwise(nothing).alias(c) for c in ("hit_first", "hit_last")]
    cut = found.select("row", "text", *spans).mapInArrow(bk.tidy(_cut(limits.max_span)), T.StructType(list(found.schema.fields)[:2]))
    return cut.select(*_columns(docs.columns))
