"""N-gram Jaccard join: components of documents whose shingle sets are alike.

A text's set has the hashes of its distinct five-word shingles.  Documents
with equal sets are one node.  For the rest:

1. Candidates meet by prefix keys.  Whatever total order the shingles have,
   two sets of similarity 0.8 share one of the first ``n - ceil(0.8 n) + 1``
   of either.  The order puts shingles known to be frequent last, so keys
   are rare ones; which are known affects the cost only, not the result.
2. All documents of a key go to the block of its smallest document (its
   hub), so no pairs are emitted and the rows stay linear in the keys.
   Keys of frequent shingles find their hub by a pre-aggregated minimum
   instead of a shuffle on the key.
3. In a block, a count-vector R-tree bounds overlaps by summed coordinate
   minima.  Only documents with a surviving pair go on; connected, they form
   disjoint blocks, so every pair has one place.  There the surviving pairs
   of a second R-tree are verified on the whole sets and counted.
4. Blocks over a size limit first measure their documents against the block's
   smallest one, in parts of bounded size.  Documents that the bound leaves
   beside it need no comparison with each other to be one block; and in a
   verified block, documents within half the allowed distance of it are all
   linked with each other (the Jaccard distance is a metric), so their links
   are a count.  Only the rest meets everything, part by part.
5. Components of the verified links come from pointers to ever smaller
   documents on tables in the shared folder, until nothing changes.

A document's links are its copies (documents with an equal set) and the
documents of every linked set; no pairs are put out.

Documents without words, or with a null text, have an empty set, link with
nothing and are their own component; a null doc_id has a null component.
Repeated rows are copies of each other; clashing columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit as bk
from .common import BROADCAST_IDS, materialise, maybe_in, prepare, scratch, text_or_empty, without_ids
from .rtree import candidate_pairs, components, count_vector, linked_pairs, read_vector

WIDTH = 5
#: Frequent shingles kept for the order, at most (a driver and broadcast bound).
FREQUENT_LIMIT = 100_000
#: Occurrences in one task from which a shingle counts as frequent.
FREQUENT_IN_TASK = 12
#: Estimated bytes of a part of a block; two parts meet in a task.
PART_BYTES = 4 << 20
#: Documents of a part at most.
PART_DOCS = 1024
#: Parts that a block's documents form for each such part while they meet the lead alone.
LEAD_PARTS = 4
#: Copies of a set from which its documents are joined apart from the others.
HOT_COPIES = 1000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shingle_sets(texts: bk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice, by row then value, and the number of each row."""
    w = bk.words(texts, bk.SPACED)
    hashes = bk.span_hashes(texts.data, w.start, w.end, bk.LOWERED)
    value, at = bk.windows(hashes, w.first, WIDTH)
    row = w.row[at]
    counts = w.counts
    for n in range(1, WIDTH):  # texts of fewer words: the whole sequence
        rows = np.flatnonzero(counts == n)
        if len(rows):
            first = w.first[:-1][rows]
            whole = np.zeros(len(rows), np.uint64)
            for j in range(n):
                whole += hashes[first + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
            value = np.concatenate([value, bk.mix64(whole + np.uint64(n))])
            row = np.concatenate([row, rows])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.bincount(row, minlength=texts.rows)


def _frequent_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that occur often among the texts of one task, with their counts (space-saving: rare ones are forgotten)."""
    held_v, held_n = np.empty(0, np.uint64), np.empty(0, np.int64)
    pending: list[np.ndarray] = []
    waiting = 0

    def fold() -> None:
        nonlocal held_v, held_n, pending, waiting
        if not pending:
            return
        v, n = np.unique(np.concatenate(pending), return_counts=True)
        often = n > 1
        v, n = np.concatenate([held_v, v[often]]), np.concatenate([held_n, n[often]])
        held_v, back = np.unique(v, return_inverse=True)
        held_n = np.bincount(back, weights=n, minlength=len(held_v)).astype(np.int64)
        if len(held_v) > 400_000:
            top = np.argsort(-held_n)[:200_000]
            held_v, held_n = held_v[top], held_n[top]
        pending, waiting = [], 0

    for batch in batches:
        for texts in bk.slices(batch.column("text")):
            value, _ = shingle_sets(texts)
            pending.append(value)
            waiting += len(value)
            if waiting > 2_000_000:
                fold()
    fold()
    often = held_n >= FREQUENT_IN_TASK
    yield pa.RecordBatch.from_arrays([pa.array(_signed(held_v[often])), pa.array(held_n[often])], names=["shingle", "n"])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """At most ``FREQUENT_LIMIT`` frequent shingles, least frequent first: the end of the order."""
    found = docs.select("text").mapInArrow(bk.tidy(_frequent_local), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "shingle").limit(FREQUENT_LIMIT).toArrow()
    return np.array(top.column("shingle").to_numpy()[::-1]).view(np.uint64)


def _prefixes(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        by_value = np.argsort(known)
        ordered = known[by_value]
        for batch in batches:
            for texts in bk.slices(batch.column("text")):
                value, n = shingle_sets(texts)
                row = np.repeat(np.arange(texts.rows), n)
                start = np.concatenate([[0], np.cumsum(n)])
                running = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                a, b = running(bk.mix64(value)), running(bk.mix64(value ^ np.uint64(0x5851F42D4C957F2D)))
                fp1, fp2 = a[start[1:]] - a[start[:-1]], b[start[1:]] - b[start[:-1]]
                place = np.zeros(len(value), np.int64)
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, value), len(ordered) - 1)
                    hit = ordered[at] == value
                    place[hit] = by_value[at[hit]] + 1
                order = np.lexsort((value, place, row))
                keys = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                rank = np.arange(len(value)) - np.repeat(start[:-1], n)
                chosen = order[rank < np.repeat(keys, n)]
                rare = place[chosen] == 0
                part = batch.slice(texts.lo, texts.rows)
                lists = []
                for keep in (rare, ~rare):
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row[chosen[keep]], minlength=texts.rows))])
                    lists.append(pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(_signed(value[chosen[keep]]))))
                vectors = pa.array([count_vector(value[start[i] : start[i + 1]]).tobytes() for i in range(texts.rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(_signed(fp1)), pa.array(_signed(fp2)), *lists, vectors], names=["doc_id", "n_shingles", "fp1", "fp2", "rare", "often", "vector"])

    return run


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and document: each document of a key with the key's first document, if it is another."""
    open_key = open_hub = None
    for batch in batches:
        key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        carried = open_key is not None and key[0] == open_key
        fresh[0] = not carried
        first = np.flatnonzero(fresh)
        hub = np.empty(len(key), np.int64)
        if carried:
            hub[: first[0] if len(first) else len(key)] = open_hub
        group = np.cumsum(fresh) - 1
        own = group >= 0
        hub[own] = doc[first[group[own]]]
        follow = ~fresh & (doc != hub)
        out_hub, out_doc = hub[follow], doc[follow]
        leads = np.unique(out_hub)
        open_key, open_hub = key[-1], hub[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([out_hub, leads])), pa.array(np.concatenate([out_doc, leads]))], names=["hub", "doc"])


def memberships(prefixes: DataFrame) -> DataFrame:
    """Distinct (hub, doc): the documents that share a prefix key with the key's smallest document."""
    rare = prefixes.select(F.explode("rare").alias("key"), F.col("doc_id").alias("doc"))
    n = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rare.repartition(n, "key").sortWithinPartitions("key", "doc").mapInArrow(bk.tidy(_hubs), "hub long, doc long")
    often = prefixes.where(F.size("often") > 0).select(F.explode("often").alias("key"), F.col("doc_id").alias("doc"))
    # At most FREQUENT_LIMIT rows of 24 bytes.
    hub_of = often.groupBy("key").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    hot = often.join(F.broadcast(hub_of), "key").select("hub", "doc")
    return met.unionByName(hot).distinct()


def _big(sized: DataFrame, limit: int) -> DataFrame:
    """hub and parts of the blocks over a limit of weight: at most one for each ``limit`` of it; a part meets only the lead, so parts are small."""
    blocks = sized.groupBy("hub").agg(F.sum("weight").alias("weight")).where(F.col("weight") > limit)
    return materialise(blocks.select("hub", F.ceil(LEAD_PARTS * F.col("weight") / limit).cast("int").alias("parts")), "big")


def _part(parts: str) -> F.Column:
    return F.pmod(F.xxhash64("doc"), F.col(parts)).cast("int")


def _whole_tasks(rows: DataFrame) -> DataFrame:
    """A block is one task."""
    return rows.withColumns({"kind": F.lit(0), "low": F.lit(0), "high": F.lit(0), "side": F.lit(0)})


def _lead_tasks(rows: DataFrame) -> DataFrame:
    """A block's parts, each with the block's smallest document, its hub."""
    own = F.when(F.col("doc") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_part("parts")))
    return rows.withColumn("low", F.explode(own)).withColumns({"kind": F.lit(1), "high": F.col("low"), "side": F.lit(0)}).drop("parts")


def _rest_tasks(rows: DataFrame, limit: int) -> DataFrame:
    """The pairs of parts in which a block's ``rest`` meets itself (kind 2) and the others (kind 3).

    rows: hub, doc, weight, rest.  A block without a rest has no tasks.
    """
    part = lambda flag: F.ceil(F.sum(F.when(F.col("rest") == flag, F.col("weight")).otherwise(0)) / limit).cast("int")
    counts = rows.groupBy("hub").agg(part(True).alias("rest_parts"), part(False).alias("other_parts")).where("rest_parts > 0")
    placed = rows.join(materialise(counts, "counts"), "hub")
    rest, other = placed.where("rest"), placed.where("not rest")
    mine = rest.withColumn("own", _part("rest_parts"))
    among = mine.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)))
    among = among.withColumns({"kind": F.lit(2), "low": F.least("own", "j"), "high": F.greatest("own", "j"), "side": F.col("own")})
    across = mine.where("other_parts > 0").withColumn("high", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    across = across.withColumns({"kind": F.lit(3), "low": F.col("own"), "side": F.lit(0)})
    against = other.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)))
    against = against.withColumns({"kind": F.lit(3), "high": _part("other_parts"), "side": F.lit(1)})
    columns = [*(c for c in rows.columns if c != "rest"), "kind", "low", "high", "side"]
    return among.select(columns).unionByName(across.select(columns)).unionByName(against.select(columns))


def _close_components(docs: list[int], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the documents in pairs, and the smallest id of the component of each."""
    order = np.argsort(docs, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids = np.array(docs, np.int64)[order]
    label = components(len(ids), place[a], place[b])
    touched = np.unique(np.concatenate([place[a], place[b]]))
    return ids[touched], ids[label[touched]]


def _by_block(pairs_of, columns: list[str]):
    """Blocks of sorted rows, each closed by ``pairs_of(rows)``, which gives pairs of row indices.

    Every document in a pair comes out with the smallest one of its component in the block, and with
    the documents that its partners stand for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, rows = None, []

        def close() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            none = np.empty(0, np.int64)
            # A row that stands twice in the input is one document here.
            rows[:] = {(r["doc"], r[columns[-1]]): r for r in rows}.values()
            if len(rows) < 2:
                return none, none, none
            a, b = pairs_of(rows)
            if not len(a):
                return none, none, none
            copies = np.array([r["copies"] for r in rows], np.int64)
            count = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
            docs = [r["doc"] for r in rows]
            ids, root = _close_components(docs, a, b)
            total = dict.fromkeys(ids.tolist(), 0)
            for doc, n in zip(docs, count.tolist(), strict=True):
                if doc in total:
                    total[doc] += int(n)
            return ids, root, np.array([total[i] for i in ids.tolist()], np.int64)

        def put(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *(x[k] for x in out)])) for k in (0, 1, 2)], names=["doc", "root", "n"])

        for batch in batches:
            out = []
            for row in batch.select([*TASK, *columns]).to_pylist():
                block = tuple(row[c] for c in TASK)
                if block != open_block:
                    out.append(close())
                    open_block, rows = block, []
                rows.append(row)
            yield put(out)
        yield put([close()])

    return run


def _beside_lead(beside):
    """Of blocks of sorted rows, each with its lead (the hub) among them: every document, and whether ``beside(lead, row)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, lead, waiting = None, None, []
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for row in batch.to_pylist():
                if (row["hub"], row["low"]) != open_block:
                    open_block, lead, waiting = (row["hub"], row["low"]), None, []
                if lead is None and row["doc"] == row["hub"]:
                    lead = row
                    if row["low"] == 0:
                        out.append((row["hub"], row["doc"], True))
                elif row["doc"] != row["hub"]:
                    # Rows are sorted by document, and the hub is the smallest.
                    out.append((row["hub"], row["doc"], bool(beside(lead, row))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.bool_())], names=["hub", "doc", "beside"])

    return run


TASK = ["hub", "kind", "low", "high"]


def _bounded(lead: dict, row: dict) -> bool:
    """Whether the count vectors allow a link."""
    a, _ = candidate_pairs(np.array([lead["n_shingles"], row["n_shingles"]], np.int64), [read_vector(r["vector"], r["n_shingles"]) for r in (lead, row)])
    return len(a) > 0


def _tight(lead: dict, row: dict) -> bool:
    """Whether two sets are within half the allowed distance."""
    a, b = (np.frombuffer(r["elements"], np.uint64) for r in (lead, row))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * common >= 9 * (len(a) + len(b) - common)


def _sides(rows: list[dict]) -> np.ndarray | None:
    """The sides of a task across parts; none if all pairs of the task count."""
    return np.array([r["side"] for r in rows]) if rows[0]["kind"] == 3 or rows[0]["low"] != rows[0]["high"] else None


def _surviving(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    a, b = candidate_pairs(np.array([r["n_shingles"] for r in rows], np.int64), [read_vector(r["vector"], r["n_shingles"]) for r in rows])
    side = _sides(rows)
    if side is not None:
        across = side[a] != side[b]
        a, b = a[across], b[across]
    return a, b


def _verified(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return linked_pairs([np.frombuffer(r["elements"], np.uint64) for r in rows], _sides(rows))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's whole set as bytes."""
    for batch in batches:
        for texts in bk.slices(batch.column("text")):
            value, n = shingle_sets(texts)
            start = np.concatenate([[0], np.cumsum(n)])
            raw = [value[start[i] : start[i + 1]].tobytes() for i in range(texts.rows)]
            part = batch.slice(texts.lo, texts.rows)
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("hub"), part.column("copies"), pa.array(n.astype(np.int64)), pa.array(raw, pa.binary())], names=["doc", "hub", "copies", "n_shingles", "elements"])


def _dealt(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *TASK).sortWithinPartitions(*TASK, "doc")


_FOUND = "doc long, root long, n long"


def _blocks(rows: DataFrame, big: DataFrame, limit: int, beside, pairs_of, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """What the blocks find (doc, root, n), and the documents beside the leads of big blocks (hub, doc, copies, beside).

    rows: hub, doc, weight, copies and the columns that the comparisons read.
    """
    wide = [c for c in rows.columns if c not in ("hub", "doc", "weight", "copies")]
    found = _dealt(_whole_tasks(rows.join(big, "hub", "left_anti").drop("weight"))).mapInArrow(bk.tidy(_by_block(pairs_of, [*columns, "doc", "copies", columns[0]])), _FOUND)
    if big.isEmpty():
        return found, rows.sparkSession.createDataFrame([], "hub long, doc long, copies long, beside boolean")
    members = rows.join(big, "hub")
    leads = _dealt(_lead_tasks(members.drop("weight", "copies"))).mapInArrow(bk.tidy(_beside_lead(beside)), "hub long, doc long, beside boolean").distinct()
    placed = members.select("hub", "doc", "weight", "copies").join(leads, ["hub", "doc"])
    placed = materialise(placed, "placed")
    tasks = _rest_tasks(placed.withColumn("rest", ~F.col("beside")).drop("beside"), limit).drop("weight", "copies")
    facts = members.select("hub", "doc", "copies", *wide)
    met = _dealt(tasks.join(facts, ["hub", "doc"])).mapInArrow(bk.tidy(_by_block(pairs_of, [*columns, "doc", "copies", columns[0]])), _FOUND)
    return found.unionByName(met), placed


def survivors(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hub, doc): disjoint blocks of the documents that the count-vector bound leaves; nodes: doc, n_shingles, vector, copies."""
    sized = members.withColumn("weight", F.lit(1))
    big = _big(sized, PART_DOCS)
    found, placed = _blocks(sized.join(nodes, "doc"), big, PART_DOCS, _bounded, _surviving, ["vector", "n_shingles", "side"])
    links = found.where("doc != root").select(F.col("doc").alias("a"), F.col("root").alias("b"))
    links = links.unionByName(placed.where("beside and doc != hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")))
    return connect(links).select(F.col("component").alias("hub"), "doc")


def verified_links(docs: DataFrame, alive: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, root, n): from whole sets, the smallest linked document of each in a task, and the documents linked with it there."""
    facts = materialise(alive.join(nodes.select("doc", "n_shingles", "copies"), "doc"), "facts")
    weight = F.col("n_shingles") * 8 + PART_BYTES // PART_DOCS
    big = _big(facts.withColumn("weight", weight), PART_BYTES)
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc", "hub", "copies", "n_shingles")), T.StructField("elements", T.BinaryType())])
    near, chosen = docs.select(F.col("doc_id").alias("doc"), "text"), facts.select("doc", "hub", "copies")
    # Most texts have no partner: they are left out where they are read, and never shuffled.
    if facts.count() > BROADCAST_IDS:
        near = near.where(maybe_in(facts, "doc", F.col("doc")))
    else:
        chosen = F.broadcast(chosen)
    sets = near.join(chosen, "doc").select("doc", "text", "hub", "copies").mapInArrow(bk.tidy(_sets), schema)
    if not big.isEmpty():
        sets = materialise(sets, "sets")
    found, placed = _blocks(sets.withColumn("weight", weight).drop("n_shingles"), big, PART_BYTES, _tight, _verified, ["elements", "side"])
    # Documents that are all within half the distance of one are all linked.
    close = placed.where("beside").distinct()
    # One row for each big block: a small table, which the planner need not deal by hub.
    total = materialise(close.groupBy("hub").agg(F.sum("copies").alias("total")), "totals")
    close = close.join(total, "hub").select("doc", F.col("hub").alias("root"), (F.col("total") - F.col("copies")).alias("n"))
    return found.unionByName(close.where("n > 0"))


def connect(links: DataFrame) -> DataFrame:
    """(doc, component) of every linked document; links: a, b.

    Every document points to smaller ones.  It keeps the smallest, and the others it pointed to point
    there too; then pointers skip documents that have one themselves.  That goes on until every
    document has one pointer, to a document without any.  Documents meet by themselves, never by what
    they point to, which may be the same for very many.
    """
    rows = materialise(links.where("a != b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "links")
    while True:
        low = rows.groupBy("x").agg(F.min("y").alias("low"), F.count(F.lit(1)).alias("n"))
        several = rows.join(low.where("n > 1").select("x", "low"), "x").where("y != low").select(F.col("y").alias("x"), F.col("low").alias("y"))
        merged = materialise(low.select("x", F.col("low").alias("y")).unionByName(several).distinct(), "links")
        ends = merged.select(F.col("y").alias("x")).distinct()
        up = materialise(merged.groupBy("x").agg(F.min("y").alias("up")).join(ends, "x", "left_semi").select(F.col("x").alias("y"), "up"), "up")
        if up.isEmpty():
            return merged.select(F.col("x").alias("doc"), F.col("y").alias("component")).unionByName(ends.select(F.col("x").alias("doc"), F.col("x").alias("component")))
        rows = materialise(merged.join(up, "y", "left").select("x", F.coalesce("up", "y").alias("y")).distinct(), "links")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every input row."""
    spark = docs.sparkSession
    prepare(spark)
    with scratch(spark) as keep:
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        frequent = spark.sparkContext.broadcast(frequent_shingles(narrow))
        schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "n_shingles", "fp1", "fp2")), *(T.StructField(c, T.ArrayType(T.LongType(), False)) for c in ("rare", "often")), T.StructField("vector", T.BinaryType())])
        prefixes = materialise(narrow.mapInArrow(bk.tidy(_prefixes(frequent)), schema), "prefixes")
        same_set = ["fp1", "fp2", "n_shingles"]
        known = prefixes.where("n_shingles > 0 and doc_id is not null")
        nodes = materialise(known.groupBy(*same_set).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
        # A set's smallest document stands for its copies.
        first = prefixes.join(nodes.withColumnRenamed("node", "doc_id"), [*same_set, "doc_id"]).dropDuplicates([*same_set, "doc_id"])
        first = materialise(first, "first")
        members = materialise(memberships(first), "members")
        vectors = first.select(F.col("doc_id").alias("doc"), "n_shingles", "vector", "copies")
        alive = materialise(survivors(members, vectors), "alive")
        links = materialise(verified_links(narrow, alive, vectors), "verified")
        component = connect(links.select(F.col("doc").alias("a"), F.col("root").alias("b"))).withColumnRenamed("doc", "node")
        degree = links.groupBy(F.col("doc").alias("node")).agg(F.sum("n").alias("n"))
        # What a set's documents have in common is found once for each set.
        facts = nodes.join(component, "node", "left").join(degree, "node", "left")
        facts = materialise(facts.select(*same_set, "copies", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n")), "facts")
        rows = prefixes.select("doc_id", *same_set)
        # Sets with very many copies are few: a small table, which the planner need not deal by set.
        hot = materialise(facts.where(F.col("copies") > HOT_COPIES), "hot")
        out = rows.join(hot, same_set).unionByName(rows.join(hot, same_set, "left_anti").join(facts.where(F.col("copies") <= HOT_COPIES), same_set, "left"), allowMissingColumns=True)
        has_id = F.col("doc_id").isNotNull()
        return keep(out.select("doc_id", "n_shingles", F.when(has_id, F.coalesce("component", "doc_id")).alias("component_id"), F.when(has_id, F.coalesce("n", F.lit(0))).alias("n_links")), "components")


def keep_one(docs: DataFrame) -> DataFrame:
    """The input rows without those whose component has a smaller doc_id, and without repeats of a doc_id and text.

    Rows without a doc_id stay.  Texts stay where they are read, but for rows that share their doc_id with another row.
    """
    with scratch(docs.sparkSession) as keep:
        gone = keep(jaccard_components(docs).where("doc_id != component_id").select("doc_id").distinct(), "gone")
        twice = keep(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "twice")
    kept = without_ids(docs, gone, "doc_id")
    if twice.isEmpty():
        return kept
    rows = kept.join(twice.withColumnRenamed("doc_id", "__id"), F.col("doc_id").cast("long") == F.col("__id"), "left_semi").select(F.struct(*docs.columns).alias("row"))
    rows = rows.withColumns({"id": F.col("row.doc_id"), "key": F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256)}).dropDuplicates(["id", "key"])
    return without_ids(kept, twice, "doc_id").unionByName(rows.select("row.*"))
