"""Quality rules by distribution divergence.

Each text is reduced in one vectorised pass to word, symbol, line and
window counts and to two histograms: over character classes, and over the
common words of its language.  A language's common words are those that make
up a thousandth of its words or more; they are found in the texts
themselves.  Blocks of text propose the words that are frequent in them (a
word with a share of the whole has that share in some block), a second pass
counts the proposed ones exactly.  The histogram's bins are rank classes, the
first word, the next two, the next four and so on, and all other words.

The reference of a language is the sum of both histograms over its texts
that pass the base rules.  A text is rejected if its Jensen-Shannon distance
to it, less what chance alone gives a text of its length, exceeds the limit
on either histogram.  Guards leave unjudged: short texts, texts that are a
large part of their language's words, and languages with a tiny share of the
corpus, which also bounds what is broadcast.

Null and empty texts have no words: they fail the base rules and are not
kept.  A null language is the language ``und``.  Repeated rows are judged
alike, each by itself; input columns of any name pass through unread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekit as bk
from .common import materialise, prepare, scratch

#: Names of the character classes, in histogram order.
CHAR_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "bracket", "symbol", "non_ascii", "control")
#: Bytes of text in which one proposal of common words is made.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class QualityLimits:
    """Thresholds of the rules; distances are square roots of divergences in bits, 0 to 1."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_char_distance: float = 0.31
    max_word_distance: float = 0.34
    min_chars_judged: int = 300
    min_words_judged: int = 40
    #: A common word is one in this many words of its language, or more frequent.
    common_one_in: int = 1_000
    #: A text is judged if its language has this many times its words.
    reference_times: int = 20
    #: Languages are judged if one in this many words of the corpus is theirs.
    language_one_in: int = 10_000

    def base_failed(self, n_words, n_repeat_words):
        return (n_words < self.min_words) | (100 * n_repeat_words > self.max_repeat_percent * n_words)


def _char_classes() -> np.ndarray:
    spans = {
        "lower": [(97, 122)], "upper": [(65, 90)], "digit": [(48, 57)], "space": [(32, 32), (9, 9), (11, 13)], "newline": [(10, 10)],
        "stop": [(44, 44), (46, 46), (58, 59), (33, 33), (63, 63)], "quote": [(34, 34), (39, 39), (45, 45)],
        "bracket": [(40, 41), (91, 91), (93, 93), (123, 123), (125, 125)], "symbol": [(33, 126)], "non_ascii": [(128, 255)], "control": [(0, 31), (127, 127)],
    }
    table = np.full(256, -1, np.int64)
    for i, name in enumerate(CHAR_CLASSES):
        for lo, hi in spans[name]:
            part = table[lo : hi + 1]
            part[part < 0] = i
    return table


_CLASS_OF = _char_classes()
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Words of the histogram: letters, digits and non-ASCII characters, A-Z in lower case.
_PLAIN = bk.ALNUM
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_plain")
FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in _COUNTS),
        T.StructField("char_hist", T.ArrayType(T.LongType(), False)),
        T.StructField("word_at", T.ArrayType(T.IntegerType(), False)),
        T.StructField("word_n", T.ArrayType(T.IntegerType(), False)),
    ]
)
VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def _totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags in each row's byte range."""
    running = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]


def _repeats(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal an earlier one of their row, and which have an equal in their row."""
    order = np.argsort(bk.key_in_row(hashes, row), kind="stable")
    h, r = hashes[order], row[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    later, shared = np.empty(len(h), bool), np.empty(len(h), bool)
    later[order], shared[order] = same, twice
    return later, shared


def _repeat_words(hashes: np.ndarray, first: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Words of each row inside windows that the row has twice or more."""
    value, at = bk.windows(hashes, first, window)
    _, shared = _repeats(value, row[at]) if len(at) else (None, np.empty(0, bool))
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[shared], 1)
    np.add.at(edge, at[shared] + window, -1)
    return _totals(np.cumsum(edge)[:-1] > 0, first)


class CommonWords:
    """Proposed common words by language, found by hash; ``names`` has each language's words in order."""

    def __init__(self, names: dict[str, list[str]]):
        self.names = names
        self.salt = {lang: np.uint64(k + 1) for k, lang in enumerate(sorted(names))}
        keys, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for lang, words in names.items():
            raw = [w.encode() for w in words]
            size = np.array([len(w) for w in raw], np.int64)
            end = np.cumsum(size)
            hashes = bk.span_hashes(np.frombuffer(b"".join(raw), np.uint8), end - size, end, bk.LOWERED)
            keys.append(bk.mix64(hashes ^ bk.mix64(self.salt[lang] + np.zeros(1, np.uint64))))
            places.append(np.arange(len(words)))
        order = np.argsort(np.concatenate(keys))
        self.keys, self.places = np.concatenate(keys)[order], np.concatenate(places)[order]

    def places_of(self, hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """Place of each word in its language's list; -1 if it has none."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        key = bk.mix64(hashes ^ bk.mix64(salts))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (salts > 0), self.places[at], -1)


def measure(texts: bk.Texts, langs: list[str], window: int, common: CommonWords) -> dict[str, np.ndarray]:
    """The counts and histograms of a slice of texts; common words as (row, place, count) cells."""
    data, offsets, rows = texts.data, texts.offsets, texts.rows
    w = bk.words(texts, bk.SPACED)
    hashes = bk.span_hashes(data, w.start, w.end, bk.CASED)
    lead = (data & 0xC0) != 0x80
    out = {
        "n_words": w.counts,
        "word_chars": _totals(lead & bk.SPACED[data], offsets),
        "n_symbols": _totals(_SYMBOL[data], offsets),
        "n_chars": _totals(lead, offsets),
        "n_repeat_words": _repeat_words(hashes, w.first, w.row, window),
    }

    lines = bk.words(texts, bk.class_table((10, 10), inverted=True))
    line_hash = bk.span_hashes(data, lines.start, lines.end, bk.CASED)
    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(bk.SPACED[data], out=worded[1:])
    has_word = worded[lines.end] > worded[lines.start]
    later, _ = _repeats(line_hash[has_word], lines.row[has_word])
    out["n_dup_lines"] = np.bincount(lines.row[has_word][later], minlength=rows).astype(np.int64)

    of = _CLASS_OF[data[lead]]
    row_of = np.repeat(np.arange(rows), out["n_chars"])
    width = len(CHAR_CLASSES)
    out["char_hist"] = np.bincount(row_of * width + of, minlength=rows * width).reshape(rows, width)

    plain = bk.words(texts, _PLAIN)
    out["n_plain"] = plain.counts
    salts = np.array([common.salt.get(lang, 0) for lang in langs], np.uint64)
    place = common.places_of(bk.span_hashes(data, plain.start, plain.end, bk.LOWERED), salts[plain.row])
    hit = np.flatnonzero(place >= 0)
    cell, n = np.unique(plain.row[hit] << 32 | place[hit], return_counts=True)
    out["cell_row"], out["cell_at"], out["cell_n"] = cell >> 32, cell & 0xFFFFFFFF, n
    return out


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
    )


def _proposals(limits: QualityLimits):
    """Per block and language: the words that may be common, and (as a null word) the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size = 0

        def flush() -> pa.RecordBatch:
            out: list[tuple[str, str | None, int]] = []
            for lang, parts in held.items():
                value, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(value)).astype(np.int64)
                total = int(n.sum())
                out.append((lang, None, total))
                # Half the share that makes a word common: what blocks hold back then never hides one.
                often = set(np.flatnonzero(2 * limits.common_one_in * n >= total).tolist())
                at = 0
                for value_part, _, data, start, end in parts:
                    for j in range(len(value_part)):
                        k = int(back[at + j])
                        if k in often:
                            often.discard(k)
                            out.append((lang, bytes(data[start[j] : end[j]]).lower().decode(), int(n[k])))
                    at += len(value_part)
            held.clear()
            lang, word, n = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for texts in bk.slices(batch.column("text")):
                w = bk.words(texts, bk.SPACED)
                repeats = _repeat_words(bk.span_hashes(texts.data, w.start, w.end, bk.CASED), w.first, w.row, limits.window)
                passed = ~limits.base_failed(w.counts, repeats)
                code = batch.column("lang").slice(texts.lo, texts.rows).dictionary_encode()
                plain = bk.words(texts, _PLAIN)
                hashes = bk.span_hashes(texts.data, plain.start, plain.end, bk.LOWERED)
                of = np.where(passed, code.indices.to_numpy(), -1)[plain.row]
                for k, lang in enumerate(code.dictionary.to_pylist()):
                    own = np.flatnonzero(of == k)
                    value, first, n = np.unique(hashes[own], return_index=True, return_counts=True)
                    if len(value):
                        held[lang].append((value, n, texts.data, plain.start[own[first]], plain.end[own[first]]))
                size += len(texts.data)
                if size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return run


def common_words(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> CommonWords:
    """Every language's words that may be common: at most twice ``common_one_in`` for each of at most ``language_one_in`` languages."""
    rows = _texts(docs).select("text", "lang").mapInArrow(bk.tidy(_proposals(limits)), "lang string, word string, n long")
    found = materialise(rows.groupBy("lang", "word").agg(F.sum("n").alias("n")), "proposals")
    totals = found.where("word is null").select("lang", F.col("n").alias("total"))
    everything = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    large = totals.where(F.col("total") * limits.language_one_in >= everything)
    kept = found.where("word is not null").join(large, "lang")
    table = kept.where(F.col("n") * (2 * limits.common_one_in) >= F.col("total")).select("lang", "word").orderBy("lang", "word").toArrow()
    names: dict[str, list[str]] = {row.lang: [] for row in large.select("lang").collect()}
    for lang, word in zip(table.column("lang").to_pylist(), table.column("word").to_pylist(), strict=True):
        names[lang].append(word)
    return CommonWords(names)


def _features(window: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.value
        for batch in batches:
            for texts in bk.slices(batch.column("text")):
                part = batch.slice(texts.lo, texts.rows)
                m = measure(texts, part.column("lang").to_pylist(), window, words)
                ends = np.concatenate([[0], np.cumsum(np.bincount(m["cell_row"], minlength=texts.rows))]).astype(np.int32)
                bins = np.arange(texts.rows + 1, dtype=np.int32) * len(CHAR_CLASSES)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("lang"),
                        *(pa.array(m[c].astype(np.int64)) for c in _COUNTS),
                        pa.ListArray.from_arrays(bins, pa.array(m["char_hist"].astype(np.int64).ravel())),
                        pa.ListArray.from_arrays(ends, pa.array(m["cell_at"].astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array(m["cell_n"].astype(np.int32))),
                    ],
                    names=FEATURES.names,
                )

    return run


@dataclass(frozen=True)
class Reference:
    """One language: shares of the character classes and of the rank classes, the rank class of each listed word, all words."""

    chars: np.ndarray
    words: np.ndarray
    class_of: np.ndarray
    total: int


def references(measured: DataFrame, common: CommonWords, limits: QualityLimits = QualityLimits()) -> dict[str, Reference]:
    """The references of the languages with listed words (a few thousand numbers each)."""
    passed = measured.where(~limits.base_failed(F.col("n_words"), F.col("n_repeat_words"))).where(F.col("lang").isin(list(common.names)))
    sums = passed.groupBy("lang").agg(F.sum("n_plain").alias("total"), *(F.sum(F.col("char_hist")[i]).alias(f"c{i}") for i in range(len(CHAR_CLASSES)))).collect()
    cells = passed.select("lang", F.explode(F.arrays_zip("word_at", "word_n")).alias("w")).groupBy("lang", F.col("w.word_at").alias("at")).agg(F.sum("w.word_n").cast("long").alias("n"))
    counts = {lang: np.zeros(len(words), np.int64) for lang, words in common.names.items()}
    table = cells.toArrow()
    for lang, at, n in zip(*(table.column(c).to_pylist() for c in ("lang", "at", "n")), strict=True):
        counts[lang][at] = n
    out = {}
    for row in sums:
        n = counts[row.lang]
        chars = np.array([row[f"c{i}"] for i in range(len(CHAR_CLASSES))], float)
        # By count, then by the word itself: lists are in the order of words.
        ranked = np.argsort(-n, kind="stable")[: int((n * limits.common_one_in >= row.total).sum())]
        class_of = np.full(len(n), -1, np.int64)
        class_of[ranked] = np.log2(np.arange(1, len(ranked) + 1)).astype(np.int64)
        bins = np.bincount(class_of[ranked], n[ranked]) if len(ranked) else np.empty(0)
        words = np.append(bins, row.total - n[ranked].sum())
        out[row.lang] = Reference(chars / max(1.0, chars.sum()), words / max(1, row.total), class_of, int(row.total))
    return out


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``p`` to ``q``."""
    mean = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / mean), 0) + np.where(q > 0, q * np.log2(q / mean), 0)
    return np.maximum(0, terms.sum(axis=1) / 2)


def by_chance(bins: int, n: np.ndarray) -> np.ndarray:
    """Expected divergence of ``n`` draws over some bins from what they are drawn from."""
    return (bins - 1) / (8 * np.log(2) * np.maximum(n, 1))


def distances(m: dict[str, np.ndarray], langs: list[str], known: dict[str, Reference], limits: QualityLimits) -> tuple[np.ndarray, np.ndarray]:
    """Both distances of every text to its language's reference; nan where a guard leaves it unjudged."""
    rows = len(langs)
    char_distance, word_distance = np.full(rows, np.nan), np.full(rows, np.nan)
    code = np.array(langs, dtype=object)
    for lang in set(langs) & known.keys():
        ref = known[lang]
        own = np.flatnonzero((code == lang) & (limits.reference_times * m["n_plain"] <= ref.total))
        place = np.full(rows, -1)
        place[own] = np.arange(len(own))
        total = m["n_chars"][own]
        shares = m["char_hist"][own] / np.maximum(1, total)[:, None]
        judged = total >= limits.min_chars_judged
        char_distance[own[judged]] = np.sqrt(_divergence(shares[judged], ref.chars))
        bins, n = len(ref.words), m["n_plain"][own]
        listed = (place[m["cell_row"]] >= 0) & (ref.class_of[np.where(code[m["cell_row"]] == lang, m["cell_at"], 0)] >= 0) if len(ref.class_of) else np.zeros(len(m["cell_row"]), bool)
        row, at, count = place[m["cell_row"][listed]], m["cell_at"][listed], m["cell_n"][listed]
        hist = np.bincount(row * bins + ref.class_of[at], count, minlength=len(own) * bins).reshape(len(own), bins)
        hist[:, -1] = n - hist[:, :-1].sum(axis=1)
        judged = n >= limits.min_words_judged
        excess = _divergence(hist[judged] / n[judged][:, None], ref.words) - by_chance(bins, n[judged])
        word_distance[own[judged]] = np.sqrt(np.maximum(0, excess))
    return char_distance, word_distance


def _verdicts(m: dict[str, np.ndarray], langs: list[str], known: dict[str, Reference], limits: QualityLimits) -> tuple[np.ndarray, ...]:
    failed = limits.base_failed(m["n_words"], m["n_repeat_words"])
    char_distance, word_distance = distances(m, langs, known, limits)
    far = (np.nan_to_num(char_distance) > limits.max_char_distance) | (np.nan_to_num(word_distance) > limits.max_word_distance)
    return failed, char_distance, word_distance, ~failed & ~far


def _judge(known, limits: QualityLimits):
    """Verdicts of measured texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = known.value
        for batch in batches:
            rows = batch.num_rows
            m = {c: batch.column(c).to_numpy() for c in _COUNTS}
            m["char_hist"] = batch.column("char_hist").flatten().to_numpy().reshape(rows, len(CHAR_CLASSES))
            sizes = pc.list_value_length(batch.column("word_at")).to_numpy()
            m["cell_row"] = np.repeat(np.arange(rows), sizes)
            m["cell_at"], m["cell_n"] = batch.column("word_at").flatten().to_numpy(), batch.column("word_n").flatten().to_numpy()
            failed, chars, words, kept = _verdicts(m, batch.column("lang").to_pylist(), refs, limits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in _COUNTS[:5]), pa.array(failed), pa.array(chars, mask=np.isnan(chars)), pa.array(words, mask=np.isnan(words)), pa.array(kept)],
                names=["doc_id", *_COUNTS[:5], "base_failed", "char_distance", "word_distance", "kept"],
            )

    return run


def _keep(common, known, limits: QualityLimits):
    """The rows of a batch whose texts are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, refs = common.value, known.value
        for batch in batches:
            langs = batch.column("lang").cast(pa.string()).fill_null("und").to_pylist()
            for texts in bk.slices(batch.column("text")):
                own = langs[texts.lo : texts.hi]
                kept = _verdicts(measure(texts, own, limits.window, words), own, refs, limits)[-1]
                yield batch.slice(texts.lo, texts.rows).filter(pa.array(kept))

    return run


def _prepared(docs: DataFrame, limits: QualityLimits):
    """The measured texts as a table, their languages' listed words and references, both broadcast."""
    context = docs.sparkSession.sparkContext
    common = common_words(docs, limits)
    held = context.broadcast(common)
    measured = materialise(_texts(docs).mapInArrow(bk.tidy(_features(limits.window, held)), FEATURES), "quality")
    return measured, held, context.broadcast(references(measured, common, limits))


def quality(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Counts, distances and verdict of every text: one row per input row."""
    with scratch(docs.sparkSession) as keep:
        measured, _, known = _prepared(docs, limits)
        return keep(measured.mapInArrow(bk.tidy(_judge(known, limits)), VERDICT), "verdicts")


def keep_good(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """The input rows without rejected texts: a verdict is that of a row's own text and language, whatever its doc_id.

    The references are known by then, so a scan judges the rows where they are and no text moves.
    """
    with scratch(docs.sparkSession):
        _, common, known = _prepared(docs, limits)
        prepare(docs.sparkSession)
        return docs.mapInArrow(bk.tidy(_keep(common, known, limits)), docs.schema)
