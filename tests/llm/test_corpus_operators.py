"""Training order, decontamination, Jaccard join, WARC, HTML and the pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, html_text, jaccard, rtree, training_order, warc

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def _tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        order = training_order.Feistel(n, 7)
        slots = order.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert (order.indices(slots) == np.arange(n)).all()


def test_training_order_round_trip(spark, docs, tmp_path):
    rng = random.Random(1)
    texts = [None, "", "x", "é" * 200, *(_prose(rng, rng.randint(1, 200)) for _ in range(60))]
    layout = training_order.Layout(tokens=100, shard_rows=16)
    frame = docs(texts).unionByName(docs(["twin", "twin"]).select("*").withColumn("doc_id", F.lit(7).cast("long")))
    path = str(tmp_path / "shards")
    total = training_order.write_shards(frame, path, layout)
    rows = sorted(training_order.read_shards(spark, path, layout).collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == sorted(r.slot for r in rows) == list(range(total))
    # In the order of the numbers the sequences are the streams of whole texts.
    stream = b"".join(bytes(r.tokens) for r in rows)
    assert stream.endswith(b"\xff") and sorted(stream[:-1].split(b"\xff")) == sorted((r.text or "").encode() for r in frame.collect())
    known = {r.doc_id: (r.text or "").encode() + b"\xff" for r in frame.collect() if r.doc_id != 7}
    for r in rows:
        if r.doc_id in known:
            head = known[r.doc_id][r.place : r.place + r.n_tokens]
            assert bytes(r.tokens).startswith(head)
    part = training_order.read_shards(spark, path, layout, 20, 37).collect()
    assert sorted(r.slot for r in part) == list(range(20, 37))
    assert {r.slot: bytes(r.tokens) for r in part} == {r.slot: bytes(r.tokens) for r in rows if 20 <= r.slot < 37}
    sizes = {f.length for f in spark.read.format("binaryFile").load(path).select("length").collect()}
    assert all(s % layout.stride == 0 for s in sizes) and max(sizes) == 16 * layout.stride
    assert training_order.materialised_order(docs([])).count() == 0


@pytest.mark.parametrize("ranks", [False, True])
def test_training_order_holds_vocabulary_ids(spark, docs, tmp_path, ranks):
    import public_tokenizers
    from tokenizers import Tokenizer as Library

    rng = random.Random(11)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    odd = [None, "", " ", " a  b", "a\n b\n\nc ", "it's \u00a0x\x1f y", "x <|endoftext|> y", "é👍 ü" * 50, "ends ", "\tz"]
    texts = odd + [_prose(rng, rng.randint(1, 200)) for _ in range(40)]
    texts += ["".join(rng.choice("ab  \n\t'.,0é👍\x1c\u3000") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    layout = training_order.Layout.of(vocabulary, tokens=100, shard_rows=16)
    if ranks:
        layout = training_order.Layout.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),), tokens=100, shard_rows=16)
    path = str(tmp_path / "shards")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")  # must not cut shards
    try:
        total = training_order.write_shards(docs(texts), path, layout)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert spark.read.format("binaryFile").load(path).count() == -(-total // 16)
    rows = sorted(training_order.read_shards(spark, path, layout).collect(), key=lambda r: r.number)
    assert all(len(r.tokens) == 2 * r.n_tokens for r in rows)
    stream = np.concatenate([np.frombuffer(bytes(r.tokens), "<u2") for r in rows])
    ends = np.flatnonzero(stream == layout.end)
    got = sorted(part[part != layout.end].tolist() for part in np.split(stream, ends + 1)[:-1])
    want = [e.ids for e in Library.from_file(vocabulary).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ends[-1] == len(stream) - 1 and got == sorted(want)
    for r in rows:
        whole = np.array([*want[r.doc_id], layout.end], "<u2")
        head = whole[r.place : r.place + r.n_tokens]
        assert len(head) and np.frombuffer(bytes(r.tokens), "<u2")[: len(head)].tolist() == head.tolist()


def _contamination(text, items):
    words = _tokens(text)
    hit, found = set(), set()
    for item, other in items:
        own = _tokens(other)
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if own else 0):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_matches_brute_force(spark, docs):
    rng = random.Random(2)
    items = [(i, _prose(rng, rng.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "ab1"), (2, _prose(rng, 20))]
    texts = [None, "", "AB1!", "..."]
    for _ in range(200):
        text = _prose(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, max(0, len(own) - 1))
            text += " " + " ".join(own[cut : cut + rng.randint(1, 30)]).upper() + ", " + _prose(rng, rng.randint(0, 10))
        texts.append(text)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limits in (decontaminate.ContaminationLimits(), decontaminate.ContaminationLimits(shard_bytes=200)):
        found = decontaminate.contamination(docs(texts).select("doc_id", "text"), benchmark, limits).withColumn("sha", decontaminate.items_digest())
        for row in found.collect():
            assert (row.n_words, row.n_hit, row.n_items, row.sha, row.contaminated) == _contamination(texts[row.doc_id], items), texts[row.doc_id]
    kept = {r.doc_id for r in decontaminate.decontaminate(docs(texts), benchmark).collect()}
    assert kept == {i for i, t in enumerate(texts) if not _contamination(t, items)[4]}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs(texts), benchmark, drop=False).collect()}
    assert len(cut) == len(texts) and all(cut[i] == texts[i] for i in kept)
    wide = docs(texts).select("*", F.lit("x").alias("items"), F.lit(1).alias("row"), F.lit(2).alias("n_words"), F.lit(3).alias("hit_first"))
    for mode in (True, False):
        assert decontaminate.decontaminate(wide, benchmark, drop=mode).columns == wide.columns
    assert {r.row for r in decontaminate.decontaminate(wide, benchmark).collect()} == {1}
    assert decontaminate.contamination(docs(texts), benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs([]), benchmark).count() == 0


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def _classes(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def _near_copies(rng):
    texts = [None, "", "   ", "a b c d e f g h", "a b c d e f g h i", "one two", "One TWO", "one"]
    passage = _prose(rng, 30)
    for _ in range(25):
        base = (_prose(rng, rng.randint(5, 120)) + (" " + passage if rng.random() < 0.4 else "")).split()
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = _prose(rng, 1)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    rng.shuffle(texts)
    return texts


def test_jaccard_components_match_brute_force(spark, docs, monkeypatch):
    texts = _near_copies(random.Random(3))
    sets = {i: _shingles(t) for i, t in enumerate(texts)}
    want = _classes(sets)
    degree = {i: sum(1 for j in sets if j != i and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    for part, often in ((1024, 12), (3, 2)):  # small parts split blocks; low counts make most keys frequent
        monkeypatch.setattr(jaccard, "PART_DOCS", part)
        monkeypatch.setattr(jaccard, "PART_BYTES", part << 12)
        monkeypatch.setattr(jaccard, "FREQUENT_IN_TASK", often)
        rows = jaccard.jaccard_components(docs(texts)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows} == {i: (len(sets[i]), want[i], degree[i]) for i in sets}
    kept = {r.doc_id for r in jaccard.keep_one(docs(texts)).collect()}
    assert kept == {i for i in sets if want[i] == i}


def test_jaccard_odd_rows(spark, docs):
    frame = docs(["a b c d e f", "a b c d e f"]).unionByName(docs(["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs(["a b c d e f"]))
    rows = jaccard.jaccard_components(frame.withColumn("hub", F.lit("x")).withColumn("component_id", F.lit(1))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows) == [(False, 0, 0), (False, 0, 0), (False, 1, 0), (True, 0, None)]
    assert jaccard.jaccard_components(docs([])).count() == 0
    assert jaccard.jaccard_components(docs([None, ""])).count() == 2


def test_count_tree_bound_is_lossless():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, rng.integers(5, 400)).astype(np.uint64) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(6):
            keep = np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * 0.15], rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)]))
            sets.append(keep)
    a, b = rtree.linked_pairs(sets)
    got = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            want.add((i, j))
    assert got == want and want


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_warc_round_trip_and_chain(spark, tmp_path):
    pages = [None, "", "x" * 200, "x" * 200, "y" * 99, "y" * 99, "pre" + FAKE + "post", FAKE, "WARC/1.1\r\n", "WARC/1.1\r\nWARC/1.1\r\nContent-Length: 100000\r\n\r\n", "\r\n\r\n" * 50, "é" * 60, "x" * 200]
    rows = [(i, "http://a/\r\nb" if i % 2 else None, p, "clash") for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    want = {}
    for i, p in enumerate(pages):
        raw = (p or "").encode()
        first = next(k for k, q in enumerate(pages) if (q or "") == (p or ""))
        twin = len(raw) >= 100 and first != i
        want[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if twin else "response", first if twin else None)
    assert {r.page_id: tuple(r)[1:] for r in warc.round_trip(frame).collect()} == want
    path = str(tmp_path / "plain")
    warc.write_archives(frame.repartition(1), path, "none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # records across splits
    try:
        back = {r.page_id: r for r in warc.read_archives(spark, path, payloads=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(back) == len(pages)
    for i, p in enumerate(pages):
        assert back[i].record_type == "revisit" or bytes(back[i].payload) == (p or "").encode()
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_reachable_follows_the_chain_only():
    offset = np.array([0, 5, 10, 12, 20])
    successor = np.array([10, 12, 20, 13, 30])
    assert warc.reachable(offset, successor).tolist() == [True, False, True, False, True]


def test_html_main_text(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><div class="ad">Buy</div>
    <article><h1>A &amp; B</h1><p>one <b>two</b>
    three<br>four<p>x&nbsp;y &copy<script>var t="</p>";</script><ul><li>i<li>j</ul><section class="comments"><p>no</p></section></article>
    <aside>side</aside><footer>foot</footer></body></html>"""
    plain = '<body><div id="top">Shop of Ann</div><div><p>Text {i} is here.</p></div><div>Call us today</div></body>'
    rows = [(0, "http://a.b/1", page), (1, None, None), (2, "x", ""), (3, "http://a.b/2", "<p>un<b>closed &amp;")]
    rows += [(10 + i, f"https://Shop.example/{i}?q", plain.replace("{i}", str(i))) for i in range(8)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "A & B\n\none two three four\n\nx y ©\n\ni\n\nj"
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0
    assert got[3].text == "unclosed &"
    assert [got[10 + i].text for i in range(8)] == [f"Text {i} is here." for i in range(8)]  # the template's own texts are gone
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_classes(spark):
    page = '<body><article><p class="by">Written by our desk</p><p>Story {i} of today</p><p>{odd}</p></article></body>'
    rows = [(i, f"http://news.example/{i}", page.replace("{i}", str(i)).replace("{odd}", "Alone" if i else "Other")) for i in range(12)]
    # One order on even pages and another on odd ones: not a template.
    rows += [(100 + i, f"http://mixed.example/{i}", f"<p>{'Left' if i % 2 else 'Right'}</p><p>{'Right' if i % 2 else 'Left'}</p>") for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # The template decides inside the article too; "Alone" is on 11 of 12 pages, but a class of one token.
    assert [got[i] for i in range(12)] == [f"Story {i} of today\n\n{'Alone' if i else 'Other'}" for i in range(12)]
    assert got[100] == "Right\n\nLeft" and got[101] == "Left\n\nRight"
    assert html_text.order_of([1, 2, 1, 2]) == html_text.order_of([1, 2]) != html_text.order_of([2, 1]) and html_text.order_of([1, 1, 2, 2]) == 0


def test_keep_stages_judge_rows_not_ids(spark):
    from lexmill.llm import quality

    rng = random.Random(21)
    good = [_prose(rng, 60) for _ in range(4)]
    rows = [(None, good[0], "en"), (1, good[1], "en"), (1, "too short", "en"), (None, "too short", "en"), (2, good[2], "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.text for r in quality.keep_good(frame).collect()) == sorted(good[:3])
    rows = [(5, good[0], "en"), (5, good[0], "en"), (6, good[0], "en"), (7, good[3], "en"), (None, good[2], "en"), (None, good[2], "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0, r.text) for r in jaccard.keep_one(frame).collect()) == sorted([(5, good[0]), (7, good[3]), (0, good[2]), (0, good[2])])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    common = "the of and to in a is that for it".split()

    def clean(n=120):
        return " ".join(rng.choice(common) if rng.random() < 0.35 else rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)) + "."

    texts = [clean() for _ in range(40)]
    item = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40))
    texts += [texts[0], texts[1] + " more", "too short", clean(100) + " " + item, "Write to ann@mail.example.com. " + clean(), None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen.append((name, {r.doc_id for r in docs.collect()}))
        if name != "encoding":
            assert docs.columns == before.columns
        if name == "pii":
            redacted = {r.doc_id: r for r in docs.collect()}
            assert "[EMAIL]" in redacted[44].text and redacted[44].n_chars == len(redacted[44].text) and redacted[3].text == texts[3]
    kept = set(range(40)) | {44}
    assert seen[0] == ("quality", kept | {40, 41, 43}) and seen[1] == ("near_duplicates", kept | {43}) and all(ids == kept for _, ids in seen[2:])
    final = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_html_names_inline_elements_and_depth(spark):
    text = lambda page: html_text.main_text(page, frozenset())
    assert text('<p>Keep this text <a class="related">link</a> and this tail</p>') == "Keep this text and this tail"
    page = '<article><div class="article-header"><h1>Title</h1></div><div id="related-work">W</div><section id="nav-theory">N</section><div class="comments-policy">P</div><div class="comments">no</div></article>'
    assert text(page) == "Title\n\nW\n\nN\n\nP"
    assert text("<article>x <svg viewBox='0'/> y <button>Go</button> z</article>") == "x y z"
    assert text("<p>a<script>var x = 1") == "a" and text("a < b and c<d") == "a < b and c"
    assert text("<div>" * 60_000 + "deep" + "</section>" * 60_000) == "deep"
    hosts = spark.createDataFrame([("a.com/x//y",), ("http://u@B.org:8/z",), (None,)], "url string").select(html_text.host_of(F.col("url")).alias("h"))
    assert [r.h for r in hosts.collect()] == ["a.com", "b.org:8", ""]


def test_html_template_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        host = f"h{i % 3}.example"
        extra = "".join(f"<p>{rng.choice(WORDS)} {rng.choice(WORDS)}</p>" for _ in range(rng.randint(0, 4)))
        rows.append((i, f"http://{host}/{i}", f"<body><div><p>Top of {host}</p></div><article><p>Story {i}</p>{extra}</article><p>End of {host}</p></body>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", html_text.host_of(F.col("url")))
    got = {r.host: set(r.template) for r in html_text.templates(frame).collect()}
    for host in {f"h{k}.example" for k in range(3)}:
        pages = [html_text.Page(h) for _, u, h in rows if host in u]
        streams = [[html_text._signed(t) for t in p.stream] for p in pages]
        vectors: dict = {}
        for token in {t for s in streams for t in s}:
            vector = tuple(s.count(token) for s in streams)
            if sum(n > 0 for n in vector) >= 0.9 * len(streams):
                vectors.setdefault(vector, []).append(token)
        want = set()
        for members in vectors.values():
            orders = [[t for t in s if t in members] for s in streams]
            if len(members) >= 2 and sum(html_text.order_of(o) == html_text.order_of(orders[0]) != 0 for o in orders) >= 0.9 * len(streams):
                want |= set(members)
        assert got[host] == want
