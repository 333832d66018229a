"""Functions, segmentation, documents rules, statistics and sources."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lexmill.functions import lengths
from lexmill.functions.spans import match_spans
from lexmill.operators import findings, joins, mask, outcome, policy, segment, structure, weekly
from lexmill.operators.findings import Settings
from lexmill.rules import english
from lexmill.sources import documents, locale, sinks, tables
from lexmill.streaming import weekly as stream


def _one(spark, text, *columns):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").select(*columns).first()


def test_length_units(spark):
    t = F.col("text")
    row = _one(spark, "👍🏽a é", lengths.chars(t), lengths.utf8_bytes(t), lengths.utf16_units(t), lengths.words(t), lengths.graphemes(t), lengths.weighted(t))
    assert tuple(row) == (5, 12, 7, 2, 4, 5)
    assert _one(spark, "x" * 161, lengths.sms_segments(t))[0] == 2
    assert _one(spark, "é€" * 40, lengths.sms_units(t))[0] == 120
    assert _one(spark, "سلام" * 18, lengths.sms_segments(t))[0] == 2
    assert _one(spark, "a, b\n، c", F.size(lengths.items(t)))[0] == 3
    assert list(_one(spark, "x #one, #two", lengths.hashtags(t))[0]) == ["#one", "#two"]
    assert _one(spark, "see https://example.com/a now", lengths.weighted(t))[0] == 4 + 23 + 4
    assert [_one(spark, x, lengths.weighted(t))[0] for x in ("👨‍👩‍👧 ©", "1️⃣ ok", "🇮🇷🇮🇷", "中文", "❤️", "e\u0301")] == [4, 5, 4, 4, 2, 1]


def test_syllables(spark):
    known = {
        "table": 2, "radio": 3, "every": 2, "people": 2, "lately": 2, "jumped": 1, "wanted": 2, "watches": 2, "easier": 3, "b2b": 1, "realism": 3, "didn't": 2, "isn’t": 2, "café": 2, "naïve": 2, "résumé": 2,
        "well-being": 3, "makes": 1, "tables": 2, "premium": 3, "actual": 3, "don't": 1, "played": 1, "centre": 2, "awareness": 3, "management": 3, "couldn't": 2, "media": 3, "video": 3, "e-mail": 2, "-": 1, "aren't": 1, "prism": 2,
    }
    rows = spark.createDataFrame([(w,) for w in known], "w string").select("w", lengths.syllables(F.col("w")).alias("n")).collect()
    assert {r.w: r.n for r in rows} == known


def test_spans_and_masks(spark):
    row = _one(spark, "a👍bab", match_spans(F.col("text"), "b"))
    assert [(s.start, s.end) for s in row[0]] == [(2, 3), (4, 5)]
    for text in ("x `c` [l](http://a.b/(c)) {{v}}\n```\ncode\n```\n<b>t</b>", "---\na: b\n---\nhello", "", "`" * 5000):
        assert len(mask.masked(text)) == len(text)
        assert mask.masked(text).count("\n") == text.count("\n")


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([(1, "Dr. Lee came. J. Smith left! Why? Yes.")], "doc_id long, text string")
    assert [r.text for r in segment.sentences(df).orderBy("ord").collect()] == ["Dr. Lee came.", "J. Smith left!", "Why?", "Yes."]


def test_segments(spark):
    df = spark.createDataFrame([(1, "> q\n> r\n\n| a | b |\n|---|---|\n| c\\|d | |\n\nend")], "doc_id long, text string")
    assert [(r.first, r.last) for r in segment.quote_blocks(df).collect()] == [(1, 2)]
    assert [r.cell for r in segment.table_cells(df).orderBy("line", "pos").collect()] == ["a", "b", "c\\|d"]
    grams = spark.createDataFrame([(["a", None, "b", "c"],)], "t array<string>").select(segment.ngrams(F.col("t"), 2)).first()[0]
    assert list(grams) == ["b c"]


def test_document_rules(spark):
    same = "The cat ran. The dog sat. The cow ate. A bird."
    df = spark.createDataFrame([(1, same), (2, "Gray colour! Grey color!"), (3, "- **A:** x\n- **B:** y\n- **C:** z"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.code) for r in structure.english_document_findings(df, Settings(kind="md")).collect()}
    assert {(1, "en-same-opening"), (2, "en-spelling-mix"), (2, "en-bangs"), (3, "en-inline-header-bullets")} <= got
    assert not any(d == 4 for d, _ in got)
    n = spark.createDataFrame([("ISBN 0-306-40615-2",), ("9780306406157",), ("0306406153",)], "n string").select(structure.isbn_valid(F.regexp_replace("n", "ISBN", ""))).collect()
    assert [r[0] for r in n] == [True, True, False]


def _rules(spark, text, make, kind="text"):
    rows = segment.structured(spark.createDataFrame([(1, text)], "doc_id long, text string"), "en", kind)
    rows = rows.withColumns({"own": structure.own_lines(F.col("lines"), kind), "n_words": structure.total_words(F.col("sents"))})
    return [(r.line, r.code, r.severity) for r in structure.document_findings(rows, [make()]).orderBy("line").collect()]


def test_document_rules_by_place(spark):
    c = F.col
    assert _rules(spark, "a. b.\nOne two. One three. One four. One five. Two.", lambda: structure.same_opening(c("sents"))) == [(2, "en-same-opening", "warning")]
    assert _rules(spark, "x — y\n\na — b — c\n— d", lambda: structure.dash_density(c("lines"), c("n_words"))) == [(3, "en-dash-density", "warning")]
    assert _rules(spark, "word " * 120 + "\n" + "word " * 40 + "\n\n" + "word " * 10, lambda: structure.long_paragraphs(c("lines"))) == [(1, "en-long-paragraph", "warning")]
    passive = "It was made. It was done. We ran. We sat. We ate. We slept. It is sold. It is kept."
    assert len(_rules(spark, passive, lambda: structure.passive_density(c("sents")))) == 3
    assert _rules(spark, "Six cats sat. 7 cats sat. 1999 was fine.\n- 3 cups", lambda: structure.numeral_starts(c("sents"))) == [(1, "en-numeral-start", "warning")]
    assert _rules(spark, "It’s fine.\nHe said \"no\" and 'yes'.", lambda: structure.quote_mix(c("own"))) == [(1, "en-quote-mix", "warning")]
    assert _rules(spark, "The NGOX met (ABCD) and ABCD. " + "word " * 90 + "NGOX VII API", lambda: structure.undefined_abbreviations(c("lines"), c("n_words"))) == [(1, "en-undefined-abbr", "warning")]
    assert _rules(spark, "See ISBN 0306406152\nand ISBN 0306406153", lambda: structure.isbns(c("lines"))) == [(1, "en-citation-check", "warning"), (2, "en-citation-check", "error")]
    dense = "We delve into a tapestry of pivotal things. " + "word " * 160
    assert _rules(spark, dense, lambda: structure.vocabulary_density(c("body"), c("n_words"))) == [(0, "en-ai-vocab-density", "error")]
    assert _rules(spark, "word " * 200 + "delve pivotal " + "word " * 400 + "tapestry", lambda: structure.vocabulary_density(c("body"), c("n_words"))) == []
    assert _rules(spark, "> a!\n> b!\nc!", lambda: structure.marks_over(c("own"), "!", 1, "en-bangs"), "md") == []


def test_many_spans_in_one_text(spark):
    row = _one(spark, "ab " * 40_000, F.size(match_spans(F.col("text"), "b")), F.element_at(match_spans(F.col("text"), "b"), -1))
    assert row[0] == 40_000 and row[1].start == 3 * 39_999 + 1


def test_spelling_variants_and_evidence(spark):
    df = spark.createDataFrame([(1, "Colour and organize, Analyze"), (2, "Meet Mr Color. We like grey, and Honour too.")], "doc_id long, text string")
    words = segment.words(df)
    assert {(r.word, r.write) for r in structure.spelling_variants(words, "uk").where("doc_id = 1").collect()} == {("organize", "organise"), ("Analyze", "Analyse")}
    assert structure.spelling_variants(words, "uk-ize").where("doc_id = 1").count() == 0
    got = {r.doc_id: (r.us, r.uk, r.ize, r.variant) for r in structure.spelling_evidence(df).collect()}
    assert got == {1: (1, 1, 1, "uk-ize"), 2: (0, 1, 0, "uk")}
    assert len(english.SPELLING_FORMS) > 1000 and english.SPELLING_FORMS["theatre"] == ("er-re", "uk", "theater") and "analyses" not in english.SPELLING_FORMS
    found = findings.english_findings(df, Settings(spelling="us")).where("code = 'en-spelling-variant'").collect()
    assert sorted(r.text for r in found) == ["Colour", "grey"]


def test_apportion_keeps_the_cap(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("a", 3, 5), ("b", 1, 2)], "k string, p long, v long")
    out = weekly.apportion(rows, ["k"], "p", "v", 7).collect()
    got = {(r.k, r.p): r.share for r in out}
    assert sum(v for (k, _), v in got.items() if k == "a") == 7
    assert got[("b", 1)] == 2 and got[("a", 1)] == 2 and got[("a", 3)] == 3


def test_weeks_and_buckets(spark):
    row = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date").select(weekly.iso_week(F.col("d")), weekly.canary_bucket(F.lit("x"))).first()
    assert row[0] == "2025-W01"
    import hashlib

    assert row[1] == int(hashlib.sha256(b"x").hexdigest()[:16], 16) % 10_000


def test_overlay_and_layers(spark):
    found = spark.createDataFrame([(1, "a", "warning"), (1, "b", "warning"), (1, "c", "error")], "doc_id long, code string, severity string")
    level = spark.createDataFrame([("a", "off"), ("b", "error"), ("c", "shadow")], "code string, level string")
    got = {(r.code, r.severity, r.hidden) for r in joins.with_overlay(found, level).collect()}
    assert got == {("b", "error", False), ("c", "error", True)}


def test_outcomes_and_fixes(spark):
    refusals = [outcome.refusal(*x) for x in ((None, "x"), ("x", "x"), ("x", "y", 3), ("x", "y", 0, 20), ("x" * 20_001, "y"), ("x", "y"))]
    assert refusals == ["unlinted", "unchanged", "session_budget", "week_budget", "too_long", None]
    case = outcome.Case("One two three. Same here.", "One two four. Same here.", salt=b"s", shown_findings=(outcome.Finding("en-x", 0, 0, 1),), final_findings=(outcome.Finding("en-y", 1),), checks=(("en-x", "shadow", False), ("en-y", "error", True)))
    got = outcome.measure(case)
    assert (got["ta"], got["td"], got["er"], got["fe"], got["pl_n"], got["pl_g"]) == (5, 1, 0.2, 1, 1, 1)
    assert got["cells"] == [{"id": "en-x", "kept": 0, "ho": 1, "hg": 1}, {"id": "en-y", "kept": 1, "ho": 0, "hg": 0}]
    assert outcome.half_up(1, 8) == 0.13 and outcome.half_up(1, 3) == 0.33 and outcome.bucket(0.3, 0.1) == 3
    assert _one(spark, "He said \"it's `a \"b\"` so\"", outcome.fix_quotes(F.col("text")))[0] == "He said “it’s `a \"b\"` so”"
    assert _one(spark, "Colour and GREY at http://colour.example", outcome.fix_spelling(F.col("text"), "us"))[0] == "Color and GRAY at http://colour.example"
    text = "End.  Next — now `a.  b`.\n# Title."
    once = _one(spark, text, outcome.fix_english(F.col("text")))[0]
    assert once == "End. Next—now `a.  b`.\n# Title"
    assert _one(spark, once, outcome.fix_english(F.col("text")))[0] == once
    fixed = _one(spark, "كتاب ها, می رود?", outcome.fix_persian(F.col("text")))[0]
    assert fixed == "کتاب‌ها، می‌رود؟"
    assert _one(spark, fixed, outcome.fix_persian(F.col("text")))[0] == fixed


def test_policy():
    got, source = policy.resolve({"default": {"max_words": 25, "allow": ["Fine"]}, "brand": {"banned": ["fine"], "max_words": 20}, "format-default": {"max_words": 30}, "host": {"max_words": 15}})
    assert got["max_words"] == 15 and source["max_words"] == "host" and got["allow"] == []
    assert policy.settings({"dials": {"sentence_length": 1}}, "caption").max_words == 15
    assert policy.validate({"dials": {"x": 9}, "banned": [1]}) == [("banned", "not a list of words"), ("dials.x", "not a whole number from 0 to 5")]
    assert policy.migrate({"version": 1, "words": {"banned": ["a"]}})[0] == {"version": 3, "banned": ["a"]}


def test_locale_files():
    assert locale.json_entries('{\n "a": "x",\n "@a": {"d": "no"},\n "b": ["y", {"c": "z"}]\n}') == [("a", "x", 2), ("b[0]", "y", 4), ("b[1].c", "z", 4)]
    po = 'msgctxt "m"\nmsgid "Open"\nmsgstr "Op"\n"en it"\n\nmsgid "n"\nmsgid_plural "ns"\nmsgstr[0] "one"\nmsgstr[1] "many"\n'
    assert [(k, v) for k, v, _ in locale.po_entries(po)] == [("m|Open", "Open it"), ("n[0]", "one"), ("n[1]", "many")]
    untranslated = 'msgid "Plain"\nmsgstr ""\n\nmsgid "سلام"\nmsgstr ""\n\nmsgctxt "c"\nmsgid ""\nmsgstr "x"\n\nmsgid "' + "k" * 80 + '"\nmsgstr "v"\n'
    assert [(k, v) for k, v, _ in locale.po_entries(untranslated)] == [("سلام", "سلام"), ("c|", "x"), ("k" * 60, "v")]
    xml = '<resources>\n<string name="a">It\\\'s &amp; b</string><string name="t" translatable="false">x</string>\n<plurals name="p"><item quantity="one">1 day</item></plurals></resources>'
    assert locale.android_entries(xml) == [("a", "It's & b", 2), ("p[one]", "1 day", 3)]
    assert locale.xliff_entries('<trans-unit id="u"><source>s</source><target>t</target></trans-unit>') == [("u", "t", 1)]
    assert locale.strings_entries('/* "x" = "y"; */\n"k" = "v\\n";') == [("k", "v\n", 2)]
    assert locale.entries("a.json", "{broken") == []


def test_tables_and_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('sku,title,price\n1,"A, b\nc",3\n2,,4\n', encoding="utf-8")
    assert [(r.unit_key, r.value) for r in tables.csv_cells(spark, str(tmp_path / "c.csv")).collect()] == [("row 2/1/title", "A, b\nc")]
    (tmp_path / "two").mkdir()
    for name in ("x.csv", "y.csv"):
        (tmp_path / "two" / name).write_text("id;name\na;\"one\n1\"\nb;two\n", encoding="utf-8")
    assert sorted((r.file[-5:], r.unit_key, r.line) for r in tables.csv_cells(spark, str(tmp_path / "two")).collect()) == [(f, k, n) for f in ("x.csv", "y.csv") for k, n in (("row 2/a/name", 2), ("row 3/b/name", 4))]
    (tmp_path / "e.jsonl").write_text('{"t":"lint","e":"2024-W05","w":3}\nbroken\n{"t":"lint","e":"2024-W99"}\n')
    assert [r.w for r in tables.events(spark, str(tmp_path / "e.jsonl")).collect()] == [3]
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "a.md").write_bytes(b"\xef\xbb\xbf# T\r\nx")
    (folder / "b.txt").write_bytes("hi".encode("utf-16"))
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text) for r in documents.read_documents(spark, str(folder)).collect()}
    assert got == {"a.md": ("md", "# T\nx"), "b.txt": ("text", "hi")}
    df = spark.createDataFrame([(1, "# A\nx\n## B\n```\n# no\n```\n# C")], "doc_id long, text string")
    assert [(r.first, r.last, r.title) for r in tables.sections(df).orderBy("first").collect()] == [(1, 6, "A"), (3, 6, "B"), (7, 7, "C")]


def test_sinks(spark):
    rows = spark.createDataFrame([(1, 1, 2, 3, "c", "error", "t")], "doc_id long, place int, line int, col int, code string, severity string, text string")
    report = json.loads(sinks.json_report(rows).first().report)
    assert report["version"] == 2 and report["summary"] == {"errors": 1, "warnings": 0}
    assert _one(spark, "=1+1", sinks.csv_safe(F.col("text")))[0] == "'=1+1"
    packed = sinks.packets(spark.createDataFrame([("k", 1), ("k", 2)], "k string, v int"), ["k"], [F.col("v")]).first().packet
    assert json.loads(packed) == [{"v": 1}, {"v": 2}]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), i % 3) for i in range(60)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    table.unionByName(table.limit(5)).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))

    def run(df, mode):
        name = f"out_{mode}_{abs(hash(df))}"
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(stream.weekly_counts(source), "complete") == sorted(map(tuple, stream.weekly_counts(spark.read.parquet(str(tmp_path / "in"))).collect()))
    assert len(run(stream.distinct_events(source, "event_id"), "append")) == 60
    assert len(run(stream.within_budget(source, most=2), "append")) == 3 * 2 * 3
