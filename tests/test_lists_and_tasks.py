"""Comma lists, Persian document rules, tasks and text functions."""

from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import joins, lists, persian_structure, policy, segment, tasks, weekly
from lexmill.operators.findings import Settings


def test_list_reader():
    cases = {
        "We sell tea, coffee, and milk.": [(True, 3)],
        "We sell tea, coffee and milk.": [(False, 3)],
        "We sell tea and milk.": [],
        "In June, we sold tea and milk.": [],
        "If it rains, we stay and read.": [],
        "Bring pens, paper, ink, and glue now.": [(True, 4)],
    }
    assert {s: [(serial, n) for _, serial, n in lists.list_series(s)] for s in cases} == cases


def test_list_findings(spark):
    body = "Red, green, and blue win. Cats, dogs, and birds run. " + "We walk on and on here. " * 11 + "Tea, milk and ice."
    df = spark.createDataFrame([(1, body)], "doc_id long, text string")
    rows = segment.sentences(df)
    found = lists.series(rows)
    assert lists.triads(rows, found).count() == 3
    assert lists.serial_commas(found).count() == 1 and lists.serial_commas(found, True).count() == 1 and lists.serial_commas(found, False).count() == 2


def test_persian_document_rules(spark):
    rows = [
        (1, "این کتاب را دیدم و آن را خریدم."),
        (2, "می‌گوید که او که آمد گفت که خوب است."),
        (3, "اگه خونه بودم خوب است."),
        (4, "آیا خوب بود؟ بله."),
        (5, "خودت بیا و ببین."),
        (6, "سلام! خوبی! بیا!"),
        (7, "او رفت. او آمد. او ماند. کسی نبود."),
        (8, "plain latin"),
        (9, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.code) for r in persian_structure.persian_document_findings(df, Settings(max_words=24, address="shoma")).collect()}
    assert {(1, "ra-chain"), (2, "ke-chain"), (3, "mixed-register"), (4, "rhetorical-open"), (5, "address"), (6, "bangs"), (7, "same-opening")} <= got
    assert not any(d in (8, 9) for d, _ in got)


def test_tasks(spark):
    asked = spark.createDataFrame([("Please write a post",), ("Translate this",), ("shorten it",), ("بازبینی متن",), ("hello",)], "q string")
    assert [r[0] for r in asked.select(tasks.operation_of(F.col("q"))).collect()] == ["write", "translate", "rewrite", "review", "write"]
    locks = tasks.fact_locks(spark.createDataFrame([(1, "5% of 1,000 at https://a.b/c and 5%")], "pack_id long, text string"))
    assert sorted((r.kind, r.value) for r in locks.collect()) == [("number", "1,000"), ("number", "5%"), ("url", "https://a.b/c")]
    out = spark.createDataFrame([(1, {"title": "5% win", "body": ""})], "pack_id long, content map<string,string>")
    problems = tasks.output_problems(out, locks, spark.createDataFrame([(1, "title"), (1, "body")], "pack_id long, section string"), spark.createDataFrame([(1, "WIN")], "pack_id long, phrase string"))
    assert sorted((r.problem, r.value) for r in problems.collect()) == [("forbidden addition", "WIN"), ("lost number", "1,000"), ("lost url", "https://a.b/c"), ("missing section", "body")]
    a = spark.createDataFrame([("k", "Hi {n}"), ("m", "x %s")], "unit_key string, value string")
    b = spark.createDataFrame([("k", "Yo {n}"), ("m", "x")], "unit_key string, value string")
    assert [r[0] for r in tasks.placeholder_drift(a, b).collect()] == ["m"]
    diff = tasks.text_differences(spark.createDataFrame([(1, "from 5 to Ann's, see Bob", "see 7 and see Bob")], "case_id long, shown string, final string"))
    assert {r.kind: (list(r.added), list(r.removed)) for r in diff.collect()}["number"] == (["7"], ["5"])
    books = spark.createDataFrame([("set-up", "Set up mail", "mail"), ("send-mail", "Send mail", "mail")], "anchor string, title string, task string")
    found = tasks.playbook_search(spark.createDataFrame([(1, "send-mail", "mail")], "query_id long, text string, task string"), books).where("place = 1").first()
    assert found.anchor == "send-mail" and found.score == 9.0


def test_text_functions(spark):
    row = spark.createDataFrame([("كتاب  ٣ می‌رود [x] [y](z)",)], "t string").select(
        text.placeholders(F.col("t")), text.persian_normal(F.col("t")), text.slug(F.lit("Hello, World 2")), text.like_case(F.lit("colour"), F.lit("Color")), text.lemma(F.lit("Delving")), text.percent_encoded(F.lit("a b/ç")), text.percent_decoded(F.lit("a%20b+")), text.number_normal(F.lit("۱٬۲۰۰")), text.quote_normal(F.lit("“A  b”"))
    ).first()
    assert tuple(row) == (1, "کتاب 3 می‌رود [x] [y](z)", "hello-world-2", "Colour", "delv", "a%20b%2F%C3%A7", "a b+", "1200", "a b")


def test_address_forms(spark):
    said = ["کیک رو تو فر بذار", "به تو گفتم", "تو را دیدم", "کتابت", "کتاب‌ت", "تو خونه", "تو هم می‌خوای", "ببین!"]
    df = spark.createDataFrame(list(enumerate(said)), "i long, t string").select("i", persian_structure.address_forms(F.col("t"), "to").alias("f"))
    got = {r.i: list(r.f) for r in df.collect()}
    assert got[0] == ["بذار"] and got[1] == ["تو"] and got[2] == ["تو"] and got[3] == [] and got[4] == ["‌ت"] and got[5] == [] and "تو" in got[6] and got[7] == ["ببین"]


def test_task_ranking(spark):
    asked = spark.createDataFrame([(1, "Write a product page for an email"), (2, "a mailing list"), (3, "email, but no newsletter"), (4, "ops.report please")], "request_id long, text string")
    signals = spark.createDataFrame([("t.mail", "email", 0), ("t.page", "product page", 0), ("t.news", "newsletter", 1), ("ops.report", "report", 0)], "task string, signal string, priority int")
    out = spark.createDataFrame([("t.mail", "newsletter")], "task string, signal string")
    got = {(r.request_id, r.place): (r.task, r.score, r.ambiguous) for r in joins.task_ranking(asked, signals, out).collect()}
    assert got[1, 1] == ("t.mail", 26.05, False) and got[1, 2] == ("t.page", 18.12, False)
    assert got[2, 1] == ("other", 0.0, True) and got[3, 1] == ("t.news", 15.1, False) and got[3, 2][1] == -5.95
    assert got[4, 1] == ("ops.report", 114.06, False)


def test_briefs_and_channels(spark):
    docs = spark.createDataFrame([(1, "We sold 1,200 cups to Ann at https://a.b/c. “It was a great day”, she told Bob 3.50 times.")], "doc_id long, text string")
    briefs = spark.createDataFrame([(1, "Sold 1200 cups; 3.5 times. Ann came.")], "doc_id long, facts string")
    got = {(r.kind, r.value) for r in joins.fact_findings(docs, briefs).collect()}
    assert got == {("name", "bob"), ("url", "https://a.b/c"), ("quote", "it was a great day")}
    limits = spark.createDataFrame([("sms", "body", "segment", 2, 70, None, "verified", "sms", 459), ("ig", "hashtags", "items", None, None, 2, "draft", None, None)], "channel string, field string, unit string, max_chars int, visible_chars int, max_items int, status string, kind string, latin_max_chars int")
    texts = spark.createDataFrame([(1, "x" * 400, "sms", "body"), (2, "سلام" * 50, "sms", "body"), (3, "#a #b #c", "ig", "hashtags")], "doc_id long, text string, channel string, field string")
    found = joins.channel_findings(texts, limits).collect()
    assert sorted((r.doc_id, r.code, r.severity) for r in found) == [(2, "en-channel-length", "error"), (3, "en-channel-items", "warning")]
    assert {r.code for r in joins.channel_findings(texts, limits, "fa").collect()} == {"channel-length"}


def test_phrases_and_report(spark):
    rows = [("en", "a", 1, "short", 1, 0), ("en", "a", 2, "long", 1, 1), ("en", "a", 2, "long", 0, 1), ("en", "b", 1, "ui", 1, 0), ("en", "b", 1, "ui", 1, 0)]
    got = weekly.selected_phrases(spark.createDataFrame(rows, "lang string, ng string, day int, fg string, deleted int, kept int")).collect()
    assert [(r.ng, r.fg, r["del"], r.kept, r.place) for r in got] == [("a", "short", 2, 2, 1)]
    events = spark.createDataFrame([], weekly.EVENTS)
    assert all(df.count() == 0 for df in weekly.report(events).values())


def test_overlay_caps():
    context = {
        "baseline": {"id": "b", "lang": {"en": {"severity": {}, "params": {}}}}, "builtin": {"en": {"r1": "warning", "r2": "warning", "r3": "error", "r4": "warning"}}, "phrase_rules": {"en": {"lx-1": "r1"}}, "locked": {"r4"},
        "vocabulary": {"en": {"big", "win"}}, "sensitive": {"en": {"ann"}}, "stop": {"en": {"big"}}, "params": {"en:max": {"min": 1, "max": 50, "default": 20}}, "channels": {"c"}, "today": 100,
        "caps": {"cumulative": {"severity_steps": 1, "phrases_per_lang": 1, "param_pct": 50, "max_shadow_share": 0.5}, "per_release": {"severity_step": 1, "param_step_pct": 20, "rules": 1, "phrase_demotions": 1, "phrase_new": 1, "phrase_promotions": 1}, "rolling": {"min_days_between_auto": 7, "window_days": 28, "rules": 3, "phrase_demotions": 3, "cooldown_days": 14}},
    }

    def verdict(severity=None, params=None, phrases=(), base="b", **more):
        overlay = {"id": "o", "base": base, "lang": {"en": {"severity": severity or {}, "params": params or {}, "phrases": list(phrases)}}}
        got = policy.check_overlay(overlay, context | more)
        return got["result"], got["code"]

    assert verdict() == ("accept", None) and verdict(base="x") == ("reject", "base_mismatch")
    assert verdict({"r4": "error"}) == ("reject", "locked") and verdict({"r3": "shadow"}) == ("reject", "cumulative_severity") and verdict({"r1": "off"}) == ("reject", "rule_off")
    assert verdict(phrases=[{"id": "p", "phrase": "ann", "state": "shadow"}]) == ("reject", "phrase_not_vocab") and verdict(phrases=[{"id": "p", "phrase": "big", "state": "shadow"}]) == ("reject", "phrase_stopwords")
    assert verdict(phrases=[{"id": "p", "phrase": "big win", "state": "warning"}]) == ("accept", None)
    assert verdict(params={"max": 60}) == ("reject", "param_range") and verdict(params={"max": 35}) == ("reject", "param_cumulative") and verdict(params={"max": 26}) == ("accept_gap", "param_step")
    assert verdict({"r1": "shadow", "r2": "shadow"}) == ("reject", "shadow_floor") and verdict({"r1": "error", "r2": "error"}) == ("accept_gap", "per_release_rules")
    assert verdict({"r1": "error"}, activations=[{"at": 97, "rules": [], "phrase_demotions": [], "changed": []}]) == ("defer", "release_interval")
    assert verdict({"r1": "error"}, activations=[{"at": 90, "rules": ["r1"], "phrase_demotions": [], "changed": ["r1"]}]) == ("defer", "cooldown")
    assert policy.settings({"register": "written", "banned": [1]}).problems == (("profile-invalid", "banned: not a list of words"), ("profile-register-alias", "register written is formal"))


def test_sections_and_pages(spark):
    from lexmill.operators import findings
    from lexmill.sources import sinks, tables

    df = spark.createDataFrame([(1, "intro\n# A\n## B\n### C\n## D!\n~~~\n# no\n~~~\n# E")], "doc_id long, text string")
    assert [(r.first, r.last, r.level, r.anchor) for r in tables.sections(df).orderBy("first").collect()] == [(2, 8, 1, "a"), (3, 4, 2, "b"), (4, 4, 3, "c"), (5, 8, 2, "d"), (9, 9, 1, "e")]
    rows = spark.createDataFrame([(1, i, "error" if i < 2 else "warning", f"c{i % 3}") for i in range(1, 8)], "doc_id long, place int, severity string, code string")
    first, cursor = findings.page(rows, None, 3)
    after = first.select(cursor.alias("c")).first().c
    assert [r.place for r in findings.page(rows, after, 3)[0].orderBy("place").collect()] == [4, 5, 6]
    assert dict(findings.hit_map(rows, "doc_id", most=2).first().hits) == {"c0": 2, "c1": 3}
    many = spark.createDataFrame([({f"rule-{i}": i + 1 for i in range(40)},), ({"a": 1},)], "hits map<string,long>")
    cut = sorted(len(r.hits) for r in sinks.bounded_hits(many, 200).collect())
    assert cut == [1, 10] and findings.of_severity(rows, "errors").count() == 1
