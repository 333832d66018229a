"""Mixed languages, resource units, masked tokens."""

from pyspark.sql import functions as F

from lexmill.operators import findings, mask, mixed, segment


def test_languages_and_halves(spark):
    df = spark.createDataFrame([(1, "این کتاب خوب است\nThis is a robust plan\n12\nكتاب")], "doc_id long, text string")
    assert [r.language for r in mixed.line_languages(df).orderBy("line").collect()] == ["fa", "en", "fa", "fa"]
    persian, english = mixed.split_documents(df)
    assert english.first().text == "\nThis is a robust plan\n\n"
    got = {(r.language, r.line, r.code) for r in mixed.mixed_findings(df).collect()}
    assert {("en", 2, "en-buzzword"), ("fa", 4, "arabic-kaf")} <= got
    assert mixed.coverage(df).first().placeholders == 0 and persian.count() == 1


def test_units(spark):
    units = spark.createDataFrame([(1, "a", "fine\nrobust colour", 7), (1, "b", "color", 9)], "doc_id long, unit_key string, value string, line long")
    assert [(r.unit_key, r.line, r.col, r.code) for r in mixed.unit_findings(units).collect()] == [("a", 8, 1, "en-buzzword")]
    assert [r.code for r in mixed.file_mixes(units).collect()] == ["en-spelling-mix"]


def test_masked_tokens_break_ngrams(spark):
    row = spark.createDataFrame([("We met Ann at 5pm. See NASA and we left http://a.b now",)], "t string").select(mixed.masked_tokens(F.col("t"), "en").alias("t")).select("t", segment.ngrams(F.col("t"), 2).alias("g")).first()
    assert list(row.t) == ["we", "met", None, "at", None, None, None, "and", "we", "left", None, "now"]
    assert list(row.g) == ["we met", "and we", "we left"]


def test_ignored_blocks_and_names(spark):
    text = "a\n<!-- lint-ignore -->\nWe delve.\n```\n<!-- /lint-ignore -->\n```\n<!-- /lint-ignore -->\nWe delve, Acme"
    row = spark.createDataFrame([(text,)], "t string").select(mixed.without_ignored(F.col("t")), mixed.without_names(F.col("t"), ["acme"])).first()
    assert row[0] == "a\n\n\n\n\n\n\nWe delve, Acme" and "Acme" not in row[1]
    found = findings.english_findings(spark.createDataFrame([(1, text), (2, "<!-- lint-ignore -->\nWe delve")], "doc_id long, text string"))
    assert [(r.doc_id, r.line, r.code) for r in found.collect()] == [(1, 8, "en-ai-vocab")]


def test_messages_keep_their_branches():
    value = "{n, plural, one {# robust file} other {# files}} for {name} and %1$s"
    masked = mixed.masked_message(value)
    assert len(masked) == len(value) and "robust file" in masked and "files" in masked
    assert not any(x in masked for x in ("plural", "one ", "other", "name", "#", "%1$s")) and masked.count(mask.BLOCK) == 4
    assert mixed.masked_message("plain") == "plain" and mixed.masked_message(None) is None


def test_table_cells_have_their_own_language(spark):
    df = spark.createDataFrame([(1, "| سلام دنیا | robust plan |\nThis is a long English line")], "doc_id long, text string")
    persian, english = mixed.split_documents(df)
    assert "robust" not in persian.first().text and "robust" in english.first().text and "سلام" in persian.first().text
    assert persian.first().text.split("\n")[0].count("|") == 3
