"""What the Jaccard join moves between tasks."""

from lexmill.llm import jaccard


def test_texts_without_partner_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"one two three four five {i // 2}") for i in range(20)], "doc_id long, text string")
    alive = spark.createDataFrame([(0, 0), (0, 1)], "hub long, doc long")
    nodes = spark.createDataFrame([(i, 2, 1) for i in range(20)], "doc long, n_shingles long, copies long")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = jaccard.verified_links(docs, alive, nodes)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {(r.doc, r.root, r.n) for r in found.collect()}
    finally:
        spark.conf.set(key, before)
    assert rows == {(0, 0, 1), (1, 0, 1)}
    shuffled = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(doc" in line]
    assert "BroadcastHashJoin [doc" in plan and not shuffled
