"""Edge cases of routing, plans, inventories and profiles: nulls, ties, cycles, empty tables."""

from pyspark.sql import functions as F

from granary.operators import graph, registry, routing, tables

CAPABILITIES = [("a_b", "e0", "de", ["eins", "zwei"], ["drei"], "", ["X"]), ("c_d", "e0", "de", ["eins"], [], "", []), ("e_f", "e1", "fr", [], ["eins zwei"], "", [])]


def test_matches_and_plan(spark):
    asked = spark.createDataFrame([(1, "eins zwei", []), (2, None, []), (3, "", ["X"])], "request_id int, text string, entities array<string>")
    found = routing.matches(asked, CAPABILITIES)
    score = {(r.request_id, r.capability_id): r.score for r in found.collect()}
    assert len(score) == 9 and score[2, "a_b"] == 0 and score[3, "a_b"] > 0 == score[3, "c_d"]
    plan = routing.planned(found).where("request_id = 1").orderBy("step").collect()
    assert [r.expert_id for r in plan] == ["e0", "e1"] and [r.step for r in plan] == [1, 2]
    assert routing.planned(found.limit(0)).count() == 0


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "Alpha stands in this sentence. ALPHA STANDS IN THIS SENTENCE. Nothing of it is here at all."), (2, None), (3, "")], "id int, text string")
    assert {tuple(r) for r in routing.extracted(docs, ["alpha", "beta"]).collect()} == {(1, 1, 0.5, 0.565), (2, 0, 0.0, 0.1), (3, 0, 0.0, 0.1)}


def test_blocked_and_skipped(spark):
    tasks = spark.createDataFrame([(i,) for i in range(7)], "task long")
    needs = spark.createDataFrame([(1, 0), (2, 1), (1, 2), (3, 2), (4, 4), (5, 0), (6, 99), (5, 0)], "task long, needs long")
    assert {r.task for r in graph.blocked(tasks, needs).collect()} == {1, 2, 3, 4}
    assert graph.blocked(tasks, needs.limit(0)).count() == 0
    assert {r.task for r in graph.skipped(tasks.where("task = 0"), needs).collect()} == {1, 2, 3, 5}
    assert graph.skipped(tasks.limit(0), needs).count() == 0


def test_registered(spark):
    shape = "model_id int, tier string, tier_default boolean"
    old = spark.createDataFrame([(1, "slm", True), (2, "slm", False), (3, "small", True)], shape)
    new = spark.createDataFrame([(2, "slm", True), (4, "slm", True)], shape)
    assert {tuple(r) for r in registry.registered(old, new).collect()} == {(1, "slm", False), (2, "slm", False), (4, "slm", True), (3, "small", True)}


def test_profiles(spark):
    rows = spark.createDataFrame([("1.234,5", "x", None), ("2", "3", None), ("4", "y", "z")], "a string, b string, c string")
    assert [tuple(r) for r in tables.numeric_profile(rows, ["a", "b", "c"]).collect()] == [("a", 3, 2.0, 1234.5)]
    nodes = spark.createDataFrame([(1, None), (2, "not json"), (3, '{"k": 2, "outputs": ["o"]}')], "node_id int, attributes string")
    assert {(r.node_id, r.priority, len(r.outputs)) for r in registry.capabilities(nodes).collect()} == {(1, 0, 0), (2, 0, 0), (3, 2, 1)}
    parts = spark.createDataFrame([("x", None, " "), ("x", "y", "z")], "a string, b string, c string").select(tables.embedding_text(["a", "b", "c"]).alias("t"))
    assert [r.t for r in parts.orderBy(F.length("t")).collect()] == ["x", "x · y · z"]
