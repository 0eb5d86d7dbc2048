"""Uploads that replace, governed walks, routing by words and by vectors, whole answers, rollbacks and run lists."""

from pyspark.sql import functions as F

from granary.operators import answering, policy, registry, retrieval, routing, runs, uploads
from granary.sources.scratch import shared_dir

ROWS = "filename string, sheet string, row long, headers array<string>, cells array<string>"


def sheet(spark, names, file="sales.csv", tab="Plan", headers=("name", "amount")):
    return spark.createDataFrame([(file, tab, i, list(headers), [n, a]) for i, (n, a) in enumerate(names, 1)], ROWS)


def test_an_upload_replaces_the_one_before_and_an_unchanged_one_does_nothing(spark):
    base = shared_dir(spark)
    first = sheet(spark, [(f"n{i}", f"1.00{i % 10},5") for i in range(30)])
    other = sheet(spark, [("x", "1")], tab="Other")
    both = first.unionByName(other)
    assert {r.uri: r.action for r in uploads.ingest(both, base, domain="d").collect()} == {"upload://sales.csv#Plan": "insert", "upload://sales.csv#Other": "insert"}
    before = sorted(map(str, uploads.live_chunks(spark, base).collect()))
    assert {r.action for r in uploads.ingest(both.repartition(3), base, domain="d").collect()} == {"unchanged"}
    assert sorted(map(str, uploads.live_chunks(spark, base).collect())) == before and uploads.vacuum(spark, base) == 0
    edited = sheet(spark, [(f"n{i}", "7") for i in range(13)]).unionByName(other)
    assert {r.uri: r.action for r in uploads.ingest(edited, base, domain="d").collect()} == {"upload://sales.csv#Plan": "replace", "upload://sales.csv#Other": "unchanged"}
    now = uploads.live_chunks(spark, base).where("uri like '%Plan'").orderBy("ordinal").collect()
    assert [r.kind for r in now] == ["table_schema", "table_rows", "table_rows"] and not any("n29" in r.text for r in now)
    assert now[2].text == "Plan — registros 13 a 13 de 13\nColunas: name, amount\n\n[13] name: n12; amount: 7"
    docs = {r.sheet: r for r in uploads.stored(spark, base).collect()}
    assert len(docs) == 2 and (docs["Plan"].title, docs["Plan"].rows, docs["Plan"].columns, docs["Plan"].chunks) == ("sales · Plan", 13, ["name", "amount"], 3)
    assert uploads.vacuum(spark, base) == 1 and uploads.live_chunks(spark, base).count() == 5


def test_an_upload_that_failed_before_its_documents_is_not_seen(spark):
    base = shared_dir(spark)
    uploads.ingest(sheet(spark, [("a", "1")]), base, domain="d")
    old = [r.text for r in uploads.live_chunks(spark, base).orderBy("ordinal").collect()]
    _, chunks = uploads.rendered(sheet(spark, [("b", "2")]), "d")
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("uri", "version").parquet(f"{base}/chunks")
    assert [r.text for r in uploads.live_chunks(spark, base).orderBy("ordinal").collect()] == old
    assert uploads.ingest(sheet(spark, [("b", "2")]), base, domain="d").first().action == "replace"
    assert "b" in uploads.live_chunks(spark, base).where("ordinal = 1").first().text


def test_descriptions_of_sheets(spark):
    rows = sheet(spark, [("a", "1.234,50"), ("", "2"), ("b", "x"), ("", "")], file="dir/one.two.csv")
    documents, chunks = uploads.rendered(rows, "d")
    text = chunks.where("ordinal = 0").first().text
    assert text == "# Plan — estrutura dos dados\n\nOrigem: dir/one.two.csv\nRegistros: 4\nColunas (2): name, amount\n\nColunas numéricas:\n- amount: numérica, de 2 a 1234.5 (2 valores)\n\nPrimeiros registros como amostra:\n- name: a; amount: 1.234,50\n- amount: 2\n- name: b; amount: x"
    assert chunks.where("ordinal = 1").first().text.endswith("\n[3] name: b; amount: x") and documents.first().title == "one.two"
    none = uploads.rendered(rows.limit(0), "d")
    assert none[0].collect() == none[1].collect() == []


def test_denials_are_told_until_enough_is_allowed(spark):
    found = spark.createDataFrame([(q, i, 1.0 - i / 10, i) for q in (1, 2) for i in range(1, 7)], "query_id long, id long, score double, rank int")
    judged = spark.createDataFrame([(1, "deny", "p"), (2, "allow", "a"), (3, "deny", "p"), (4, "require_approval", "r"), (5, "deny", "p")], "id long, effect string, policy_id string")
    allowed, denied = retrieval.governed(found, judged, 2)
    assert sorted((r.query_id, r.id, r.rank, r.effect) for r in allowed.collect()) == [(q, i, n, e) for q in (1, 2) for i, n, e in ((2, 1, "allow"), (4, 2, "require_approval"))]
    assert sorted((r.query_id, r.id, r.policy_id) for r in denied.collect()) == [(q, i, "p") for q in (1, 2) for i in (1, 3)]
    allowed, denied = retrieval.governed(found, judged, 9)
    assert allowed.count() == 4 and {(r.id, r.policy_id) for r in denied.where("query_id = 1").collect()} == {(1, "p"), (3, "p"), (5, "p"), (6, "")}


def test_routing_beyond_the_broadcast_finds_the_same_matches(spark):
    caps = [(f"cap_{i}", f"e{i}", "d", [f"word{i}", "shared"], [f"example{i} here now"], f"about thing{i}", [f"Entity{i % 3}"]) for i in range(12)]
    asked = spark.createDataFrame([(1, "tell word3 and example4", ["Entity1"]), (2, "nothing known", []), (3, None, []), (4, "shared matters", [])], "request_id long, text string, entities array<string>")
    every = {(r.request_id, r.capability_id): r.score for r in routing.matches(asked, caps).collect()}
    some = {(r.request_id, r.capability_id): r.score for r in routing.matches(asked, caps, most=3).collect()}
    assert len(every) == 48 and some == {k: v for k, v in every.items() if v > 0} and len(some) >= 12
    near = {r.capability_id: r for r in routing.matches(asked, caps, embedded=True).where("request_id = 1").collect()}
    assert near["cap_3"].semantic > near["cap_7"].semantic >= 0 and all(r.semantic is not None for r in near.values())


def test_escalation_is_by_the_plan(spark):
    requests = spark.createDataFrame([(i,) for i in range(1, 5)], "request_id long")
    steps = spark.createDataFrame([(1, 0.9, True, 0.5), (1, 0.1, True, 0.5), (2, 0.9, True, 0.5), (3, 0.9, False, 0.5)], "request_id long, confidence double, matched boolean, classification double")
    got = {r.request_id: (r.subtasks, r.confidence, r.reason) for r in routing.escalation(requests, steps).collect()}
    # .6 * .1 + .4 * .5 = .26, and .35 * .5 of what is missing: the best step alone would not have escalated.
    assert got[1] == (2, 0.3895, "routing confidence 0.39 is below the 0.55 threshold")
    assert got[2][2] is None and got[3][2] == "no subtask matched a declared capability" and got[4] == (0, 0.0, "no capability in the graph covers this request")


def test_rollback_takes_the_version_created_last(spark):
    rows = [("m", "1", "retired", 3), ("m", "2", "retired", 1), ("m", "3", "active", 2), ("n", "1", "active", 1), ("o", "1", "candidate", 1), ("o", "2", "active", 2)]
    versions = spark.createDataFrame(rows, "model_id string, version string, status string, created_at int")
    wanted = spark.createDataFrame([("m", None), ("n", None), ("o", "1"), ("p", None), ("q", "9")], "model_id string, version string")
    now, bad = registry.rolled_back(versions, wanted)
    assert {(r.model_id, r.version): r.status for r in now.collect()} == {("m", "1"): "active", ("m", "2"): "retired", ("m", "3"): "retired", ("n", "1"): "active", ("o", "1"): "active", ("o", "2"): "retired"}
    assert {r.model_id: r.problem for r in bad.collect()} == {"n": "no retired version", "p": "no version history", "q": "no version history"}


def test_newest_runs_come_before_their_cases(spark):
    all_ = spark.createDataFrame([(i, "default" if i % 2 else "other", "a", i // 4) for i in range(10)], "run_id long, tenant string, arm string, created_at int")
    cases = spark.createDataFrame([(i, f"c{j}", j) for i in range(8) for j in (2, 1)], "run_id long, case_id string, score int")
    rows = runs.newest_runs(all_, cases, limit=3).collect()
    assert sorted((r.run_id, r.place or 0, r.case_id or "") for r in rows) == [(5, 1, "c1"), (5, 2, "c2"), (7, 1, "c1"), (7, 2, "c2"), (9, 0, "")]


def test_answers_equal_their_parts_and_skipped_ones_have_none(spark):
    requests = spark.createDataFrame([(1, "e1", "What does clause seven say about payment terms"), (2, "e2", "payment terms"), (3, "e1", "zzz qqq"), (4, "e1", None)], "request_id long, expert_id string, text string")
    chunks = spark.createDataFrame([(1, "Clause seven says that payment terms are thirty days. The Supplier delivers.", "public"), (2, "Payment terms of clause nine are secret and restricted by law.", "restricted"), (3, "Nothing of that kind is found here at all.", "public")], "id long, text string, sensitivity string")
    fits = spark.createDataFrame([("e1", 2.0, 0.0, True)], "expert_id string, slope double, bias double, fitted boolean")
    out = answering.answered(requests, chunks, gates=[policy.Policy("g", "deny", subjects=("expert:e2",))], readers=[policy.Policy("r", "deny", resources=("sensitivity:restricted",))], schema={"properties": {"finding": {"type": "string"}, "confidence": {"type": "number"}}}, calibrations=fits, dictionary=["Supplier"], produced=["Term"])
    got = {r.request_id: r for r in out.collect()}
    assert got[1].content == "Clause seven says that payment terms are thirty days." and got[1].citations[0] == 1 and 2 not in got[1].citations
    assert got[1].calibrated and [e.name for e in got[1].entities] == ["Term", "Supplier"]
    assert (got[2].status, got[2].confidence, got[2].content, got[2].citations, got[2].entities) == ("skipped", 0.0, "", [], [])
    assert got[3].raw_confidence == got[4].raw_confidence == 0.1 and got[4].status == "ok" and got[3].content.startswith("No supporting passage")
    assert answering.answered(requests.limit(0), chunks, gates=[], readers=[], schema={}, calibrations=fits, dictionary=["Supplier"], produced=[]).where(F.lit(True)).collect() == []
