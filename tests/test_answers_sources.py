"""Edge cases of answers, versions and file sources on a few rows."""

import pytest

from granary.operators import answers as A
from granary.operators import registry as R
from granary.sources import files

ANSWERS = "answer_id long, confidence double, calibrated boolean, passed boolean, authority double"


def test_conflicts_of_numbers_words_and_nulls(spark):
    rows = [(1, 1, "cap", "EUR 100"), (1, 2, "cap", "101"), (1, 3, "cap", "150"), (1, 1, "verdict", "valid"), (1, 2, "verdict", " Valid "), (1, 3, "note", "yes"), (1, 4, "note", "no"), (1, 5, "note", "maybe"), (1, 6, "cap", None), (2, 7, "cap", "9")]
    got = A.conflicts(spark.createDataFrame(rows, "request_id long, answer_id long, field string, value string")).collect()
    assert sorted((r.field, r.first, r.second, r.kind) for r in got) == [("cap", 1, 3, "numeric_disagreement"), ("cap", 2, 3, "numeric_disagreement"), ("note", 3, 4, "verdict_disagreement")]


def test_strategies_in_order_and_open_pairs(spark):
    rows = [(1, 0.9, True, False, 1.0), (2, 0.2, True, True, 0.0), (3, 0.9, True, True, 0.0), (4, 0.5, False, True, 1.0), (5, 0.9, False, True, 0.5), (6, None, True, True, 0.5)]
    pairs = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (1, 4, 5), (1, 5, 6)], "request_id long, first long, second long")
    got = {(r.first, r.second): (r.strategy, r.winner) for r in A.resolutions(pairs, spark.createDataFrame(rows, ANSWERS)).collect()}
    assert got == {(1, 2): ("verifier", 2), (3, 4): ("confidence", 3), (4, 5): ("authority", 4), (5, 6): (None, None)}


def test_rules_on_sums_and_missing_fields(spark):
    rows = [(1, {"total": "10", "a": "4", "b": "6"}), (2, {"total": "11", "a": "4", "b": "6"}), (3, {"total": "x"}), (4, None)]
    data = spark.createDataFrame(rows, "id long, structured map<string,string>").selectExpr("*", "1.0D as confidence", "cast(null as string) as content", "0 as citations")
    rules = [{"id": "sum", "type": "numeric_consistency", "fields": ["total", "a", "b"], "tolerance": 0.01}, {"id": "has", "type": "required_fields", "fields": ["a"]}]
    assert {r.id: r.violated for r in A.verified(data, rules).collect()} == {1: [], 2: ["sum"], 3: ["has"], 4: ["has"]}


def test_promotion_needs_the_metric(spark):
    rows = [("m", 1, "active", 1, 0.8), ("m", 2, "candidate", 2, 0.7), ("n", 1, "active", 1, 0.8), ("n", 2, "candidate", 2, 0.8), ("o", 1, "active", 1, 0.1), ("o", 2, "candidate", 2, None)]
    got = R.promoted(spark.createDataFrame(rows, "model_id string, version long, status string, created_at long, accuracy double")).collect()
    assert {(r.model_id, r.version): r.status for r in got} == {("m", 1): "active", ("m", 2): "candidate", ("n", 1): "retired", ("n", 2): "active", ("o", 1): "active", ("o", 2): "candidate"}


def test_eval_cases(spark, tmp_path):
    (tmp_path / "legal.jsonl").write_text('# note\n\n{"id": "a", "question": "q?"}\n{"question": "r?", "domain": "risk", "weight": 2}\n')
    got = {r.question: r for r in files.read_eval_jsonl(spark, str(tmp_path / "legal.jsonl")).collect()}
    assert (got["q?"].id, got["q?"].domain, got["q?"].weight) == ("a", "legal", 1.0)
    assert got["r?"].id.startswith("legal-") and got["r?"].domain == "risk"
    (tmp_path / "bad.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception, match="malformed case"):
        files.read_eval_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_corpus_scan(spark, tmp_path):
    for name in ("legal/vendor-risk_list.md", "legal/deep/b.txt", "root.md", "legal/page.html"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("ção")
    got = sorted(files.scan_corpus(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == [("legal/deep/b.txt", "legal", "B", "ção"), ("legal/vendor-risk_list.md", "legal", "Vendor Risk List", "ção")]


def test_delimited(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a;b\n1;"x;y"\n\n2\n')
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "t.csv")).collect()] == [("1", "x;y"), ("2", None)]
