"""Arbitration, composed replies, extraction by schema, and tolerant JSON."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from granary.functions import tolerant_json
from granary.operators import arbitration, extraction

ANSWERS = "request_id long, answer_id long, expert_id string, domain string, content string, error string, ok boolean, confidence double, calibrated boolean, passed boolean, failures string, authority double"


def answer(request, n, confidence=0.5, *, passed=True, authority=0.5, ok=True, error=None, calibrated=True, content=None, expert=None):
    return (request, n, f"e{n}" if expert is None else expert, f"d{n}", content or f" answer {n} ", error, ok, confidence, calibrated, passed, "" if passed else "rule", authority)


def arbitrated(spark, answers, fields, order=("field", "first", "second")):
    a, f = spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(fields, "request_id long, answer_id long, field string, value string")
    outcomes = arbitration.settled(arbitration.all_conflicts(a, f), a)
    return a, arbitration.contributions(a, arbitration.superseded(outcomes, order)), outcomes


def test_an_answer_can_win_one_conflict_and_lose_the_next_and_the_order_decides_by_whom(spark):
    answers = [answer(1, 1, 0.9), answer(1, 2, 0.7), answer(1, 3, 0.4, authority=0.9)]
    fields = [(1, 1, "status", "a"), (1, 2, "status", "b"), (1, 3, "status", "b"), (1, 2, "amount", "1"), (1, 3, "amount", "2")]
    by = {}
    for order in (("field", "first", "second"), ("-", "first", "second")):
        _, parts, outcomes = arbitrated(spark, answers, fields) if order[0] == "field" else (None, None, None)
        if parts is None:
            a, _, outcomes = arbitrated(spark, answers, fields)
            outcomes = outcomes.withColumn("-", F.when(F.col("field") == "amount", 9).otherwise(0))
            parts = arbitration.contributions(a, arbitration.superseded(outcomes, order))
        by[order[0]] = {r.answer_id: (r.accepted, r.superseded_by) for r in parts.collect()}
    # 2 wins the amount against 3 and loses the status to 1; 3 loses both, so the last one settled is its reason.
    assert by["field"] == {1: (True, ""), 2: (False, "e1"), 3: (False, "e1")}
    assert by["-"] == {1: (True, ""), 2: (False, "e1"), 3: (False, "e2")}


def test_strategies_in_their_order(spark):
    pairs = {1: ((0.9, {"passed": False}), (0.1, {}), "verifier", 2), 2: ((0.9, {}), (0.7, {}), "confidence", 1), 3: ((0.9, {"calibrated": False}), (0.7, {"authority": 0.9}), "authority", 2), 4: ((0.5, {}), (0.5, {}), None, None), 5: ((None, {"authority": None}), (0.1, {}), "authority", 2)}
    answers = [answer(r, 10 * r + i, side[0], **side[1]) for r, p in pairs.items() for i, side in enumerate(p[:2])]
    fields = [(r, 10 * r + i, "verdict", f"v{i}") for r in pairs for i in range(2)] + [(1, 10, "note", "x"), (1, 11, "note", "y"), (2, 20, "reasoning", "1"), (2, 21, "reasoning", "2")]
    _, _, outcomes = arbitrated(spark, answers, fields)
    assert {r.request_id: (r.strategy, r.winner) for r in outcomes.collect()} == {r: p[2:] for r, p in pairs.items()}


def test_replies(spark):
    answers = [answer(1, 1, 0.5, content=" only \n"), answer(2, 2, ok=False, error="late"), answer(2, 3, ok=False), answer(2, 4, ok=False, error="lost"), answer(3, 5, 0.4), answer(3, 6, 0.9, expert=""), answer(4, 7, 0.5), answer(4, 8, 0.5)]
    fields = [(4, 7, "status", "it's"), (4, 8, "status", "no\nway")]
    a, parts, outcomes = arbitrated(spark, answers, fields)
    got = {r.request_id: r for r in arbitration.composed(a, parts, outcomes).collect()}
    assert (got[1].reply, got[1].method, got[1].experts, got[1].confidence) == ("only", "single_expert", ["e1"], 0.5)
    assert (got[2].reply, got[2].method, got[2].confidence) == (arbitration.FAILED_REPLY + " (late; lost).", "none", 0.0)
    assert got[3].reply == "**orchestrator** (d6)\nanswer 6\n\n**e5** (d5)\nanswer 5" and got[3].method == "deterministic"
    assert got[4].reply.endswith("""**Unresolved disagreements**\n- [verdict_disagreement] status: e7 says "it's"; e8 says 'no\\nway'""")
    assert got[4].confidence == 0.4
    lines = [r.line for r in arbitration.audit_lines(parts, outcomes).where("request_id = 4").orderBy("place").collect()]
    assert lines[0] == "e7 (d7) contributed with confidence 0.50, weight 0.25" and lines[2].startswith("UNRESOLVED — [verdict")
    empty = arbitrated(spark, [], [])
    assert arbitration.composed(*empty).collect() == [] and arbitration.audit_lines(*empty[1:]).collect() == []


def test_two_decimals_are_those_of_the_binary_value(spark):
    rng = random.Random(3)
    xs = [0.015, 0.025, 0.125, 0.375, 0.005, 1.0, 0.0, 0.995, 0.285] + [round(rng.random(), 3) for _ in range(500)] + [rng.random() for _ in range(200)]
    assert [r.s for r in spark.createDataFrame([(x,) for x in xs], "x double").select(arbitration.two(F.col("x")).alias("s")).collect()] == [f"{x:.2f}" for x in xs]


def test_every_kind_of_field(spark):
    schema = {"properties": {"a": {"type": "string"}, "b": {"enum": ["low", "high", "High"]}, "c": {"type": "number"}, "d": {"type": "integer"}, "e": {"type": "boolean"}, "f": {"type": "array", "items": {"type": "integer"}}, "g": {"type": "object", "properties": {"h": {"enum": [1, 2]}, "Score": {}}}, "i": {"type": "unheard of"}}}
    rows = spark.createDataFrame([(1, ["The high bar was 1,200.5 or more...", "A HIGH and low one has 7"], 0.7), (2, [], 0.1), (3, None, 0.1)], "id long, s array<string>, c double")
    flat = {r.id: r.x for r in rows.select("id", extraction.structured(schema, F.col("s"), F.col("c")).alias("x")).collect()}
    assert flat[1].a == "The high bar was 1,200.5 or more. A HIGH and low one has 7." == flat[1].i
    assert (flat[1].b, flat[1].c, flat[1].d, flat[1].e, len(flat[1].f), flat[1].g) == ("high", 1200.5, 1200, True, 2, {})
    assert flat[2] == flat[3] and (flat[2].a, flat[2].b, flat[2].c, flat[2].d, flat[2].e, flat[2].f) == (extraction.NOTHING_FOUND, "low", 0.0, 0, False, [])
    deep = rows.select(extraction.structured(schema, F.col("s"), F.col("c"), deep=True).alias("x")).first().x
    assert (deep.f, deep.g.h, deep.g.Score) == ([1200, 7], 1, 0.7)
    plain = rows.select(extraction.structured(None, F.col("s"), F.col("c")).alias("x")).first().x
    assert set(plain.asDict()) == {"answer", "confidence"}


def test_answer_entities(spark):
    answers = spark.createDataFrame([(1, ["Order", "Part"], 0.8), (2, [], 0.3)], "request_id long, produced array<string>, confidence double")
    chunks = spark.createDataFrame([(1, 1, 0.91234, ["Part", "Nation"]), (1, 2, 0.5, ["Nation", "Region"]), (1, 6, 0.4, ["Late"])], "request_id long, rank int, score double, entities array<string>")
    got = {r.request_id: [tuple(e) for e in r.entities] for r in extraction.answer_entities(answers, chunks).collect()}
    assert got == {1: [("Order", 0.8), ("Part", 0.8), ("Nation", 0.9123), ("Region", 0.5)], 2: []}


def plain_json(text):
    """What extraction gives, by the standard parser."""
    fence = re.search(r"```(?:json|JSON)?\s*(.*?)```", text, re.DOTALL)
    candidate = (fence[1] if fence else text).strip()

    def region(left, right):
        depth, quoted, skip, start = 0, False, False, candidate.find(left)
        for i, c in enumerate(candidate[max(start, 0) :], max(start, 0)):
            if start < 0:
                return None
            if quoted:
                skip, quoted = (False, True) if skip else (c == "\\", c != '"')
            elif c == '"':
                quoted = True
            elif c in (left, right):
                depth += 1 if c == left else -1
                if not depth:
                    return candidate[start : i + 1]
        return None

    def only(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(name)

    for part in (candidate, region("{", "}"), region("[", "]")):
        for attempt in (part, part and re.sub(r",\s*([}\]])", r"\1", part)):
            try:
                if attempt is not None:
                    return json.loads(attempt, object_pairs_hook=only, parse_constant=refuse)
            except ValueError:
                pass
    return None


def test_json_out_of_damaged_texts(spark):
    rng = random.Random(5)

    def value(depth=0):
        kind = rng.randrange(6 if depth < 3 else 4)
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        if kind == 5:
            return {f"k{i}": value(depth + 1) for i in range(rng.randint(0, 3))}
        return [rng.randint(-9, 9), rng.choice([True, False, None]), round(rng.random(), 2), rng.choice(['a "b" {c}', "[]}", "\\", "é, }", "```", "x\ny", ""])][kind]

    texts = []
    for _ in range(400):
        t = json.dumps(value(), ensure_ascii=False)
        for damage in rng.sample(range(8), rng.randint(0, 3)):
            t = [lambda t: f"```json\n{t}\n```", lambda t: re.sub(r"([}\]])$", r" , \1", t), lambda t: f"Here: {t} ok", lambda t: t[: rng.randint(0, len(t))], lambda t: t.replace("]", ",]"), lambda t: f"{{ no {t}", lambda t: f"[{t}", lambda t: t + t][damage](t)
        texts.append(t)
    texts += ["", " ", "null", "12 apples", "NaN", '{"a": NaN} [1]', "{" * 500, '"x', '{"a":1,"a":2}', "01", "\\{\\\"}\\"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", tolerant_json.extracted(F.col("t")).alias("v"))
    got = {r.i: (r.k, r.v) for r in df.select("i", tolerant_json.kind(F.col("v")).alias("k"), F.to_json("v").alias("v")).collect()}
    for i, t in enumerate(texts):
        want = plain_json(t)
        kind, text = got[i]
        assert kind in ({None, "null"} if want is None else {{dict: "object", list: "array", str: "string", bool: "boolean"}.get(type(want), "number")}), t
        if want is not None:
            assert json.loads(text) == (pytest.approx(want) if isinstance(want, float) else want), t
    objects = spark.createDataFrame([("[1]",), ('x {"a": 1}',)], "t string").select(F.to_json(tolerant_json.extracted_object(F.col("t"))).alias("v")).collect()
    assert [r.v for r in objects] == [None, '{"a":1}']


def test_numbers_are_read_once_a_value_and_not_for_each_pair(spark):
    a, f = spark.createDataFrame([answer(1, 1), answer(1, 2)], ANSWERS), spark.createDataFrame([(1, 1, "amount", "R$ 1"), (1, 2, "amount", "2")], "request_id long, answer_id long, field string, value string")
    found = arbitration.all_conflicts(a, f)
    above = found._jdf.queryExecution().executedPlan().toString().split("Join", 1)[0]
    assert "regexp" not in above.lower() and "rlike" not in above.lower() and found.first().kind == "numeric_disagreement"
