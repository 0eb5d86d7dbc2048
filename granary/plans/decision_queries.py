"""Queries of arbitration, composed replies, extraction and tolerant JSON; importing this module adds them to those of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text, tolerant_json
from granary.operators import answering, arbitration, extraction, policy
from granary.operators import answers as A
from granary.sources.scratch import dealt

from . import fixtures as fx
from .fixtures import table
from .queries import _ENTITY_SQL, _GOVERNED, DICTIONARY, LONG_TOKENS, READERS, query, sql_list
from .route_queries import _SENTENCES, ASKED


def _answers(spark, d):
    """Four answers of each request: verified, some of them in error."""
    e = dealt(table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", F.floor(F.col("event_id") / 4).alias("request_id")), 50_000, "request_id")
    broken = F.col("event_id") % 13 == 0
    rows = e.select(
        "request_id", F.col("event_id").alias("answer_id"), F.concat(F.lit("e"), F.col("user_id") % 5).alias("expert_id"), F.concat(F.lit("d"), F.col("user_id") % 3).alias("domain"),
        F.concat(F.lit(" "), F.col("event_type"), F.lit(" it is\n")).alias("content"), F.when(broken, F.concat(F.lit("timeout "), F.col("event_id"))).alias("error"), (~broken).alias("ok"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"), (F.col("event_id") % 3 != 0).alias("calibrated"), ((F.col("user_id") % 5) / 4).alias("authority"), (F.col("event_id") % 2).cast("int").alias("citations"),
        F.create_map(F.lit("amount"), (F.floor(F.col("value") / 50) * 50).cast("string"), F.lit("status"), F.col("event_type"), F.lit("note"), F.concat(F.lit("n"), F.col("event_id"))).alias("structured"),
    )
    rules = [{"id": "low", "type": "numeric_range", "fields": ["amount"], "minimum": 50}, {"id": "cited", "type": "requires_citation", "severity": "warning"}]
    return A.verified(rows, rules).withColumn("failures", F.array_join("violated", ", "))


def _fields(answers):
    return answers.select("request_id", "answer_id", F.explode("structured").alias("field", "value"))


def _settled(spark, d):
    answers = _answers(spark, d)
    return answers, arbitration.settled(arbitration.all_conflicts(answers, _fields(answers)), answers)


def _parts(spark, d):
    answers, outcomes = _settled(spark, d)
    return answers, arbitration.contributions(answers, arbitration.superseded(outcomes)), outcomes


# The recursive term goes through a request's conflicts one by one and carries who is superseded by whom, as the rule says it.
_ARBITRATION = """
g AS (SELECT event_id // 4 AS request_id, event_id AS answer_id, 'e' || (user_id % 5) AS expert_id, 'd' || (user_id % 3) AS domain, event_type AS content, CASE WHEN event_id % 13 = 0 THEN 'timeout ' || event_id END AS error, event_id % 13 <> 0 AS ok,
  (props->>'$.k')::DOUBLE / 100 AS confidence, event_id % 3 <> 0 AS calibrated, (user_id % 5) / 4::DOUBLE AS authority, floor(value / 50)::BIGINT * 50 AS amount, event_type AS status, floor(value / 50) * 50 >= 50 AS passed,
  concat_ws(', ', CASE WHEN floor(value / 50) * 50 < 50 THEN 'low' END, CASE WHEN event_id % 2 = 0 THEN 'cited' END) AS failures FROM events),
f AS (SELECT request_id, answer_id, expert_id, domain, confidence, calibrated, passed, failures, authority, 'amount' AS field, amount::VARCHAR AS value FROM g WHERE ok
  UNION ALL SELECT request_id, answer_id, expert_id, domain, confidence, calibrated, passed, failures, authority, 'status', status FROM g WHERE ok),
c AS (SELECT x.request_id, x.field, x.answer_id AS first, y.answer_id AS second, CASE x.field WHEN 'amount' THEN 'numeric_disagreement' ELSE 'verdict_disagreement' END AS kind, x.value AS v1, y.value AS v2, x.expert_id AS e1, y.expert_id AS e2, x.domain AS d1,
  x.confidence AS c1, y.confidence AS c2, x.calibrated AS k1, y.calibrated AS k2, x.passed AS p1, y.passed AS p2, x.failures AS f1, y.failures AS f2, x.authority AS a1, y.authority AS a2, row_number() OVER (PARTITION BY x.request_id ORDER BY x.field, x.answer_id, y.answer_id) AS step
  FROM f x JOIN f y ON x.request_id = y.request_id AND x.field = y.field AND x.answer_id < y.answer_id
  WHERE CASE x.field WHEN 'amount' THEN abs(x.value::DOUBLE - y.value::DOUBLE) / greatest(x.value::DOUBLE, y.value::DOUBLE, 1e-9) > 0.02 ELSE x.value <> y.value END),
w AS (SELECT *, CASE WHEN p1 AND NOT p2 THEN 1 WHEN p2 AND NOT p1 THEN 2 END AS v, CASE WHEN round(abs(c1 - c2), 9) >= 0.15 AND CASE WHEN c1 >= c2 THEN k1 ELSE k2 END THEN CASE WHEN c1 >= c2 THEN 1 ELSE 2 END END AS s, CASE WHEN abs(a1 - a2) >= 0.1 THEN CASE WHEN a1 >= a2 THEN 1 ELSE 2 END END AS o FROM c),
r AS (SELECT *, coalesce(v, s, o) AS winner, CASE WHEN v IS NOT NULL THEN 'verifier' WHEN s IS NOT NULL THEN 'confidence' WHEN o IS NOT NULL THEN 'authority' END AS strategy,
  CASE WHEN v IS NOT NULL THEN 'the other answer failed domain verification (' || CASE v WHEN 1 THEN f2 ELSE f1 END || ')'
       WHEN s IS NOT NULL THEN 'calibrated confidence ' || printf('%.2f', greatest(c1, c2)) || ' exceeds ' || printf('%.2f', least(c1, c2)) || ' by ' || printf('%.2f', round(abs(c1 - c2), 9)) || ' (threshold 0.15)'
       WHEN o IS NOT NULL THEN '''' || CASE WHEN a1 >= a2 THEN e1 ELSE e2 END || ''' holds authority ' || printf('%.2f', greatest(a1, a2)) || ' over domain ''' || d1 || ''' against ' || printf('%.2f', least(a1, a2)) END AS reason,
  '[' || kind || '] ' || field || ': ' || CASE WHEN e1 = e2 THEN '' ELSE e1 || ' says ''' || v1 || '''; ' END || e2 || ' says ''' || v2 || '''' AS summary FROM w),
fold(request_id, step, lost) AS (SELECT DISTINCT request_id, 0::BIGINT, MAP {}::MAP(BIGINT, VARCHAR[]) FROM r
  UNION ALL SELECT fold.request_id, r.step, CASE WHEN winner IS NULL THEN lost ELSE map_concat(lost, MAP([CASE winner WHEN 1 THEN second ELSE first END], [[CASE winner WHEN 1 THEN e1 ELSE e2 END, strategy || ': ' || reason]])) END FROM fold JOIN r ON r.request_id = fold.request_id AND r.step = fold.step + 1),
done AS (SELECT request_id, arg_max(lost, step) AS lost FROM fold GROUP BY 1),
k AS (SELECT g.*, lost[answer_id] IS NULL AS accepted, round(confidence * authority * CASE WHEN passed THEN 1 ELSE 0.4::DOUBLE END, 6) AS weight, coalesce(lost[answer_id][1], '') AS superseded_by, coalesce(lost[answer_id][2], '') AS why FROM g LEFT JOIN done USING (request_id) WHERE ok),
line AS (SELECT *, CASE winner WHEN 1 THEN e1 ELSE e2 END || ' prevailed over ' || CASE winner WHEN 1 THEN e2 ELSE e1 END || ' on ''' || field || ''' via ' || strategy || ' — ' || reason AS text FROM r),
said AS (SELECT request_id, list(text ORDER BY step) FILTER (winner IS NOT NULL) AS resolved, list(summary ORDER BY step) FILTER (winner IS NULL) AS unresolved FROM line GROUP BY 1)"""


@query(f"WITH RECURSIVE {_ARBITRATION} SELECT request_id, answer_id, accepted, weight, superseded_by, why AS reason FROM k")
def arb_full(spark, d):
    return _parts(spark, d)[1].select("request_id", "answer_id", "accepted", "weight", "superseded_by", "reason")


@query(f"""WITH RECURSIVE {_ARBITRATION},
a AS (SELECT request_id, count(*) AS n, string_agg('**' || expert_id || '** (' || domain || ')' || chr(10) || content || ' it is', chr(10) || chr(10) ORDER BY weight DESC, answer_id) AS body, string_agg(expert_id, ',' ORDER BY answer_id) AS experts,
  arg_min(content || ' it is', answer_id) AS sole, arg_min(confidence, answer_id) AS own, sum(greatest(weight, 1e-6) * confidence) / sum(greatest(weight, 1e-6)) AS mean FROM k WHERE accepted GROUP BY 1),
b AS (SELECT request_id, list(error ORDER BY answer_id) FILTER (error IS NOT NULL) AS errors FROM g GROUP BY 1),
m AS (SELECT *, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 AND resolved IS NULL THEN 'single_expert' ELSE 'deterministic' END AS method FROM b LEFT JOIN a USING (request_id) LEFT JOIN said USING (request_id))
SELECT request_id, method, coalesce(experts, '') AS experts,
  CASE method WHEN 'none' THEN 0 WHEN 'single_expert' THEN own ELSE round(mean * greatest(0.5, 1 - 0.2 * coalesce(len(unresolved), 0)), 4) END::DOUBLE AS confidence,
  CASE method WHEN 'none' THEN 'The federation could not produce an answer: no specialist returned a usable result' || coalesce(' (' || array_to_string(errors[1:3], '; ') || ')', '') || '.' WHEN 'single_expert' THEN sole
    ELSE body || coalesce(chr(10) || chr(10) || '**Arbitration**' || chr(10) || '- ' || array_to_string(resolved, chr(10) || '- '), '') || coalesce(chr(10) || chr(10) || '**Unresolved disagreements**' || chr(10) || '- ' || array_to_string(unresolved, chr(10) || '- '), '') END AS reply
FROM m""")
def syn_compose(spark, d):
    answers, parts, outcomes = _parts(spark, d)
    return arbitration.composed(answers, parts, outcomes).withColumn("experts", F.array_join("experts", ","))


@query(f"""WITH RECURSIVE {_ARBITRATION},
t AS (SELECT request_id, list(expert_id || ' (' || domain || ') contributed with confidence ' || printf('%.2f', confidence) || ', weight ' || printf('%.2f', weight) || CASE WHEN accepted THEN '' ELSE ' — superseded by ' || superseded_by || ': ' || why END ORDER BY accepted DESC, weight DESC, answer_id) AS told FROM k GROUP BY 1),
a AS (SELECT request_id, list_concat(list_concat(coalesce(told, []), coalesce(resolved, [])), list_transform(coalesce(unresolved, []), lambda x: 'UNRESOLVED — ' || x)) AS lines FROM t FULL JOIN said USING (request_id))
SELECT request_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS place FROM a""")
def syn_audit_lines(spark, d):
    _, parts, outcomes = _parts(spark, d)
    return arbitration.audit_lines(parts, outcomes)


# --- extraction ------------------------------------------------------------------------------------------------------

SCHEMA = {"properties": {
    "summary": {"type": "string"}, "language": {"type": "string", "enum": ["English", "tion", "der", "que"]}, "amount": {"type": "number"}, "count": {"type": "integer"}, "found": {"type": "boolean"},
    "quotes": {"type": "array"}, "details": {"type": "object"}, "Confidence": {"type": "number"},
}}

_RANKED = rf"""p AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, lower(substr(sentence, 1, 80)) ORDER BY pos) = 1),
r AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_×÷]{{3,}}')), {sql_list(ASKED)})) / 5 AS score FROM f),
e AS (SELECT doc_id, (list(sentence ORDER BY score DESC, pos))[1:3] AS s, count(*) AS found, max(score) AS top FROM r WHERE score > 0 GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(s, []) AS s, CASE WHEN found IS NULL THEN 0.1 ELSE round(least(0.95, 0.25::DOUBLE + 0.55::DOUBLE * top + 0.20::DOUBLE * least(found, 5) / 5), 4) END::DOUBLE AS confidence, lower(coalesce(array_to_string(s, ' '), '')) AS hay FROM documents LEFT JOIN e USING (doc_id)),
h AS (SELECT *, list_transform(['English', 'tion', 'der', 'que'], lambda c: (length(hay) - length(replace(hay, lower(c), ''))) // length(c)) AS hits, coalesce(try_cast(replace(regexp_extract(array_to_string(s, ' '), '-?[0-9][0-9.,]*'), ',', '') AS DOUBLE), 0) AS number FROM x)"""


@query(f"""WITH {_RANKED} SELECT doc_id, CASE WHEN len(s) = 0 THEN '{extraction.NOTHING_FOUND}' ELSE array_to_string(list_transform(s, lambda q: rtrim(q, '.') || '.'), ' ') END AS summary,
(['English', 'tion', 'der', 'que'])[list_position(hits, list_max(hits))] AS language, number AS amount, trunc(number)::BIGINT AS count, len(s) > 0 AS found, array_to_string(s, '|') AS quotes, 0 AS details, confidence AS "Confidence" FROM h""")
def extract_structured(spark, d):
    """Every document as the one text of a request: its best sentences, put into a schema with a field of each kind."""
    docs = table(spark, d, "documents")
    asked = F.array(*map(F.lit, ASKED))
    ranked = extraction.ranked_sentences(docs.select(F.col("doc_id").alias("request_id"), F.lit(0).alias("place"), asked.alias("tokens"), "text"))
    found = docs.select(F.col("doc_id").alias("request_id")).join(extraction.evidence(ranked), "request_id", "left")
    filled = found.select(F.col("request_id").alias("doc_id"), extraction.structured(SCHEMA, F.col("sentences"), F.coalesce("confidence", F.lit(0.1))).alias("s")).select("doc_id", "s.*")
    return filled.withColumn("quotes", F.array_join("quotes", "|")).withColumn("details", F.size("details"))


_DAMAGED = """t AS (SELECT doc_id, '{"doc":' || doc_id || ',"text":' || to_json(coalesce(text, '')) || ',"tags":["a","}"]}' AS j FROM documents),
m AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN j WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' || ' done' WHEN 2 THEN substr(j, 1, length(j) - 1) || ' , }' WHEN 3 THEN 'It is { as such: ' || j WHEN 4 THEN 'Here: ' || j || ' and {more}'
  WHEN 5 THEN 'list [' || doc_id || ', 2, ] end' WHEN 6 THEN substr(j, 1, length(j) - 1) ELSE 'nothing here' END AS raw FROM t)"""


@query(f"""WITH {_DAMAGED} SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 1, 2, 4) THEN 'object' WHEN doc_id % 8 = 5 THEN 'array' WHEN doc_id % 8 IN (3, 6) THEN 'array' END AS kind,
CASE WHEN doc_id % 8 IN (0, 1, 2, 4) THEN doc_id END AS doc, CASE WHEN doc_id % 8 IN (0, 1, 2, 4) THEN coalesce((SELECT text FROM documents x WHERE x.doc_id = m.doc_id), '') END AS text, CASE WHEN doc_id % 8 = 5 THEN doc_id WHEN doc_id % 8 IN (3, 6) THEN NULL END AS head FROM m""")
def json_extract(spark, d):
    """Every document's text as a string in JSON, wrapped and damaged in eight ways, and read back."""
    j = F.concat(F.lit('{"doc":'), F.col("doc_id"), F.lit(',"text":'), F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1), F.lit(',"tags":["a","}"]}'))
    cut = F.substring("j", 1, F.length("j") - 1)
    at = F.col("doc_id") % 8
    raw = (
        F.when(at == 0, F.col("j")).when(at == 1, F.concat(F.lit("Sure:\n```json\n"), "j", F.lit("\n``` done"))).when(at == 2, F.concat(cut, F.lit(" , }"))).when(at == 3, F.concat(F.lit("It is { as such: "), "j"))
        .when(at == 4, F.concat(F.lit("Here: "), "j", F.lit(" and {more}"))).when(at == 5, F.concat(F.lit("list ["), "doc_id", F.lit(", 2, ] end"))).when(at == 6, cut).otherwise("nothing here")
    )
    rows = table(spark, d, "documents").withColumn("j", j).select("doc_id", tolerant_json.extracted(raw).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return rows.select("doc_id", tolerant_json.kind(F.col("v")).alias("kind"), get("$.doc", "bigint").alias("doc"), get("$.text", "string").alias("text"), get("$[0]", "bigint").alias("head"))


# --- whole answers -----------------------------------------------------------------------------------------------------

GATES = [policy.Policy("g-closed", "deny", subjects=("expert:e3",))]
ANSWER_SCHEMA = {"properties": {"risk": {"enum": ["tion", "der", "que"]}, "summary": {"type": "string"}, "confidence": {"type": "number"}}}


def _answered(spark, d):
    e = F.concat(F.lit("e"), F.col("item_id") % 5)
    requests = table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), e.alias("expert_id"), "text")
    docs = fx.documents(spark, d).select(F.col("document_id").alias("id"), "text", "sensitivity", F.col("domain").alias("resource_domain"))
    fits = spark.createDataFrame([(f"e{i}", 1.5, -0.25, i > 0) for i in range(4)], "expert_id string, slope double, bias double, fitted boolean")
    return answering.answered(requests, docs, gates=GATES, readers=READERS, schema=ANSWER_SCHEMA, calibrations=fits, dictionary=DICTIONARY, produced=["Answer", "the"])


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '\S+'))"
_ANSWERED = _GOVERNED + rf""",
wanted AS (SELECT item_id AS request_id, 'e' || (item_id % 5) AS expert_id, item_id % 5 = 3 AS skip, list_filter(list_distinct({LONG_TOKENS}), lambda x: NOT list_contains({sql_list(text.EXTRACTIVE_STOP_WORDS)}, x)) AS tokens FROM benchmark),
six AS (SELECT query_id AS request_id, walked.id, score, before + 1 AS rank, text, {_ENTITY_SQL} AS names, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(floor({_WORDS} * 1.3::DOUBLE)::BIGINT + 1, length(text) // 4) END) OVER (PARTITION BY query_id ORDER BY rank) AS running
  FROM walked JOIN documents ON doc_id = walked.id WHERE effect <> 'deny' AND before < 6 AND query_id % 5 <> 3),
kept AS (SELECT * FROM six WHERE running <= 1500 OR rank = 1),
ps AS (SELECT request_id, rank, unnest(q) AS sentence, generate_subscripts(q, 1) AS pos FROM (SELECT request_id, rank, {_SENTENCES} AS q FROM kept)),
fs AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY request_id, lower(substr(sentence, 1, 80)) ORDER BY rank, pos) = 1),
rs AS (SELECT fs.*, len(list_intersect(list_distinct(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_×÷]{{3,}}')), tokens)) / len(tokens) AS hit FROM fs JOIN wanted USING (request_id) WHERE len(tokens) > 0),
best AS (SELECT request_id, (list(sentence ORDER BY hit DESC, rank, pos))[1:3] AS said, count(*) AS found, max(hit) AS top FROM rs WHERE hit > 0 GROUP BY 1),
cites AS (SELECT request_id, list(id ORDER BY rank) AS ids FROM kept GROUP BY 1),
whole AS (SELECT wanted.*, coalesce(said, []) AS said, lower(coalesce(array_to_string(said, ' '), '')) AS hay, ids, CASE WHEN skip THEN 0 WHEN found IS NULL THEN 0.1 ELSE round(least(0.95, 0.25::DOUBLE + 0.55::DOUBLE * top + 0.20::DOUBLE * least(found, 5) / 5), 4) END::DOUBLE AS raw_confidence,
  list_concat(['Answer', 'the'], coalesce(flatten((SELECT list(names ORDER BY rank) FROM kept WHERE kept.request_id = wanted.request_id AND rank <= 5)), [])) AS named FROM wanted LEFT JOIN best USING (request_id) LEFT JOIN cites USING (request_id))"""


@query(_ANSWERED + f""", hits AS (SELECT *, list_transform(['tion', 'der', 'que'], lambda c: (length(hay) - length(replace(hay, c, ''))) // length(c)) AS h, least(greatest(raw_confidence, 1e-6), 1 - 1e-6) AS p FROM whole)
SELECT request_id, CASE WHEN skip THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN skip THEN '' WHEN len(said) = 0 THEN '{extraction.NOTHING_FOUND}' ELSE array_to_string(list_transform(said, lambda q: rtrim(q, '.') || '.'), ' ') END AS content,
(['tion', 'der', 'que'])[list_position(h, list_max(h))] AS risk, raw_confidence, CASE WHEN skip THEN 0 WHEN expert_id IN ('e1', 'e2') THEN round(1 / (1 + exp(-(1.5::DOUBLE * ln(p / (1 - p)) - 0.25::DOUBLE))), 6) ELSE round(0.5::DOUBLE + (raw_confidence - 0.5::DOUBLE) * 0.6::DOUBLE, 6) END::DOUBLE AS confidence,
expert_id IN ('e1', 'e2') AS calibrated, coalesce(array_to_string(ids, ','), '') AS citations FROM hits""")
def answer_pipeline(spark, d):
    return _answered(spark, d).select("request_id", "status", "content", "structured.risk", "raw_confidence", "confidence", "calibrated", F.array_join(F.transform("citations", lambda x: x.cast("string")), ",").alias("citations"))


@query(_ANSWERED + " SELECT request_id, CASE WHEN skip THEN '' ELSE array_to_string(list_filter(named, lambda n, i: list_position(named, n) = i), ',') END AS entities FROM whole")
def answer_entities(spark, d):
    return _answered(spark, d).select("request_id", F.array_join(F.transform("entities", lambda x: x["name"]), ",").alias("entities"))
