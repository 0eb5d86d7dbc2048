"""Queries of routing, plans, inventories and table profiles; importing this module adds them to those of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import graph, registry, routing, tables
from granary.operators.retrieval import entities_of
from granary.streaming import events as streams

from . import fixtures as fx
from .fixtures import sql, table
from .queries import _ENTITY_SQL, _PLAN, DICTIONARY, LONG_TOKENS, _plan, embedded, query, sql_list

CAPABILITIES = [
    ("german_terms", "e0", "de", ["der", "die", "und"], ["von der", "die sich"], "ein text", ["der"]),
    ("french_terms", "e1", "fr", ["des", "les"], ["par une"], "des textes", ["les", "que"]),
    ("english_terms", "e2", "en", ["than", "tion"], ["thes thre"], "than therble", ["the", "and"]),
    ("english_more", "e2", "en", ["thin"], ["therble"], "thin text", ["the"]),
]
DOMAIN_SCORES = {"en": 1.0, "de": 0.5}


def _match_sql() -> str:
    stop = set(text.ROUTING_STOP_WORDS)
    tokens = lambda words: sql_list([w for w in dict.fromkeys(words) if len(w) > 2 and w not in stop])
    rows = ", ".join(
        f"('{c}', '{x}', '{d}', {tokens(k)}, {tokens(' '.join(e).split())}, {tokens(c.split('_') + s.split())}, {sql_list(o)}, {DOMAIN_SCORES.get(d, 0.0)}::DOUBLE)" for c, x, d, k, e, s, o in CAPABILITIES
    )
    over = lambda c: f"CASE WHEN len(list_intersect(t, {c})) > 0 THEN greatest(len(list_intersect(t, {c})) / len(t), 1 - exp(-len(list_intersect(t, {c})) / 2.5)) ELSE 0 END"
    return f"""q AS (SELECT item_id AS request_id, list_filter(list_distinct({LONG_TOKENS}), lambda x: NOT list_contains({sql_list(text.ROUTING_STOP_WORDS)}, x)) AS t, {_ENTITY_SQL} AS ents FROM benchmark),
c(capability_id, expert_id, domain, k, e, d, o, ds) AS (VALUES {rows}),
l AS (SELECT *, least(0.45::DOUBLE * {over("e")} + 0.35::DOUBLE * {over("k")} + 0.20::DOUBLE * {over("d")} + 0.15::DOUBLE * len(list_intersect(t, k)) / len(k), 1.0) AS lex,
  CASE WHEN len(ents) = 0 THEN NULL WHEN len(list_intersect(o, ents)) > 0 THEN greatest(len(list_intersect(o, ents)) / len(ents), len(list_intersect(o, ents)) / len(o)) ELSE 0 END AS ent FROM q, c),
b AS (SELECT *, CASE WHEN ent IS NULL THEN lex ELSE (0.35::DOUBLE * lex + 0.20::DOUBLE * ent) / 0.55::DOUBLE END AS v FROM l),
m AS (SELECT request_id, capability_id, expert_id, domain, round(lex, 6) AS lexical, round(ent, 6) AS entity,
  round(least((CASE WHEN lex >= 0.4 AND coalesce(ent, 0) >= 0.4 THEN v + 0.25::DOUBLE * (1 - v) ELSE v END) * (0.6::DOUBLE + 0.4::DOUBLE * ds), 1.0), 6) AS score FROM b)"""


def _found(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), "text", entities_of(F.col("text"), DICTIONARY).alias("entities"))
    return routing.matches(asked, CAPABILITIES, DOMAIN_SCORES)


@query(f"WITH {_match_sql()} SELECT request_id, capability_id, lexical FROM m")
def route_lexical(spark, d):
    return _found(spark, d).select("request_id", "capability_id", "lexical")


def _said() -> str:
    """The texts of the capabilities, as rows (id, text)."""
    rows = ", ".join(f"('{c}', '{' '.join([c.replace('_', ' '), s, *k, *e])}')" for c, _, _, k, e, s, _ in CAPABILITIES)
    return f"SELECT * FROM (VALUES {rows}) x(id, text)"


@query(f"""WITH {_match_sql()}, {embedded("hq", "SELECT item_id AS id, text FROM benchmark")}, {embedded("hk", _said())},
nq AS (SELECT id, sqrt(sum(v * v)) AS n FROM hq GROUP BY id), nk AS (SELECT id, sqrt(sum(v * v)) AS n FROM hk GROUP BY id),
near AS (SELECT hq.id AS request_id, hk.id AS capability_id, round(greatest(0, sum(hq.v * hk.v) / any_value(nq.n * nk.n)), 6) AS semantic FROM hq JOIN hk USING (i) JOIN nq ON nq.id = hq.id JOIN nk ON nk.id = hk.id GROUP BY ALL),
w AS (SELECT b.*, coalesce(near.semantic, 0) AS semantic, (0.45::DOUBLE * coalesce(near.semantic, 0) + 0.35::DOUBLE * lex + 0.20::DOUBLE * coalesce(ent, 0)) / (0.80::DOUBLE + CASE WHEN ent IS NULL THEN 0 ELSE 0.20::DOUBLE END) AS x FROM b LEFT JOIN near USING (request_id, capability_id)),
z AS (SELECT request_id, capability_id, expert_id, domain, semantic, round(lex, 6) AS lexical, round(ent, 6) AS entity,
  round(least(least(CASE WHEN (semantic >= 0.4)::INT + (lex >= 0.4)::INT + (coalesce(ent, 0) >= 0.4)::INT >= 2 THEN x + 0.25::DOUBLE * (1 - x) ELSE x END, 1) * (0.6::DOUBLE + 0.4::DOUBLE * ds), 1.0), 6) AS score FROM w)
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, capability_id)::INTEGER AS rank FROM z QUALIFY rank <= 3""")
def route_match(spark, d):
    """With the cosine of request and capability as a third signal."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), "text", entities_of(F.col("text"), DICTIONARY).alias("entities"))
    return routing.best_matches(routing.matches(asked, CAPABILITIES, DOMAIN_SCORES, embedded=True), 3)


@query(f"""WITH {_match_sql()}, n AS (SELECT *, max(score) OVER (PARTITION BY request_id) AS best FROM m WHERE score >= 0.2),
x AS (SELECT * FROM n WHERE score >= greatest(0.2, best * 0.55::DOUBLE) QUALIFY row_number() OVER (PARTITION BY request_id, expert_id ORDER BY score DESC, capability_id) = 1)
SELECT request_id, expert_id, capability_id, score, row_number() OVER w AS step FROM x WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, capability_id) QUALIFY row_number() OVER w <= 8""")
def route_plan(spark, d):
    return routing.planned(_found(spark, d))


ASKED = ["der", "die", "des", "tion", "sich"]
_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^[ \t•*-]+|[ \t•*-]+$', '', 'g')), lambda s: length(s) > 20)"


@query(rf"""WITH p AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, lower(substr(sentence, 1, 80)) ORDER BY pos) = 1),
r AS (SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_×÷]{{3,}}')), {sql_list(ASKED)})) / 5 AS score FROM f),
g AS (SELECT doc_id, count(*) AS found, max(score) AS best FROM r WHERE score > 0 GROUP BY doc_id)
SELECT doc_id AS id, coalesce(found, 0) AS found, coalesce(best, 0)::DOUBLE AS best, CASE WHEN found IS NULL THEN 0.1 ELSE round(least(0.95, 0.25::DOUBLE + 0.55::DOUBLE * best + 0.20::DOUBLE * least(found, 5) / 5), 4) END::DOUBLE AS confidence FROM documents LEFT JOIN g USING (doc_id)""")
def extract_sentences(spark, d):
    return routing.extracted(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ASKED)


@query(sql("""SELECT event_id AS id, CASE WHEN used_fallback THEN 'escalation' ELSE 'failure' END AS kind, session_id AS prompt, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS completion,
CASE WHEN event_id % 3 = 0 THEN 'needs_answer' ELSE 'pending' END AS status FROM ans WHERE used_fallback OR confidence < 0.2""", "ans"))
def distill_feedback(spark, d):
    a = fx.answers(spark, d)
    return routing.feedback_prompts(a.select(F.col("event_id").alias("id"), "used_fallback", F.col("confidence").alias("score"), F.col("session_id").alias("prompt"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("label")), 0.2)


# --- plans -----------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_PLAN}, a AS (SELECT task, needs FROM n UNION SELECT 2, 9), r(task, up) AS (SELECT task, needs FROM a UNION SELECT r.task, a.needs FROM r JOIN a ON a.task = r.up)
SELECT DISTINCT task FROM r WHERE up IN (SELECT task FROM r WHERE task = up)""")
def dag_cycle(spark, d):
    tasks, needs = _plan(spark, d)
    back = spark.createDataFrame([(2, 9)], "task long, needs long")
    return graph.blocked(tasks, needs.unionByName(back))


@query(f"WITH RECURSIVE {_PLAN}, r AS (SELECT task FROM t WHERE task % 4 = 3 UNION SELECT n.task FROM r JOIN n ON n.needs = r.task) SELECT DISTINCT task FROM r WHERE task % 4 <> 3")
def dag_skip_propagation(spark, d):
    tasks, needs = _plan(spark, d)
    return graph.skipped(tasks.where("task % 4 = 3"), needs)


@query(f"WITH {_PLAN} SELECT task AS source_id, needs AS target_id FROM n WHERE task % 5 <> 0 AND needs % 5 <> 0")
def dag_declared_deps(spark, d):
    tasks, needs = _plan(spark, d)
    nodes = tasks.select(F.col("task").alias("node_id"), F.when(F.col("task") % 5 == 0, "domain").otherwise("capability").alias("kind"))
    return graph.declared_dependencies(needs.select(F.col("task").alias("source_id"), F.col("needs").alias("target_id"), F.lit("depends_on").alias("relation")), nodes)


@query(f"WITH {_PLAN} SELECT task, needs, CASE WHEN needs % 3 <> 0 THEN 'answer ' || needs::BIGINT END AS content, needs % 3 = 0 AS missing FROM n")
def dag_upstream_join(spark, d):
    tasks, needs = _plan(spark, d)
    return graph.upstream(needs, tasks.select("task", (F.col("task") % 3 != 0).alias("ok"), F.concat(F.lit("answer "), "task").alias("content")))


# --- inventories and tables --------------------------------------------------------------------------------------------


def _experts(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("expert_id"), F.when(F.col("s_nationkey") % 4 == 0, "heuristic").otherwise("served").alias("backend"))


def _inventory(spark, d):
    fits = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("expert_id"), (F.col("s_suppkey") % 2 == 0).alias("fitted"), (F.col("s_suppkey") * 10).alias("samples"))
    return registry.inventory(_experts(spark, d), fits)


@query("SELECT s_suppkey AS expert_id, CASE WHEN s_nationkey % 4 = 0 THEN 'heuristic' ELSE 'served' END AS backend, s_suppkey % 6 = 0 AS calibrated, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 10 ELSE 0 END AS calibration_samples FROM supplier")
def registry_inventory(spark, d):
    return _inventory(spark, d)


@query("SELECT count(*) AS experts, count(*) FILTER (s_suppkey % 6 <> 0) AS uncalibrated, count(*) FILTER (s_nationkey % 4 = 0) AS placeholders FROM supplier")
def agg_health(spark, d):
    return registry.health(_inventory(spark, d))


@query("""WITH c AS (SELECT s_nationkey % 4 AS tier, max(s_suppkey) AS chosen FROM supplier WHERE s_suppkey % 7 = 0 GROUP BY 1)
SELECT s_suppkey AS model_id, s_nationkey % 4 AS tier, CASE WHEN chosen IS NULL THEN s_suppkey % 5 = 0 ELSE s_suppkey = chosen END AS tier_default FROM supplier LEFT JOIN c ON c.tier = s_nationkey % 4""")
def registry_upsert(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("model_id"), (F.col("s_nationkey") % 4).alias("tier"), (F.col("s_suppkey") % 5 == 0).alias("tier_default"))
    return registry.registered(s, s.where("model_id % 7 = 0").withColumn("tier_default", F.lit(True)))


@query("SELECT event_id AS node_id, '' AS tier_hint, (props->>'$.k')::BIGINT AS priority, 0 AS outputs FROM events")
def graph_capabilities(spark, d):
    return registry.capabilities(table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.col("props").alias("attributes"))).withColumn("outputs", F.size("outputs"))


@query("SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' · ' || p_brand ELSE '' END || ' · ' || p_type AS embed FROM part")
def embed_text(spark, d):
    return table(spark, d, "part").withColumn("brand", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")).select("p_partkey", tables.embedding_text(["p_name", "brand", "p_type"]).alias("embed"))


@query("SELECT label AS domain, count(*) AS chunks, count(*) FILTER (label % 3 = 0 OR vec_id % 2 = 0) AS stale, label % 3 = 0 OR count(*) = count(*) FILTER (vec_id % 2 = 0) AS needs_reindex FROM embeddings GROUP BY label")
def vec_needs_reindex(spark, d):
    e = table(spark, d, "embeddings")
    old = (F.col("label") % 3 == 0) | (F.col("vec_id") % 2 == 0)
    return tables.stale_share(e.select(F.col("label").alias("domain"), F.when(old, "hash:128").otherwise("hash:256").alias("embedding_model")), "hash:256")


@query("SELECT 'p_size' AS name, count(*) AS n, min(p_size)::DOUBLE AS least, max(p_size)::DOUBLE AS most FROM part UNION ALL SELECT 'price', count(*), min(p_retailprice), max(p_retailprice) FROM part")
def tab_numeric_profile(spark, d):
    p = table(spark, d, "part").select("p_name", "p_brand", F.col("p_size").cast("string"), F.translate(F.col("p_retailprice").cast("string"), ".", ",").alias("price"))
    return tables.numeric_profile(p, p.columns)


@query(sql(r"SELECT document_id AS chunk_id, document_id, greatest(1, len(regexp_extract_all(coalesce(text, ''), '\S+')))::INTEGER AS token_count, CASE WHEN document_id % 4 = 0 THEN 'restricted' ELSE sensitivity END AS sensitivity FROM docs", "docs"))
def ingest_add_chunks(spark, d):
    docs = fx.documents(spark, d)
    return tables.added_chunks(docs.select(F.col("document_id").alias("chunk_id"), "document_id", "text", F.when(F.col("document_id") % 4 == 0, "restricted").alias("sensitivity")), docs)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def dml_delete_document(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, run""")
def stream_session(spark, d):
    return streams.written(streams.sessions(streams.read_events(spark, f"{d}/events.parquet")), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_trace_counts(spark, d):
    return streams.written(streams.layer_counts(streams.read_events(spark, f"{d}/events.parquet")), "complete")


DOMAIN_OF = {"der": "de", "les": "fr", "que": "fr", "the": "en", "and": "en"}
ABOUT = {"de": "ung ich der sch", "fr": "les des ment", "en": "the and tion", "es": "que los ción"}
_CLASSIFY = f"""{{match}}, e(name, domain) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in DOMAIN_OF.items())}), dd(domain, w) AS (VALUES {", ".join(f"('{k}', {sql_list([w for w in v.split() if len(w) > 2 and w not in text.ROUTING_STOP_WORDS])})" for k, v in ABOUT.items())}),
md AS (SELECT request_id, domain, max(score) AS s FROM m GROUP BY ALL), eh AS (SELECT request_id, domain, count(*) AS n FROM (SELECT request_id, unnest(ents) AS name FROM q) JOIN e USING (name) GROUP BY ALL),
ov AS (SELECT request_id, domain, len(list_intersect(t, w)) / len(t) AS share FROM q, dd WHERE len(list_intersect(t, w)) > 0),
sc AS (SELECT request_id, domain, least(1.0::DOUBLE, least(1.0::DOUBLE, coalesce(s, 0) + 0.15::DOUBLE * coalesce(n, 0)) + 0.2::DOUBLE * coalesce(share, 0)) AS score FROM md FULL JOIN eh USING (request_id, domain) FULL JOIN ov USING (request_id, domain)),
rk AS (SELECT *, max(score) OVER (PARTITION BY request_id) AS best, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, domain) AS place FROM sc),
cl AS (SELECT request_id, string_agg(domain, ',' ORDER BY place) FILTER (score >= greatest(best * 0.6::DOUBLE, 0.12)) AS domains, max(best) AS best, coalesce(max(score) FILTER (place = 2), 0) AS second FROM rk WHERE best > 0 GROUP BY request_id),
cls AS (SELECT item_id AS request_id, text, coalesce(domains, '') AS domains, CASE WHEN coalesce(best, 0) <= 0 THEN 0.0 ELSE round(least(1, least(best, 1) * (0.65::DOUBLE + 0.35::DOUBLE * greatest(0, (best - second) / best))), 4) END AS confidence FROM benchmark LEFT JOIN cl ON cl.request_id = item_id)"""


def _classify_sql() -> str:
    return _CLASSIFY.replace("{match}", _match_sql())


def _classified(spark, d):
    asked = fx.requests(spark, d)
    tokens = asked.select("request_id", text.token_set(F.col("text"), text.ROUTING_STOP_WORDS).alias("t"))
    about = spark.createDataFrame(list(ABOUT.items()), "domain string, about string").select("domain", F.explode(text.token_set(F.col("about"), text.ROUTING_STOP_WORDS)).alias("token"))
    described = tokens.select("request_id", F.size("t").alias("n"), F.explode("t").alias("token")).join(F.broadcast(about), "token").groupBy("request_id", "domain").agg((F.count(F.lit(1)) / F.max("n")).alias("share"))
    known = spark.createDataFrame(list(DOMAIN_OF.items()), "name string, domain string")
    named = asked.select("request_id", F.explode(entities_of(F.col("text"), DICTIONARY)).alias("name")).join(F.broadcast(known), "name")
    return routing.classified(asked, routing.domain_scores(_found(spark, d).select("request_id", "domain", "score"), named, described))


@query("WITH " + _classify_sql() + " SELECT request_id, domains, confidence FROM cls")
def route_classify(spark, d):
    return _classified(spark, d)


_MARKED = r"regexp_matches(coalesce(text, ''), '(?i)(^|[^\p{L}\p{N}_])(" + "|".join(routing.MARKERS) + r")([^\p{L}\p{N}_]|$)')"


@query("WITH " + _classify_sql() + f" SELECT request_id, (contains(domains, ',') OR {_MARKED} OR 1 + request_id % 2 > 1 OR confidence < 0.35) AS planned FROM cls")
def route_should_plan(spark, d):
    both = _classified(spark, d).join(fx.requests(spark, d), "request_id")
    return both.select("request_id", routing.should_plan(F.col("text"), F.col("domains"), 1 + F.col("request_id") % 2, F.col("confidence")).alias("planned"))


@query("WITH " + _classify_sql() + """, n AS (SELECT *, max(score) OVER (PARTITION BY request_id) AS best FROM m WHERE score >= 0.2),
x AS (SELECT * FROM n WHERE score >= greatest(0.2, best * 0.55::DOUBLE) QUALIFY row_number() OVER (PARTITION BY request_id, expert_id ORDER BY score DESC, capability_id) = 1),
g AS (SELECT request_id, count(*) AS subtasks, 0.6::DOUBLE * min(score) + 0.4::DOUBLE * avg(score) AS core FROM x GROUP BY 1),
p AS (SELECT cls.request_id, coalesce(subtasks, 0) AS subtasks, CASE WHEN core IS NULL THEN 0 ELSE round(greatest(0, least(1, core + (1 - core) * 0.35::DOUBLE * confidence)), 4) END::DOUBLE AS confidence FROM cls LEFT JOIN g USING (request_id))
SELECT request_id, subtasks, confidence, CASE WHEN subtasks = 0 THEN 'no capability in the graph covers this request' WHEN confidence < 0.55 THEN 'below' END AS reason FROM p""")
def route_escalate(spark, d):
    """By the confidence of the whole plan: its weakest step, their mean, and how well the request was classified."""
    steps = routing.planned(_found(spark, d)).join(_classified(spark, d).select("request_id", F.col("confidence").alias("classification")), "request_id").select("request_id", F.col("score").alias("confidence"), F.lit(True).alias("matched"), "classification")
    out = routing.escalation(fx.requests(spark, d), steps)
    return out.withColumn("reason", F.when(F.startswith("reason", F.lit("routing confidence")), "below").otherwise(F.col("reason")))


@query("WITH " + _classify_sql() + ", top AS (SELECT request_id, capability_id, score FROM m QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, capability_id) = 1) SELECT cls.request_id, domains, confidence, capability_id, round(score, 6) AS score, coalesce(score < 0.55, true) AS would_escalate FROM cls LEFT JOIN top USING (request_id)")
def route_explain(spark, d):
    """A dry run: what routing sees in a request, and whether it would be escalated."""
    best = routing.best_matches(_found(spark, d), 1).select("request_id", "capability_id", "score")
    return _classified(spark, d).join(best, "request_id", "left").select("request_id", "domains", "confidence", "capability_id", F.round("score", 6).alias("score"), F.coalesce(F.col("score") < routing.ESCALATE_BELOW, F.lit(True)).alias("would_escalate"))


@query("SELECT o_orderkey, 'R$ ' || translate(format('{:,.2f}', o_totalprice::DOUBLE), ',.', '.,') AS money, translate(format('{:.1f}', o_totalprice::DOUBLE / 1000), '.', ',') AS number, coalesce(translate(format('{:.1f}', CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DOUBLE / 5000 END), '.', ',') || '%', 'n/d') AS percent FROM orders")
def tab_format_ptbr(spark, d):
    o = table(spark, d, "orders").withColumn("x", F.col("o_totalprice").cast("double"))
    return o.select("o_orderkey", text.money_ptbr(F.col("x"), 2).alias("money"), text.number_ptbr(F.col("x") / 1000, 1).alias("number"), text.percent_ptbr(F.when(F.col("o_orderkey") % 7 != 0, F.col("x")), 1, 500000).alias("percent"))
