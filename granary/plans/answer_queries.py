"""Queries of answers, model versions and file sources; importing this module adds them to those of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators import answers as A
from granary.operators import registry as R
from granary.sources import files
from granary.sources.scratch import shared_dir

from .fixtures import table
from .queries import query


def given(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stance = F.when(F.col("event_id") % 4 == 0, "It is approved.").when(F.col("event_id") % 4 == 1, "Rejected by us").when(F.col("event_id") % 4 == 2, "no view")
    return e.select(F.col("event_id").alias("answer_id"), F.floor(F.col("event_id") / 4).alias("request_id"), F.concat(F.lit("e"), F.col("user_id") % 5).alias("expert_id"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"), (F.col("event_id") % 3 != 0).alias("calibrated"), (F.col("event_id") % 11 != 0).alias("passed"), ((F.col("user_id") % 5) / 4).alias("authority"), stance.alias("content"), (F.col("event_id") % 2).cast("int").alias("citations"), F.create_map(F.lit("amount"), (F.floor(F.col("value") / 50) * 50).cast("string"), F.lit("status"), F.col("event_type")).alias("structured"))


def fields(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d).select("request_id", "answer_id", F.explode("structured").alias("field", "value"))


GIVEN = "g AS (SELECT event_id AS answer_id, event_id // 4 AS request_id, (props->>'$.k')::DOUBLE / 100 AS confidence, event_id % 3 <> 0 AS calibrated, event_id % 11 <> 0 AS passed, (user_id % 5) / 4::DOUBLE AS authority, event_id % 2 AS citations, event_type AS status, floor(value / 50) * 50 AS amount FROM events)"
PAIRS = GIVEN + """,
a AS (SELECT request_id, amount, min(answer_id) AS id FROM g GROUP BY ALL), s AS (SELECT request_id, status, min(answer_id) AS id FROM g GROUP BY ALL),
p AS (SELECT x.request_id, 'amount' AS field, x.id AS first, y.id AS second, 'numeric_disagreement' AS kind FROM a x JOIN a y USING (request_id) WHERE x.id < y.id AND abs(x.amount - y.amount) / greatest(x.amount, y.amount, 1e-9) > 0.02
 UNION ALL SELECT x.request_id, 'status', x.id, y.id, 'verdict_disagreement' FROM s x JOIN s y USING (request_id) WHERE x.id < y.id)"""
CHAIN = PAIRS + """,
c AS (SELECT p.*, u.confidence - v.confidence AS lead, u.authority - v.authority AS rank, u.passed AS p1, v.passed AS p2, u.calibrated AS c1, v.calibrated AS c2 FROM p JOIN g u ON u.answer_id = first JOIN g v ON v.answer_id = second),
w AS (SELECT *, CASE WHEN p1 AND NOT p2 THEN 1 WHEN p2 AND NOT p1 THEN 2 END AS v, CASE WHEN round(lead, 9) >= 0.15 AND c1 THEN 1 WHEN round(lead, 9) <= -0.15 AND c2 THEN 2 END AS f, CASE WHEN rank >= 0.1 THEN 1 WHEN rank <= -0.1 THEN 2 END AS o FROM c),
r AS (SELECT request_id, field, first, second, kind, CASE WHEN v IS NOT NULL THEN 'verifier' WHEN f IS NOT NULL THEN 'confidence' WHEN o IS NOT NULL THEN 'authority' END AS strategy, CASE coalesce(v, f, o) WHEN 1 THEN first WHEN 2 THEN second END AS winner FROM w)"""
PARTS = CHAIN + """,
lost AS (SELECT DISTINCT CASE WHEN winner = first THEN second ELSE first END AS answer_id FROM r WHERE winner IS NOT NULL),
k AS (SELECT request_id, answer_id, confidence, answer_id NOT IN (SELECT answer_id FROM lost) AS accepted, round(confidence * authority * CASE WHEN passed THEN 1 ELSE 0.4 END::DOUBLE, 6) AS weight FROM g)"""


@query("WITH " + PAIRS + " SELECT * FROM p")
def conflict_pairs(spark, d):
    return A.conflicts(fields(spark, d))


@query("SELECT event_id // 4 AS request_id, 'approved' AS topic, min(event_id) FILTER (event_id % 4 = 0) AS positive, min(event_id) FILTER (event_id % 4 = 1) AS negative FROM events GROUP BY 1 HAVING positive IS NOT NULL AND negative IS NOT NULL")
def conflict_narrative(spark, d):
    # "no view" only takes the negative side of another topic, which nobody affirms.
    return A.stance_conflicts(given(spark, d))


@query("WITH " + CHAIN + " SELECT * FROM r")
def arb_strategy_chain(spark, d):
    return A.resolutions(conflict_pairs(spark, d), given(spark, d))


def parts(spark, d):
    settled = arb_strategy_chain(spark, d).where("winner is not null")
    lost = settled.select(F.when(F.col("winner") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("answer_id"))
    return A.contributions(given(spark, d), lost)


@query("WITH " + PARTS + " SELECT request_id, answer_id, accepted, weight FROM k")
def arb_contributions(spark, d):
    return parts(spark, d).select("request_id", "answer_id", "accepted", "weight")


@query("WITH " + PARTS + ", n AS (SELECT request_id, count(*) AS open FROM r WHERE winner IS NULL GROUP BY 1) SELECT request_id, round(sum(greatest(weight, 1e-6) * confidence) / sum(greatest(weight, 1e-6)) * greatest(0.5, 1 - 0.2 * coalesce(any_value(open), 0)), 4) AS confidence FROM k LEFT JOIN n USING (request_id) WHERE accepted GROUP BY 1")
def syn_confidence(spark, d):
    return A.reply_confidence(parts(spark, d), arb_strategy_chain(spark, d).where("winner is null").select("request_id"))


@query("SELECT user_id AS request_id, (props->>'$.k')::BIGINT AS chunk_id, value AS score, event_id AS position FROM events QUALIFY row_number() OVER (PARTITION BY user_id, (props->>'$.k')::BIGINT ORDER BY value DESC, event_id) = 1")
def syn_citations(spark, d):
    return A.best_citations(table(spark, d, "events").select(F.col("user_id").alias("request_id"), F.get_json_object("props", "$.k").cast("long").alias("chunk_id"), F.col("value").alias("score"), F.col("event_id").alias("position")))


CHECKS = [{"id": "cited", "type": "requires_citation", "severity": "warning"}, {"id": "amount", "type": "numeric_range", "fields": ["amount"], "minimum": 50, "maximum": 400}, {"id": "sure", "type": "min_confidence"}, {"id": "clean", "type": "forbidden_terms", "terms": ["Error"]}, {"id": "said", "type": "regex_match", "pattern": "approved|view"}, {"id": "odd", "type": "nobody_knows"}]


@query("WITH " + GIVEN + ", v AS (SELECT answer_id, list_filter([CASE WHEN citations = 0 THEN 'cited' END, CASE WHEN amount < 50 OR amount > 400 THEN 'amount' END, CASE WHEN confidence < 0.4 THEN 'sure' END, CASE WHEN status = 'error' THEN 'clean' END, CASE WHEN answer_id % 4 IN (1, 3) THEN 'said' END, 'odd'], lambda x: x IS NOT NULL) AS l FROM g) SELECT answer_id, array_to_string(l, ',') AS violated, NOT list_has_any(l, ['amount', 'sure', 'clean', 'said']) AS passed FROM v")
def verify_rules(spark, d):
    return A.verified(given(spark, d).drop("passed"), CHECKS).select("answer_id", F.array_join("violated", ",").alias("violated"), "passed")


@query("SELECT event_id AS answer_id, event_id % 5 <> 0 AS passed FROM events")
def verify_required(spark, d):
    empty = F.when(F.col("answer_id") % 5 == 0, F.lit("")).otherwise(F.lit("x"))
    rows = given(spark, d).drop("passed").withColumn("structured", F.map_concat("structured", F.create_map(F.lit("owner"), empty)))
    return A.verified(rows, [{"id": "all", "type": "required_fields", "fields": ["amount", "owner"]}]).select("answer_id", "passed")


def models(spark, d):
    p, at = table(spark, d, "part"), F.col("p_partkey")
    tier = F.get(F.array(*map(F.lit, ["micro_slm", "slm", "orchestrator"])), (at % 3).cast("int"))
    return p.select(F.format_string("m%08d", at).alias("model_id"), tier.alias("tier"), F.when(at % 4 == 0, "retired").otherwise("active").alias("status"), F.when(at % 2 == 0, F.col("p_name")).otherwise("").alias("adapter"), F.when(at % 3 == 0, F.col("p_type")).alias("model_name"), F.col("p_brand").alias("base_model"), (at == 7).alias("tier_default"))


MODELS = "m AS (SELECT printf('m%08d', p_partkey) AS model_id, CASE p_partkey % 3 WHEN 0 THEN 'micro_slm' WHEN 1 THEN 'slm' ELSE 'orchestrator' END AS tier, CASE WHEN p_partkey % 4 = 0 THEN 'retired' ELSE 'active' END AS status, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS adapter, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS model_name, p_brand AS base_model, p_partkey = 7 AS tier_default FROM part)"


@query("WITH " + MODELS + " SELECT model_id, tier FROM m WHERE status = 'active' AND tier = 'slm'")
def registry_list(spark, d):
    return models(spark, d).where("status = 'active' and tier = 'slm'").select("model_id", "tier")


@query("WITH " + MODELS + " SELECT model_id, coalesce(nullif(adapter, ''), nullif(model_name, ''), nullif(base_model, ''), model_id) AS served FROM m")
def registry_served_name(spark, d):
    return models(spark, d).select("model_id", R.served_name().alias("served"))


@query("WITH " + MODELS + ", t AS (SELECT tier, arg_min(model_id, CASE WHEN tier_default THEN '0' ELSE '1' END || model_id) AS model_id FROM m WHERE status = 'active' GROUP BY 1) SELECT c_custkey, model_id FROM customer JOIN t ON tier = CASE c_custkey % 4 WHEN 0 THEN 'micro_slm' WHEN 1 THEN 'slm' ELSE 'orchestrator' END")
def registry_tier_resolve(spark, d):
    tier = F.get(F.array(*map(F.lit, ["micro_slm", "slm", "small", "orchestrator"])), (F.col("c_custkey") % 4).cast("int"))
    return R.resolved(table(spark, d, "customer").select("c_custkey", tier.alias("tier")), models(spark, d)).select("c_custkey", "model_id")


@query("WITH " + MODELS + " SELECT base_model, count(*) AS adapters, greatest(count(*) - 1, 0) AS loads_saved FROM m WHERE adapter <> '' GROUP BY 1")
def registry_serving(spark, d):
    return R.serving_summary(models(spark, d))


def versions(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "retired").when(F.col("o_orderkey") % 3 == 0, "active").otherwise("candidate")
    return o.select(F.col("o_custkey").alias("model_id"), F.col("o_orderkey").alias("version"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("accuracy"))


VERSIONS = "v AS (SELECT o_custkey AS model_id, o_orderkey AS version, CASE WHEN o_orderstatus = 'F' THEN 'retired' WHEN o_orderkey % 3 = 0 THEN 'active' ELSE 'candidate' END AS status, o_orderdate AS created_at, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS accuracy FROM orders)"


@query("WITH " + VERSIONS + " SELECT model_id, count(*) AS versions, (list(version ORDER BY created_at DESC, version DESC) FILTER (status = 'active'))[1] AS active, count(*) FILTER (status = 'candidate') AS candidates FROM v GROUP BY 1")
def versions_summary(spark, d):
    return R.version_summary(versions(spark, d))


@query("WITH " + VERSIONS + """, x AS (SELECT *, row_number() OVER (PARTITION BY model_id, status ORDER BY created_at DESC, version DESC) AS k, max(accuracy) FILTER (status = 'active') OVER (PARTITION BY model_id) AS best FROM v),
y AS (SELECT *, status = 'candidate' AND k = 1 AND accuracy IS NOT NULL AND (best IS NULL OR accuracy >= best) AS win FROM x)
SELECT model_id, version, CASE WHEN win THEN 'active' WHEN status = 'active' AND bool_or(win) OVER (PARTITION BY model_id) THEN 'retired' ELSE status END AS status FROM y""")
def versions_promote(spark, d):
    return R.promoted(versions(spark, d)).select("model_id", "version", "status")


@query("WITH " + VERSIONS + """, w AS (SELECT c_custkey AS model_id, CASE WHEN c_custkey % 5 = 0 THEN (SELECT max(version) FROM v WHERE v.model_id = c_custkey AND status = 'candidate') END AS asked FROM customer WHERE c_custkey % 3 <> 0),
t AS (SELECT w.model_id, coalesce(asked, (list(version ORDER BY created_at DESC, version DESC) FILTER (status = 'retired'))[1]) AS target FROM w JOIN v USING (model_id) GROUP BY w.model_id, asked)
SELECT v.model_id, version, CASE WHEN version = target THEN 'active' WHEN target IS NOT NULL AND status = 'active' THEN 'retired' ELSE status END AS status FROM v LEFT JOIN t USING (model_id)""")
def versions_rollback(spark, d):
    """Two thirds of the models go back to their retired version that was created last, some to a candidate that is named."""
    all_ = versions(spark, d)
    named = all_.where("status = 'candidate'").groupBy("model_id").agg(F.max("version").alias("version"))
    wanted = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("model_id")).join(named, "model_id", "left").select("model_id", F.when(F.col("model_id") % 5 == 0, F.col("version")).alias("version"))
    return R.rolled_back(all_, wanted)[0].select("model_id", "version", "status")


@query("SELECT s_suppkey AS expert_id, concat_ws(',', CASE WHEN s_nationkey % 5 = 0 THEN 'sovereignty' END, CASE WHEN s_suppkey * 100 >= 5000 THEN 'volume' END, CASE WHEN s_acctbal > 5000 THEN 'latency' END, CASE WHEN s_nationkey < 3 THEN 'accuracy' END) AS triggers FROM supplier")
def promo_triggers(spark, d):
    u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("expert_id"), (F.col("s_nationkey") % 5 == 0).alias("sovereign"), (F.col("s_suppkey") * 100).alias("calls"), F.col("s_acctbal").alias("p95_ms"), F.lit(5000).alias("required_ms"), F.col("s_nationkey").alias("accuracy"), F.lit(3).alias("target"))
    return R.promotion_triggers(u, 5000).select("expert_id", F.array_join("triggers", ",").alias("triggers"))


@query("WITH s AS (SELECT l_orderkey AS plan_id, l_discount * 10 AS c, l_linenumber % 3 <> 0 AS ok FROM lineitem), g AS (SELECT plan_id, min(c) FILTER (ok) AS lo, avg(c) FILTER (ok) AS mean, count(*) FILTER (NOT ok) AS o, count(*) AS n FROM s GROUP BY 1) SELECT plan_id, coalesce(round(greatest(0, least(1, ((0.6::DOUBLE * lo + 0.4::DOUBLE * mean) + (1 - (0.6::DOUBLE * lo + 0.4::DOUBLE * mean)) * 0.35::DOUBLE * 0.3713::DOUBLE) * (1 - 0.5::DOUBLE * o / n))), 4), 0) AS confidence FROM g")
def route_plan_confidence(spark, d):
    return R.plan_confidence(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_linenumber") % 3 != 0).alias("matched"), F.lit(0.3713).alias("classification")))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def src_csv(spark, d):
    path = shared_dir(spark)
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.csv(path, header=True, sep=";")
    return files.read_delimited(spark, path)


@query("SELECT conv_id::VARCHAR AS domain, role, text AS content FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL")
def src_jsonl_train(spark, d):
    path = shared_dir(spark)
    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    good = c.select(F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"), F.col("conv_id").cast("string").alias("domain"))).alias("value"))
    good.unionByName(spark.createDataFrame([("{broken",), ("",)], "value string")).write.text(path)
    return files.read_training_jsonl(spark, path).select("domain", F.inline("messages"))


@query("SELECT r_regionkey, r_name, NULL::BIGINT AS population FROM region")
def src_schema_evolution(spark, d):
    return files.with_schema(table(spark, d, "region"), T.StructType.fromDDL("r_regionkey int, population bigint"))
