"""Queries of runs, traces and hierarchies; importing this module adds them to those of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import runs

from . import fixtures as fx
from .fixtures import sql, table
from .queries import query


@query("SELECT 's' || user_id AS session_id, count(DISTINCT l) FILTER (l IN ('L2', 'L4', 'L5')) = 3 AS complete FROM (SELECT user_id, 'L' || (1 + event_id % 7) AS l FROM events) GROUP BY 1")
def trace_complete(spark, d):
    e = table(spark, d, "events")
    return runs.complete_traces(e.select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.concat(F.lit("L"), 1 + F.col("event_id") % 7).alias("layer")))


@query(sql("SELECT id FROM audit ORDER BY ts DESC, id DESC LIMIT 100", "audit"))
def audit_export(spark, d):
    return runs.export_rows(fx.audit_log(spark, d), 100).select("id")


def _runs(spark, d):
    """Orders as runs of two tenants, their lines as cases."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_custkey") % 2 == 0, "default").otherwise("other").alias("tenant"), F.col("o_orderstatus").alias("arm"), F.col("o_orderdate").alias("created_at"))
    cases = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("case "), F.col("l_partkey"), F.lit("/"), F.col("l_linenumber")).alias("case_id"), F.col("l_discount").alias("score"))
    return o, cases


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_orderdate AS created_at, o_orderstatus AS arm FROM orders WHERE o_custkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20),
c AS (SELECT l_orderkey AS run_id, 'case ' || l_partkey || '/' || l_linenumber AS case_id, l_discount AS score FROM lineitem)
SELECT run_id, created_at, arm, case_id, score, CASE WHEN case_id IS NOT NULL THEN row_number() OVER (PARTITION BY run_id ORDER BY case_id) END::INTEGER AS place FROM r LEFT JOIN c USING (run_id)""")
def eval_runs(spark, d):
    return runs.newest_runs(*_runs(spark, d)).select("run_id", "created_at", "arm", "case_id", "score", "place")


def places(spark, d):
    """Suppliers below nations below regions below the world."""
    n, r, s = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "supplier")
    key = lambda kind, c: F.concat(F.lit(kind), c)
    top = r.select(key("r", "r_regionkey").alias("name"), F.lit("world").alias("parent"))
    return top.unionByName(n.select(key("n", "n_nationkey").alias("name"), key("r", "n_regionkey").alias("parent"))).unionByName(s.select(key("s", "s_suppkey").alias("name"), key("n", "s_nationkey").alias("parent")))


@query("""SELECT 'r' || r_regionkey AS name, 'world' AS ancestor, 1 AS steps FROM region
UNION ALL SELECT 'n' || n_nationkey, unnest(['r' || n_regionkey, 'world']), unnest([1, 2]) FROM nation
UNION ALL SELECT 's' || s_suppkey, unnest(['n' || s_nationkey, 'r' || n_regionkey, 'world']), unnest([1, 2, 3]) FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def graph_recursive_closure(spark, d):
    return runs.ancestors(places(spark, d))


@query("SELECT 'r' || r_regionkey AS name, 'unknown parent' AS problem FROM region")
def onto_validate(spark, d):
    return runs.type_problems(places(spark, d))


def cal_fit(spark, d):
    e = fx.answers(spark, d)
    return runs.fit_calibrations(e.select("expert_id", "confidence", (F.col("latency_ms") / 490 < F.col("confidence")).alias("correct")))


query()(cal_fit)
