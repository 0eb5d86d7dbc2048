"""The engine's tables, made from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *, levels: bool = True) -> DataFrame:
    """The documents; without levels they have no sensitivity, and labels are not read."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("domain"), F.concat("source", F.lit("/"), F.col("doc_id")).alias("uri"), F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), "text", T.content_hash(F.col("text")).alias("content_hash"))
    if not levels:
        return own
    level = F.when(F.col("toxic") == 1, "restricted").when(F.col("quality") == 0, "confidential").when(F.col("quality").isNotNull(), "internal").otherwise("public")
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality", "toxic")
    return own.join(marks, "document_id", "left").select(*own.columns, level.alias("sensitivity"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), "text")


def case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 2 == 0, "federation").otherwise("baseline").alias("arm"), F.col("lang").alias("domain"), (F.col("quality") == 1).alias("correct"), ((F.col("quality") + 1 - F.col("toxic")) / 2).alias("score"), F.col("n_chars").cast("double").alias("latency_ms"), (F.col("n_chars") / 1e6).alias("cost_usd"), (F.col("toxic") == 1).alias("used_fallback"), (F.col("doc_id") % 7 != 0).alias("trace_complete"), (F.col("doc_id") % 11 == 0).alias("errored"), F.floor(F.col("n_chars") / 4).alias("tokens"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("s"), F.col("user_id")).alias("session_id"), F.concat(F.lit("e"), F.col("user_id") % 5).alias("expert_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), (F.col("event_type") == "error").alias("used_fallback"), F.col("value").alias("latency_ms"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return a.select(F.col("event_id").alias("id"), "session_id", "expert_id", "ts", F.col("event_type").alias("action"), F.when(F.col("used_fallback"), "deny").otherwise("allow").alias("decision"))


def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("completion", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return c.where((F.col("role") == "user") & (F.col("next") == "assistant")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("d"), F.col("conv_id") % 3).alias("domain"), F.col("text").alias("prompt"), "completion")


# The same tables as SQL; each is the body of a common table expression.
SQL = {
    "docs": "SELECT doc_id AS document_id, lang AS domain, source || '/' || doc_id AS uri, 'doc ' || doc_id AS title, text, substr(sha256(text), 1, 32) AS content_hash, CASE WHEN toxic = 1 THEN 'restricted' WHEN quality = 0 THEN 'confidential' WHEN quality IS NOT NULL THEN 'internal' ELSE 'public' END AS sensitivity FROM documents LEFT JOIN labels USING (doc_id)",
    "results": "SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'federation' ELSE 'baseline' END AS arm, lang AS domain, quality = 1 AS correct, (quality + 1 - toxic) / 2 AS score, n_chars::DOUBLE AS latency_ms, n_chars / 1e6 AS cost_usd, toxic = 1 AS used_fallback, doc_id % 7 <> 0 AS trace_complete, doc_id % 11 = 0 AS errored, n_chars // 4 AS tokens FROM documents JOIN labels USING (doc_id)",
    "ans": "SELECT event_id, 's' || user_id AS session_id, 'e' || (user_id % 5) AS expert_id, event_type, ts, ts::DATE AS day, event_type = 'error' AS used_fallback, value AS latency_ms, (props->>'$.k')::DOUBLE / 100 AS confidence FROM events",
    "audit": "SELECT event_id AS id, 's' || user_id AS session_id, 'e' || (user_id % 5) AS expert_id, ts, event_type AS action, CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END AS decision FROM events",
    "examples": "SELECT conv_id * 1000 + turn AS id, 'd' || (conv_id % 3) AS domain, text AS prompt, completion FROM (SELECT *, lead(text) OVER w AS completion, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant'",
}


def sql(body: str, *names: str) -> str:
    """body after the tables that it names."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body
