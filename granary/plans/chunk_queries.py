"""Queries of chunking, selectors, envelopes and file sources; importing this module adds them to those of queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import chunks, policy, uploads
from granary.sources import files
from granary.sources.scratch import dealt, shared_dir
from granary.streaming import events as streams

from . import fixtures as fx
from .fixtures import sql, table
from .queries import query


#: Manuals and documents that a task cuts; a manual has some 9 000 characters.
MANUALS, DOCUMENTS = 5_000, 2_000


def manuals(spark, d):
    """Parts as small marked-up manuals: headings of brand, type and size, and the name as sentences of a paragraph, more or less than 400 words long."""
    p = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), MANUALS, "p_partkey")
    body = F.concat(F.lit("# "), "p_brand", F.lit("\nIntro.\n## "), "p_type", F.lit("\n"), F.repeat(F.concat("p_name", F.lit(". ")), (150 + F.col("p_partkey") % 450).cast("int")), F.lit("\n\n### size "), "p_size", F.lit("\nlast words\n# End\n"))
    return p.select("p_partkey", body.alias("text"))


def _chunks_sql(key: str, paragraphs: str) -> str:
    """SQL of the chunks of paragraphs (id, place, section, text), each the only one of its section."""
    return rf"""WITH RECURSIVE para AS (SELECT *, regexp_extract_all(text, '\S+') AS w FROM (SELECT id, place, section, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM ({paragraphs}))),
sent AS (SELECT id, place, section, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM para WHERE len(w) > 400)),
own AS (SELECT *, len(regexp_extract_all(s, '\S+')) AS n FROM sent), run AS (SELECT *, sum(n) OVER (PARTITION BY id, place ORDER BY k)::BIGINT AS upto FROM own),
reach AS (SELECT *, min(k) OVER (PARTITION BY id, place ORDER BY upto RANGE BETWEEN greatest(401 - n, 0) FOLLOWING AND UNBOUNDED FOLLOWING) AS beyond FROM run),
follows AS MATERIALIZED (SELECT id, place, k, greatest(k + 1, beyond) AS next FROM reach WHERE beyond > k OR (beyond = k AND EXISTS (SELECT 1 FROM run r WHERE r.id = reach.id AND r.place = reach.place AND r.k = reach.k + 1))),
starts AS (SELECT id, place, 1::BIGINT AS k FROM sent WHERE k = 1 UNION ALL SELECT f.id, f.place, f.next FROM starts JOIN follows f USING (id, place, k)),
piece AS (SELECT sent.*, count(starts.k) OVER (PARTITION BY id, place ORDER BY k) AS piece FROM sent LEFT JOIN starts USING (id, place, k)),
every AS (SELECT id, place, section, 0 AS piece, text FROM para WHERE len(w) BETWEEN 1 AND 400
UNION ALL SELECT id, place, section, 1, array_to_string(w[-40:], ' ') FROM para WHERE len(w) BETWEEN 220 AND 400
UNION ALL SELECT id, place, section, piece, string_agg(s, ' ' ORDER BY k) FROM piece GROUP BY id, place, section, piece)
SELECT id AS {key}, (row_number() OVER (PARTITION BY id ORDER BY place, piece) - 1)::INTEGER AS ordinal, section, len(regexp_extract_all(text, '\S+'))::INTEGER AS words, sha256(text) AS text_sha256 FROM every"""


@query(_chunks_sql("doc_id", "SELECT doc_id AS id, 0 AS place, NULL::VARCHAR AS section, coalesce(text, '') AS text FROM documents"))
def chunk_documents(spark, d):
    """The tables' documents have no blank lines and no headings, so the SQL takes each as one paragraph."""
    return chunks.chunked(dealt(table(spark, d, "documents").select("doc_id", "text"), DOCUMENTS, "doc_id"), "doc_id", "text").select("doc_id", "ordinal", "section", "words", F.sha2("text", 256).alias("text_sha256"))


@query(_chunks_sql("p_partkey", """SELECT p_partkey AS id, unnest([0, 1, 2]) AS place, unnest([trim(p_brand), trim(p_brand) || ' › ' || trim(p_type), trim(p_brand) || ' › ' || trim(p_type) || ' › size ' || p_size]) AS section,
unnest(['Intro.', repeat(p_name || '. ', (150 + p_partkey % 450)::BIGINT), 'last words']) AS text FROM part"""))
def chunk_split_long(spark, d):
    """Long paragraphs, in sections, cut at sentences; shorter ones with what they carry over."""
    return chunks.chunked(manuals(spark, d), "p_partkey", "text").select("p_partkey", "ordinal", "section", "words", F.sha2("text", 256).alias("text_sha256"))


@query("""
SELECT p_partkey, unnest([0, 2, 5, 7])::INTEGER AS line, unnest([1, 2, 3, 1])::INTEGER AS level, unnest([trim(p_brand), trim(p_type), 'size ' || p_size, 'End']) AS title,
       unnest([trim(p_brand), trim(p_brand) || ' › ' || trim(p_type), trim(p_brand) || ' › ' || trim(p_type) || ' › size ' || p_size, 'End']) AS path FROM part""")
def chunk_headings(spark, d):
    return chunks.headings(manuals(spark, d), "p_partkey", "text")


SELECTORS = ["domain:de", "sensitivity:confidential", "entity:the", "expert:e1", "*"]


@query(sql("SELECT document_id, domain = 'de' AS s0, sensitivity IN ('confidential', 'restricted') AS s1, contains(coalesce(text, ''), 'the') AS s2, document_id % 2 = 1 AS s3, true AS s4 FROM docs", "docs"))
def ibac_selectors(spark, d):
    """Whether each selector matches, for a resource whose own domain is blank and so is the request's."""
    has = F.when(F.contains(F.coalesce("text", F.lit("")), F.lit("the")), F.array(F.lit("the"))).otherwise(F.array().cast("array<string>"))
    own = fx.documents(spark, d).withColumns({"resource_domain": F.lit(""), "entities": has, "expert_id": F.concat(F.lit("e"), F.col("document_id") % 2), "resource_id": F.col("uri")})
    tests = [policy.subject_matches(s) if s.startswith("expert") else policy.resource_matches(s) for s in SELECTORS]
    return own.select("document_id", *(t.alias(f"s{i}") for i, t in enumerate(tests)))


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'SMALL' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END, p_size DESC, p_partkey)::INTEGER AS place FROM part WHERE p_partkey % 5 > 0 AND (p_partkey % 4 > 0 OR p_partkey % 7 = 0)")
def ibac_policy_order(spark, d):
    """Parts as a table of policies, the brand as what they are for: the order in which each brand's are tried."""
    effect = F.when(F.col("p_type") == "SMALL", "deny").when(F.col("p_type") == "ECONOMY", "require_approval").otherwise("allow")
    tenants = F.when(F.col("p_partkey") % 4 > 0, F.array().cast("array<string>")).when(F.col("p_partkey") % 7 == 0, F.array(F.lit("other"), F.lit("own"))).otherwise(F.array(F.lit("other")))
    own = table(spark, d, "part").select("p_partkey", "p_brand", effect.alias("effect"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 5 > 0).alias("enabled"), F.array(F.lit("emission")).alias("points"), tenants.alias("tenants"))
    return policy.ordered(own, "p_brand", "p_partkey", point="emission", tenant="own").select("p_partkey", "p_brand", "place")


@query("SELECT event_id, 'event' AS type, 'agent' AS sender_kind, 'u' || user_id AS sender_id, md5('s' || user_id) AS trace_id, event_type AS body FROM events")
def stream_envelopes(spark, d):
    return streams.written(streams.envelopes(streams.read_events(spark, f"{d}/events.parquet")))


@query(sql("SELECT decision, count(*) AS n, min(id) AS first FROM audit GROUP BY decision", "audit"))
def audit_append(spark, d):
    """Two appends to one log, read back."""
    log, path = fx.audit_log(spark, d), shared_dir(spark)
    for part in ("deny", "allow"):
        files.append_rows(log.where(F.col("decision") == part), path)
    return spark.read.schema(log.schema).parquet(path).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query("SELECT 'c' || item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'cases' END AS domain, text AS question, '' AS expected, CASE WHEN item_id % 3 = 0 THEN 'exact' ELSE 'keywords' END AS grader, 1.0::DOUBLE AS weight FROM benchmark")
def src_jsonl_eval(spark, d):
    b, folder = table(spark, d, "benchmark"), shared_dir(spark)
    lines = b.select(F.to_json(F.struct(F.concat(F.lit("c"), "item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "even").alias("domain"), F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 0, "exact").alias("grader"))).alias("value"))
    comments = spark.createDataFrame([("# a comment",), ("",), ("// another",)], "value string")
    lines.unionByName(comments).write.text(folder)
    cases = files.read_eval_jsonl(spark, folder)
    return cases.withColumn("domain", F.when(F.col("domain") == "even", "even").otherwise("cases"))  # files are named by the writer


@query("SELECT lang AS domain, sum(length(coalesce(text, '')) + 1)::BIGINT AS chars FROM documents GROUP BY lang")
def src_corpus_scan(spark, d):
    """Documents as text files in a folder for each language, written (with a line end after each) and scanned again."""
    root = shared_dir(spark)
    table(spark, d, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(root)
    found = files.scan_corpus(spark, root)
    return found.groupBy(F.regexp_replace("domain", "^lang=", "").alias("domain")).agg(F.sum(F.length("text")).alias("chars"))


def _sheets(spark, d, edited: bool):
    """A file with a sheet for each brand; edited, some sheets lose a third of their rows."""
    p = table(spark, d, "part")
    kept = p.where("not (p_brand like '%1' and p_partkey % 3 = 0)") if edited else p
    price = F.when(F.col("p_partkey") % 5 > 0, F.translate(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), ".", ",")).otherwise("")
    row = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return kept.select(F.lit("parts.csv").alias("filename"), F.col("p_brand").alias("sheet"), row.alias("row"), F.array(*map(F.lit, ["key", "type", "price"])).alias("headers"), F.array(F.col("p_partkey").cast("string"), F.col("p_type"), price).alias("cells"))


@query("""WITH p AS (SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, p_partkey AS k, p_type AS t, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS x FROM part WHERE NOT (p_brand LIKE '%1' AND p_partkey % 3 = 0)),
l AS (SELECT *, 'key: ' || k || '; type: ' || t || coalesce('; price: ' || replace(x::DECIMAL(12, 2)::VARCHAR, '.', ','), '') AS line, count(*) OVER (PARTITION BY sheet) AS n FROM p),
c AS (SELECT sheet, (r - 1) // 12 + 1 AS ordinal, 'table_rows' AS kind, sheet || ' — registros ' || min(r) || ' a ' || max(r) || ' de ' || any_value(n) || chr(10) || 'Colunas: key, type, price' || chr(10) || chr(10) || string_agg('[' || r || '] ' || line, chr(10) ORDER BY r) AS text FROM l GROUP BY 1, 2),
f AS (SELECT x, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.6f', x), '0+$', ''), '\\.$', '') END AS s FROM (SELECT DISTINCT x::DECIMAL(12, 2)::DOUBLE AS x FROM p)),
m AS (SELECT sheet, any_value(n) AS n, min(k) AS k0, max(k) AS k1, count(x) AS xs, min(x::DECIMAL(12, 2)::DOUBLE) AS x0, max(x::DECIMAL(12, 2)::DOUBLE) AS x1, string_agg('- ' || line, chr(10) ORDER BY r) FILTER (r <= 3) AS sample FROM l GROUP BY 1),
s AS (SELECT sheet, 0 AS ordinal, 'table_schema' AS kind, '# ' || sheet || ' — estrutura dos dados' || chr(10) || chr(10) || 'Origem: parts.csv' || chr(10) || 'Registros: ' || n || chr(10) || 'Colunas (3): key, type, price'
  || CASE WHEN n >= 2 OR xs >= greatest(2, floor(n * 0.6)) THEN chr(10) || chr(10) || 'Colunas numéricas:' ELSE '' END || CASE WHEN n >= 2 THEN chr(10) || '- key: numérica, de ' || k0 || ' a ' || k1 || ' (' || n || ' valores)' ELSE '' END
  || CASE WHEN xs >= greatest(2, floor(n * 0.6)) THEN chr(10) || '- price: numérica, de ' || a.s || ' a ' || b.s || ' (' || xs || ' valores)' ELSE '' END || chr(10) || chr(10) || 'Primeiros registros como amostra:' || chr(10) || sample AS text
  FROM m LEFT JOIN f a ON a.x = x0 LEFT JOIN f b ON b.x = x1)
SELECT 'upload://parts.csv#' || sheet AS uri, ordinal, kind, text FROM (SELECT * FROM c UNION ALL SELECT * FROM s)""".replace("\\\\", "\\"))
def tab_ingest(spark, d):
    """Uploaded, edited and uploaded again: only the edited sheets are replaced, and none of their old rows shows."""
    base = shared_dir(spark)
    uploads.ingest(_sheets(spark, d, False), base, domain="parts")
    uploads.ingest(_sheets(spark, d, True), base, domain="parts")
    return uploads.live_chunks(spark, base).select("uri", "ordinal", "kind", "text")
