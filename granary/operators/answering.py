"""From requests to answers in one plan: gate, governed retrieval, extraction, structure, calibration, entities.

After retrieval there are two shuffles: one brings the texts to what was found, one brings a request's evidence together; the
windows and groups that follow are within a request and need no more. No step goes through the driver but the search, which
broadcasts its queries slice by slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import scores, text

from .extraction import answer_entities, extractive_confidence, ranked_sentences, structured
from .policy import Policy, decision
from .retrieval import context_budget, entities_of, governed, hybrid_search

# Fields of a structured answer that are its text, in this order.
NARRATIVE = ["answer", "finding", "summary", "analysis", "conclusion", "result"]


def narrative(schema: dict, filled: Column) -> Column:
    """The first of the fields that are an answer's text, else of its string fields, that isn't blank."""
    names = list(schema.get("properties", {})) or ["answer"]
    strings = [n for n in names if schema.get("properties", {}).get(n, {}).get("type", "string") == "string"]
    order = [n for n in NARRATIVE if n in strings] + [n for n in strings if n not in NARRATIVE]
    return F.coalesce(*[F.nullif(F.trim(filled[n].cast("string")), F.lit("")) for n in order], F.lit(""))


def raw_confidence(schema: dict, filled: Column, top: Column, chunks: Column) -> Column:
    """What the answer reports of itself, within 0 and 1, else what its evidence says."""
    if "confidence" in schema.get("properties", {"confidence": {}}):
        return F.least(F.greatest(filled["confidence"].cast("double"), F.lit(0.0)), F.lit(1.0))
    return scores.evidence_confidence(top, chunks)


def answered(requests: DataFrame, chunks: DataFrame, *, gates: Sequence[Policy], readers: Sequence[Policy], schema: dict, calibrations: DataFrame, dictionary: list[str], produced: list[str], k: int = 6, oversample: int = 3, budget: int = 1500, sentences: int = 3) -> DataFrame:
    """(request_id, expert_id, status, content, structured, raw_confidence, confidence, calibrated, citations, entities) of every request.

    requests is (request_id, expert_id, text) and what the gates look at; chunks is (id, text) and what the readers look at;
    calibrations is (expert_id, slope, bias, fitted), a row for each expert. A request that a gate denies is skipped, with no
    evidence and a confidence of 0. The evidence is the first k chunks that the readers let through, as long as they fit the
    budget of estimated tokens; the first always does. citations are their ids in order.
    """
    asked = requests.withColumn("_gate", decision(gates)["effect"])
    open_ = asked.where("_gate <> 'deny'")
    found = hybrid_search(open_.select(F.col("request_id").alias("id"), "text"), chunks.select("id", "text"), k=k * oversample, dictionary=dictionary)
    judged = chunks.withColumn("_d", decision(readers)).select("id", F.col("_d.effect").alias("effect"), F.col("_d.policy_id").alias("policy_id"))
    allowed, _ = governed(found, judged, k)
    return _from_evidence(asked, allowed, chunks, schema, calibrations, dictionary, produced, budget, sentences)


def _from_evidence(asked: DataFrame, allowed: DataFrame, chunks: DataFrame, schema: dict, calibrations: DataFrame, dictionary: list[str], produced: list[str], budget: int, sentences: int) -> DataFrame:
    texts = allowed.select(F.col("query_id").alias("request_id"), "id", "score", "rank").join(chunks.select("id", F.col("text").alias("chunk")), "id")
    words = text.token_set(F.col("text"), text.EXTRACTIVE_STOP_WORDS)
    sized = texts.join(asked.select("request_id", words.alias("tokens")), "request_id").withColumn("size", text.token_estimate(F.col("chunk")))
    kept = context_budget(sized, "request_id", "rank", "size", budget)
    ranked = ranked_sentences(kept.select("request_id", F.col("rank").alias("place"), "tokens", F.col("chunk").alias("text")))
    order = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "place", "pos"))
    best = F.array_sort(F.collect_list(F.when(F.col("_order") <= sentences, F.struct("_order", "sentence"))))
    said = ranked.withColumn("_order", order).groupBy("request_id").agg(F.transform(best, lambda x: x["sentence"]).alias("sentences"), F.count(F.lit(1)).alias("found"), F.max("score").alias("best"))
    cited = kept.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("citations"), F.max_by("score", -F.col("rank")).alias("top"), F.count(F.lit(1)).alias("chunks"))
    both = asked.join(cited, "request_id", "left").join(said, "request_id", "left").join(calibrations.select("expert_id", "slope", "bias", "fitted"), "expert_id", "left")
    none = F.array().cast("array<string>")
    extractive = extractive_confidence(F.col("best"), F.col("found"))
    filled = both.withColumn("structured", structured(schema, F.coalesce("sentences", none), extractive))
    raw = raw_confidence(schema, F.col("structured"), F.col("top"), F.col("chunks"))
    done = filled.withColumn("_skip", F.col("_gate") == "deny").withColumn("raw_confidence", F.when(F.col("_skip"), 0.0).otherwise(raw))
    fitted = F.coalesce("fitted", F.lit(False))
    value = scores.calibrated(F.col("raw_confidence"), F.coalesce("slope", F.lit(1.0)), F.coalesce("bias", F.lit(0.0)), fitted)
    done = done.withColumn("confidence", F.when(F.col("_skip"), 0.0).otherwise(value)).withColumn("calibrated", fitted & ~F.col("_skip")).withColumn("produced", F.when(F.col("_skip"), none).otherwise(F.array(*map(F.lit, produced)).cast("array<string>")))
    touched = answer_entities(done.select("request_id", "produced", "confidence"), kept.select("request_id", "rank", "score", entities_of(F.col("chunk"), dictionary).alias("entities")))
    status = F.when(F.col("_skip"), "skipped").otherwise("ok")
    out = done.join(touched, "request_id").withColumn("status", status).withColumn("content", F.when(F.col("_skip"), "").otherwise(narrative(schema, F.col("structured"))))
    return out.select("request_id", "expert_id", "status", "content", "structured", "raw_confidence", "confidence", "calibrated", F.coalesce("citations", F.array().cast(kept.select(F.array("id").alias("x")).schema["x"].dataType)).alias("citations"), "entities")
