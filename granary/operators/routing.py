"""Requests against declared capabilities, plans of them, sentences that answer, and feedback to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import scores, text

from .registry import plan_confidence
from .retrieval import hybrid_search

#: Declared capabilities that are broadcast to the requests at most; more are joined on what they share with them.
BROADCAST_CAPABILITIES = 10_000
CAPABILITY = "capability_id string, expert_id string, domain string, keywords array<string>, examples array<string>, description string, operates_on array<string>"


def _paired(asked: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """Requests with capabilities: all pairs while the capabilities are few and broadcast, else those that share a word or an entity."""
    if own.count() <= most:
        return asked.crossJoin(F.broadcast(own))
    shared = lambda c: F.explode(F.array_distinct(F.concat(F.transform(c[0], lambda x: F.concat(F.lit("w:"), x)), F.transform(c[1], lambda x: F.concat(F.lit("e:"), x))))).alias("_key")
    words = F.array_union(F.array_union("k", "e"), F.col("d"))
    pairs = asked.select("request_id", shared((F.col("asked"), F.col("entities")))).join(own.select("capability_id", shared((words, F.col("operates_on")))), "_key").select("request_id", "capability_id").distinct()
    return pairs.join(asked, "request_id").join(own, "capability_id")


def matches(requests: DataFrame, capabilities: list[tuple] | DataFrame, domain_scores: dict[str, float] | None = None, *, embedded: bool = False, most: int = BROADCAST_CAPABILITIES) -> DataFrame:
    """(request_id, capability_id, expert_id, domain, semantic, lexical, entity, score) of requests and capabilities.

    requests is (request_id, text, entities), ids once each; capabilities are (id, expert, domain, keywords, examples,
    description, operates_on). A request without entities is judged without them; a null text has no words. embedded adds the
    cosine of the two texts, negative ones as 0: every candidate is scored, so one that is far from the request is weighed as
    such (it is not left out of a list of the best of the whole graph). Without it semantic is null, and not weighed.
    With up to `most` capabilities every pair has a row; with more only pairs that share a word or an entity have one.
    """
    stop = text.ROUTING_STOP_WORDS
    given = capabilities if isinstance(capabilities, DataFrame) else requests.sparkSession.createDataFrame(capabilities, CAPABILITY)
    own = given.select(
        "capability_id", "expert_id", "domain", "operates_on", text.token_set(F.array_join("keywords", " "), stop).alias("k"), text.token_set(F.array_join("examples", " "), stop).alias("e"),
        text.token_set(F.concat_ws(" ", F.translate("capability_id", "_", " "), "description"), stop).alias("d"),
    )
    both = _paired(requests.withColumn("asked", text.token_set(F.col("text"), stop)), own, most)
    semantic = F.lit(None).cast("double")
    if embedded:
        said = F.concat_ws(" ", F.translate("capability_id", "_", " "), "description", F.array_join("keywords", " "), F.array_join("examples", " "))
        near = hybrid_search(requests.select(F.col("request_id").alias("id"), "text"), given.select(F.col("capability_id").alias("id"), said.alias("text")), k=max(1, given.count()), weights=(1.0, 0.0, 0.0))
        both = both.join(near.select(F.col("query_id").alias("request_id"), F.col("id").alias("capability_id"), F.col("score").alias("near")), ["request_id", "capability_id"], "left")
        semantic = F.coalesce("near", F.lit(0.0))
    entity = F.when(F.size("entities") > 0, scores.scope_match(F.col("entities"), F.col("operates_on")))
    both = both.withColumn("lexical", scores.declared_match(F.col("asked"), F.col("e"), F.col("k"), F.col("d"))).withColumn("entity", entity).withColumn("semantic", semantic)
    weight = F.lit(1.0)
    if domain_scores:
        known = F.create_map(*(F.lit(x) for pair in domain_scores.items() for x in pair))
        weight = 0.6 + 0.4 * F.coalesce(F.try_element_at(known, F.col("domain")), F.lit(0.0))
    score = scores.blended(F.col("semantic"), F.col("lexical"), F.col("entity")) * weight
    return both.select("request_id", "capability_id", "expert_id", "domain", F.round("semantic", 6).alias("semantic"), F.round("lexical", 6).alias("lexical"), F.round("entity", 6).alias("entity"), F.round(F.least(score, F.lit(1.0)), 6).alias("score"))


def best_matches(found: DataFrame, k: int = 8) -> DataFrame:
    """The k best capabilities of each request with their rank; ties by capability_id."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "capability_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def planned(found: DataFrame, *, threshold: float = 0.2, band: float = 0.55, most: int = 8) -> DataFrame:
    """(request_id, expert_id, capability_id, score, step): each expert's best capability, if it is near enough to the request's best."""
    best = F.max("score").over(Window.partitionBy("request_id"))
    near = found.where(F.col("score") >= threshold).withColumn("best", best).where(F.col("score") >= F.greatest(F.lit(threshold), F.col("best") * band))
    own = Window.partitionBy("request_id", "expert_id").orderBy(F.desc("score"), "capability_id")
    step = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "capability_id"))
    one = near.withColumn("at", F.row_number().over(own)).where("at = 1").withColumn("step", step)
    return one.where(F.col("step") <= most).select("request_id", "expert_id", "capability_id", "score", "step")


def ranked_sentences(docs: DataFrame, asked: list[str]) -> DataFrame:
    """(id, pos, sentence, score, rank) of docs (id, text), for asked words without stop words: a document's sentences that have asked words, the first of those with the same 80 characters."""
    parts = docs.select("id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))
    first = F.row_number().over(Window.partitionBy("id", F.lower(F.substring("sentence", 1, 80))).orderBy("pos"))
    hits = F.size(F.array_intersect(text.token_set(F.col("sentence"), text.EXTRACTIVE_STOP_WORDS), F.array(*map(F.lit, asked))))
    kept = parts.withColumn("first", first).where("first = 1").withColumn("score", hits / len(set(asked))).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos"))
    return kept.select("id", "pos", "sentence", "score", rank.alias("rank"))


def extracted(docs: DataFrame, asked: list[str]) -> DataFrame:
    """(id, found, best, confidence) of every document; without a sentence that answers, best is 0 and the confidence .1."""
    some = ranked_sentences(docs, asked).groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.max("score").alias("best"))
    value = F.least(F.lit(0.95), 0.25 + 0.55 * F.least(F.col("best"), F.lit(1.0)) + 0.20 * F.least(F.col("found"), F.lit(5)) / 5)
    out = docs.select("id").join(some, "id", "left")
    return out.select("id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("best", F.lit(0.0)).alias("best"), F.when(F.col("found").isNull(), 0.1).otherwise(F.round(value, 4)).alias("confidence"))


def feedback_prompts(answers: DataFrame, least: float) -> DataFrame:
    """(id, kind, prompt, completion, status): escalated answers and those scored below least; without a label the status is needs_answer."""
    up = answers.where("used_fallback").withColumn("kind", F.lit("escalation"))
    low = answers.where(~F.col("used_fallback") & (F.col("score") < least)).withColumn("kind", F.lit("failure"))
    status = F.when(F.coalesce("label", F.lit("")) == "", "needs_answer").otherwise("pending")
    return up.unionByName(low).select("id", "kind", "prompt", F.coalesce("label", F.lit("")).alias("completion"), status.alias("status"))


# What reinforces a domain, how near to the best a domain must be, and when a request is planned or escalated.
ENTITY_BONUS, DESCRIPTION_BONUS, NEAR, LEAST_SCORE = 0.15, 0.2, 0.6, 0.12
PLAN_BELOW, ESCALATE_BELOW = 0.35, 0.55
MARKERS = ["and then", "then", "after that", "as well as", "compare", "both", "also", "e depois", "então", "além disso", "ambos", "também"]


def domain_scores(found: DataFrame, entities: DataFrame, described: DataFrame) -> DataFrame:
    """(request_id, domain, score): a domain's best capability, reinforced by its entities in the request and by its description.

    found is (request_id, domain, score) of capabilities, entities (request_id, domain) a row for each entity of a domain,
    described (request_id, domain, share) the share of the request's tokens that a domain's description has. Domains without
    any of these have no row, and count as 0.
    """
    keys = ["request_id", "domain"]
    best = found.groupBy(*keys).agg(F.max("score").alias("score"))
    counts = entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    all_ = best.join(counts, keys, "full").join(described.select(*keys, "share"), keys, "full")
    filled = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    reinforced = F.least(F.lit(1.0), filled("score") + ENTITY_BONUS * filled("n"))
    return all_.select(*keys, F.least(F.lit(1.0), reinforced + DESCRIPTION_BONUS * filled("share")).alias("score"))


def classified(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """(request_id, domains, confidence) of each request: the domains near its best score, joined by commas from the best, ties by name; none and 0 if nothing matches."""
    own = Window.partitionBy("request_id")
    place = F.row_number().over(own.orderBy(F.desc("score"), "domain"))
    ranked = scored.withColumn("best", F.max("score").over(own)).withColumn("place", place).where("best > 0")
    near = F.when(F.col("score") >= F.greatest(F.col("best") * NEAR, F.lit(LEAST_SCORE)), F.struct("place", "domain"))
    by = ranked.groupBy("request_id").agg(F.max("best").alias("best"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.sort_array(F.collect_list(near)).alias("near"))
    named = by.select("request_id", F.array_join(F.transform("near", lambda x: x["domain"]), ",").alias("domains"), scores.margin_confidence(F.col("best"), F.col("second")).alias("confidence"))
    return requests.select("request_id").join(named, "request_id", "left").select("request_id", F.coalesce("domains", F.lit("")).alias("domains"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def should_plan(text_col: Column, domains: Column, outputs: Column, confidence: Column) -> Column:
    """Whether a request spans domains, reads as several, wants several outputs, or is not understood."""
    words = "|".join(MARKERS)
    several = F.coalesce(text_col, F.lit("")).rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})([^\p{{L}}\p{{N}}_]|$)")
    return F.contains(domains, F.lit(",")) | several | (outputs > 1) | (confidence < PLAN_BELOW)


def escalation(requests: DataFrame, steps: DataFrame, threshold: float = ESCALATE_BELOW) -> DataFrame:
    """(request_id, subtasks, confidence, reason): why a request goes to the single orchestrator task, null where it doesn't.

    steps is (request_id, confidence, matched, classification), as for registry.plan_confidence, whose value decides.
    """
    by = steps.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("hits"))
    sure = plan_confidence(steps.withColumnRenamed("request_id", "plan_id")).withColumnRenamed("plan_id", "request_id")
    out = requests.select("request_id").join(by.join(sure, "request_id"), "request_id", "left").select("request_id", F.coalesce("n", F.lit(0)).alias("subtasks"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    low = F.format_string(f"routing confidence %.2f is below the {threshold:.2f} threshold", "confidence")
    reason = F.when(F.col("subtasks") == 0, "no capability in the graph covers this request").when(F.col("hits") == 0, "no subtask matched a declared capability").when(F.col("confidence") < threshold, low)
    return out.withColumn("reason", reason).drop("hits")
