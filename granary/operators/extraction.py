"""Answers from the sentences that were found: prose, and objects of any output schema as Column expressions.

A schema is a dict of the JSON-schema kind, {"properties": {name: {"type": ..., "enum": [...]}}}. It is read once, on the
driver, and compiled to one expression for each field, so filling it costs no Python and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text

# What is said without a sentence, fields that hold the confidence, and what a number looks like in a text.
NOTHING_FOUND = "No supporting passage in the retrieved context addresses this question."
CONFIDENCE_FIELDS = ["confidence", "certainty", "score"]
NUMBER = r"-?[0-9][0-9.,]*"


def prose(sentences: Column) -> Column:
    """The sentences, each with one point at its end, or what is said if there is none."""
    ended = F.transform(sentences, lambda s: F.concat(F.regexp_replace(s, r"\.+$", ""), F.lit(".")))
    return F.when(F.size(sentences) > 0, F.array_join(ended, " ")).otherwise(NOTHING_FOUND)


def occurrences(hay: Column, needle: str) -> Column:
    """How often needle stands in hay, without overlaps; an empty one stands between any two characters."""
    if not needle:
        return F.length(hay) + 1
    return ((F.length(hay) - F.length(F.replace(hay, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def closest_choice(choices: list, sentences: Column) -> Column:
    """The choice that occurs most often, the first of equals, and the first of all if none occurs."""
    hay = F.lower(F.array_join(sentences, " "))
    values = choices if len({type(c) for c in choices}) == 1 else [str(c) for c in choices]
    ranked = [F.struct(occurrences(hay, str(c).lower()).alias("hits"), F.lit(-i).alias("place"), F.lit(v).alias("value")) for i, (c, v) in enumerate(zip(choices, values, strict=True))]
    return F.array_max(F.array(*ranked))["value"]


def first_number(sentences: Column) -> Column:
    """The first number in the sentences, thousands commas dropped; 0 without one, or where it has several points."""
    found = F.regexp_extract(F.array_join(sentences, " "), NUMBER, 0)
    return F.coalesce(F.replace(found, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def _array(spec: dict, sentences: Column, confidence: Column, deep: bool) -> Column:
    if deep and spec.get("items"):
        return F.transform(sentences, lambda s: _field("", spec["items"], F.array(s), confidence, deep))
    return sentences


def _object(spec: dict, sentences: Column, confidence: Column, deep: bool) -> Column:
    if deep and spec.get("properties"):
        return _filled(spec["properties"], sentences, confidence, deep)
    return F.create_map().cast("map<string,string>")


#: Type of a field: how it is filled from (its definition, sentences, confidence, deep).
FILL: dict[str, Callable[[dict, Column, Column, bool], Column]] = {
    "array": _array,
    "number": lambda spec, sentences, confidence, deep: first_number(sentences),
    "integer": lambda spec, sentences, confidence, deep: first_number(sentences).cast("long"),
    "boolean": lambda spec, sentences, confidence, deep: F.size(sentences) > 0,
    "object": _object,
}


def _field(name: str, spec: dict, sentences: Column, confidence: Column, deep: bool) -> Column:
    if spec.get("enum"):
        return closest_choice(spec["enum"], sentences)
    if name.lower() in CONFIDENCE_FIELDS:
        return confidence
    fill = FILL.get(spec.get("type", "string"))
    return fill(spec, sentences, confidence, deep) if fill else prose(sentences)


def _filled(properties: dict, sentences: Column, confidence: Column, deep: bool) -> Column:
    return F.struct(*[_field(name, spec, sentences, confidence, deep).alias(name) for name, spec in properties.items()])


def structured(schema: dict | None, sentences: Column, confidence: Column, *, deep: bool = False) -> Column:
    """One struct with the schema's fields, of its types; without properties, the prose and the confidence.

    sentences is an array of strings; null counts as empty. An object is left empty and an array holds the sentences, unless
    deep: then an object's own properties are filled, and an array has one item, of the type of `items`, for each sentence.
    """
    sentences = F.coalesce(sentences, F.array().cast("array<string>"))
    properties = (schema or {}).get("properties") or {}
    if not properties:
        return F.struct(prose(sentences).alias("answer"), confidence.alias("confidence"))
    return _filled(properties, sentences, confidence, deep)


def ranked_sentences(blocks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(request_id, place, pos, sentence, score) of blocks (request_id, place, text, tokens): the sentences that have asked tokens.

    tokens are the request's; a block is one of its texts in the order of place. Of sentences with the same first 80
    characters, without regard to case, a request keeps the first. Without asked tokens nothing is kept.
    """
    parts = blocks.select("request_id", "place", "tokens", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))
    hits = F.size(F.array_intersect(text.token_set(F.col("sentence"), text.EXTRACTIVE_STOP_WORDS), F.col("tokens")))
    same = Window.partitionBy("request_id", F.lower(F.substring("sentence", 1, 80))).orderBy("place", "pos")
    scored = parts.withColumn("score", hits / F.size("tokens")).withColumn("first", F.row_number().over(same))
    return scored.where("first = 1 and score > 0").select("request_id", "place", "pos", "sentence", "score")


def evidence(ranked: DataFrame, most: int = 3) -> DataFrame:
    """(request_id, sentences, found, confidence): the best sentences in their order, how many there are, and the confidence in them."""
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "place", "pos"))
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "sentence"))))
    by = ranked.withColumn("rank", rank).groupBy("request_id").agg(best.alias("best"), F.count(F.lit(1)).alias("found"), F.max("score").alias("top"))
    return by.select("request_id", F.transform("best", lambda x: x["sentence"]).alias("sentences"), "found", extractive_confidence(F.col("top"), F.col("found")).alias("confidence"))


def extractive_confidence(top: Column, found: Column) -> Column:
    """How far the best sentence covers what was asked, and how many there are; .1 without any."""
    value = F.least(F.lit(0.95), 0.25 + 0.55 * F.least(top, F.lit(1.0)) + 0.20 * F.least(found, F.lit(5)) / 5)
    return F.when(F.coalesce(found, F.lit(0)) == 0, 0.1).otherwise(F.round(value, 4))


def answer_entities(answers: DataFrame, evidence_entities: DataFrame, first: int = 5) -> DataFrame:
    """(request_id, entities): what an answer produced, then the entities of its first chunks, each once with the confidence of where it first stands.

    answers is (request_id, produced, confidence), evidence_entities (request_id, rank, score, entities). entities is an array
    of (name, confidence).
    """
    own = F.transform("produced", lambda n: F.struct(n.alias("name"), F.col("confidence").alias("confidence")))
    near = evidence_entities.where(F.col("rank") <= first).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.round("score", 4).alias("score"), "entities"))).alias("chunks"))
    both = answers.join(near, "request_id", "left")
    theirs = F.flatten(F.transform(F.coalesce("chunks", F.array().cast(near.schema["chunks"].dataType)), lambda c: F.transform(c["entities"], lambda n: F.struct(n.alias("name"), c["score"].alias("confidence")))))
    all_ = F.concat(own, theirs)
    names = F.transform("all", lambda x: x["name"])
    once = F.filter("all", lambda x, i: F.array_position(F.col("names"), x["name"]) == i + 1)
    return both.withColumn("all", all_).withColumn("names", names).select("request_id", once.alias("entities"))
