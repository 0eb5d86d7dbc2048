"""Training-set preparation: validation cascade, quality score, stable split, persistence without duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text

# What a refusal contains.
REFUSALS = ["i cannot", "i can't", "as an ai", "i am unable", "não posso", "i do not have enough", "insufficient information"]


def with_identity(examples: DataFrame) -> DataFrame:
    return examples.withColumn("content_hash", text.example_hash(F.col("prompt"), F.col("completion")))


def reviewed(examples: DataFrame, *, least: int = 4, most: int = 400) -> DataFrame:
    """Each example with status and reject_reason; the first reason that holds counts, and of equal hashes the first id stays."""
    n = F.size(text.words(F.col("completion")))
    order = F.row_number().over(Window.partitionBy("content_hash").orderBy("id"))
    low = F.lower("completion")
    refused = F.lit(False)
    for marker in REFUSALS:
        refused = refused | F.contains(low, F.lit(marker))
    reason = F.when(F.col("seen") > 1, "duplicate").when(n < least, "short").when(n > most, "long").when(F.lower(F.trim("prompt")) == F.lower(F.trim("completion")), "restates").when(refused, "refusal").otherwise("")
    out = with_identity(examples).withColumn("seen", order).withColumn("reject_reason", reason)
    return out.drop("seen").withColumn("status", F.when(F.col("reject_reason") == "", "accepted").otherwise("rejected"))


def quality(reasoning: Column, entities: Column, completion: Column, vocabulary: list[str]) -> Column:
    own = F.transform(text.words(F.lower(completion)), lambda w: F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", ""))
    score = F.lit(0.5) + F.when(F.size(text.words(reasoning)) > 10, 0.2).otherwise(0.0) + F.when(F.size(entities) > 0, 0.15).otherwise(0.0) + F.when(F.arrays_overlap(own, F.array(*map(F.lit, vocabulary))), 0.15).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 4)


def split_of(digest: Column, eval_share: float = 0.2) -> Column:
    return F.when(text.hash_bucket(digest) < int(eval_share * 1000), "eval").otherwise("train")


def persist_new(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the batch whose hash isn't stored yet; of equal hashes the first id."""
    first = batch.withColumn("rn", F.row_number().over(Window.partitionBy("content_hash").orderBy("id"))).where("rn = 1").drop("rn")
    return first.join(stored.select("content_hash"), "content_hash", "left_anti")
