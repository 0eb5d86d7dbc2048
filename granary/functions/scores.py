"""Scores and confidences as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coverage(asked: Column, found: Column) -> Column:
    """Share of the distinct asked tokens that are found; 0 if none is asked."""
    n = F.size(F.array_distinct(asked))
    return F.when(n > 0, F.size(F.array_intersect(asked, found)) / n).otherwise(0.0)


def saturating_overlap(asked: Column, known: Column) -> Column:
    """The better of coverage and a saturating count of hits."""
    hits = F.size(F.array_intersect(asked, known))
    return F.when(hits > 0, F.greatest(hits / F.size(asked), 1 - F.exp(-hits / 2.5))).otherwise(0.0)


def declared_match(asked: Column, examples: Column, keywords: Column, description: Column) -> Column:
    """Overlap with a declaration's words: examples weigh most, and a tight keyword list adds to it."""
    dense = F.size(F.array_intersect(asked, keywords)) / F.greatest(F.size(keywords), F.lit(1))
    return F.least(0.45 * saturating_overlap(asked, examples) + 0.35 * saturating_overlap(asked, keywords) + 0.20 * saturating_overlap(asked, description) + 0.15 * dense, F.lit(1.0))


def scope_match(detected: Column, declared: Column) -> Column:
    """The better of the shares of detected and of declared entities that both have."""
    both = F.size(F.array_intersect(declared, detected))
    return F.when(both > 0, F.greatest(both / F.size(F.array_distinct(detected)), both / F.size(F.array_distinct(declared)))).otherwise(0.0)


def blended(semantic: Column, lexical: Column, entity: Column) -> Column:
    """Weights .45, .35 and .20 over the signals there are; two of .4 or more move the rest a quarter of the way to 1."""
    have = lambda c, w: F.when(c.isNull(), 0.0).otherwise(w)
    value = (F.coalesce(semantic * 0.45, F.lit(0.0)) + lexical * 0.35 + F.coalesce(entity * 0.20, F.lit(0.0))) / (have(semantic, 0.45) + F.lit(0.35) + have(entity, 0.20))
    strong = sum(F.coalesce((c >= 0.4).cast("int"), F.lit(0)) for c in (semantic, lexical, entity))
    return F.least(F.when(strong >= 2, value + 0.25 * (1 - value)).otherwise(value), F.lit(1.0))


# Weights of the semantic, lexical and entity signals.
HYBRID = (0.55, 0.30, 0.15)


def hybrid(semantic: Column, lexical: Column, entity: Column) -> Column:
    """Fixed weights, whether or not a signal is there."""
    return 0.55 * F.coalesce(semantic, F.lit(0.0)) + 0.30 * F.coalesce(lexical, F.lit(0.0)) + 0.15 * F.coalesce(entity, F.lit(0.0))


def margin_confidence(best: Column, runner_up: Column) -> Column:
    margin = F.greatest(F.lit(0.0), (best - runner_up) / best)
    return F.when(best <= 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.least(best, F.lit(1.0)) * (0.65 + 0.35 * margin)), 4))


def evidence_confidence(top: Column, chunks: Column) -> Column:
    return F.when(F.coalesce(chunks, F.lit(0)) == 0, 0.25).otherwise(F.round(F.least(F.lit(0.9), 0.3 + 0.45 * F.least(top, F.lit(1.0)) + 0.15 * F.least(chunks, F.lit(4)) / 4), 4))


def calibrated(raw: Column, slope: Column, bias: Column, fitted: Column) -> Column:
    """Platt scaling where a fit was accepted, else a pull of two fifths towards one half."""
    p = F.least(F.greatest(raw, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.round(F.when(fitted, 1 / (1 + F.exp(-(slope * F.log(p / (1 - p)) + bias)))).otherwise(0.5 + (raw - 0.5) * 0.6), 6)


def nearest_rank(values: Column, share: float) -> Column:
    """The value at round-half-even(share * n + .5), three places; values is an array."""
    at = F.greatest(F.lit(0), F.least(F.size(values) - 1, F.bround(share * F.size(values) + F.lit(0.5), 0).cast("int") - 1))
    return F.when(F.size(values) == 0, 0.0).otherwise(F.round(F.get(F.array_sort(values), at), 3))


def call_cost(prompt: Column, completion: Column, per_1k_in: Column, per_1k_out: Column) -> Column:
    return F.round(prompt / 1000 * per_1k_in + completion / 1000 * per_1k_out, 10)


def cosine(a: Column, b: Column) -> Column:
    """Over the length both have; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    p, q = F.slice(a, 1, F.greatest(n, F.lit(1))), F.slice(b, 1, F.greatest(n, F.lit(1)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")))
    norms = F.sqrt(total(F.transform(p, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(q, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((n > 0) & (norms > 0), dot / norms).otherwise(0.0)
