"""Answers of several experts: verification, conflicts, arbitration, and what goes into the composed reply.

Answers are (request_id, answer_id, expert_id, domain, confidence, calibrated, ...); structured fields are rows of
(request_id, answer_id, expert_id, field, value). Nulls: a missing value never conflicts, a missing confidence counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import as_number

# Fields whose strings are verdicts.
VERDICT_FIELDS = """
verdict compliant enforceable approved valid permitted recommendation decision risk_level severity status outcome
conclusion eligible acceptable
""".split()

# Opposite verdicts.
OPPOSITES = [("compliant", "non-compliant"), ("enforceable", "unenforceable"), ("valid", "invalid"), ("permitted", "prohibited"), ("approved", "rejected"), ("sim", "não"), ("yes", "no"), ("true", "false")]


def incompatible(field: Column, a: Column, b: Column, x: Column, y: Column, tolerance: float = 0.02) -> Column:
    """The kind of disagreement of two strings, or null: numbers by relative difference, words if they are verdicts or opposites. x and y are the strings as numbers, read once for each string and not for each pair."""
    numeric = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-9)) > tolerance
    p, q = F.lower(F.trim(a)), F.lower(F.trim(b))
    opposite = (p == F.concat(F.lit("not "), q)) | (q == F.concat(F.lit("not "), p))
    for one, other in OPPOSITES:
        opposite = opposite | ((p == one) & (q == other)) | ((p == other) & (q == one))
    verdict = (p != q) & (F.lower(field).isin(VERDICT_FIELDS) | opposite)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(numeric, "numeric_disagreement")).when(verdict, "verdict_disagreement")


# Fields that say how an answer came about.
NOT_COMPARED = ["confidence", "citations", "sources", "reasoning"]


def conflicts(fields: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(request_id, field, first, second, kind): pairs of a request's answers whose values of a field disagree.

    fields is of answers that are usable; what says how an answer came about isn't compared. Distinct values meet, not answers, so many equal answers cost one comparison; the first answer of each stands for it.
    """
    value = F.trim("value")
    stated = fields.where(value.isNotNull() & (value != "") & ~F.col("field").isin(NOT_COMPARED)).groupBy("request_id", "field", "value").agg(F.min("answer_id").alias("answer_id")).withColumn("number", as_number(F.col("value")))
    other = stated.select("request_id", "field", F.col("value").alias("value2"), F.col("answer_id").alias("second"), F.col("number").alias("number2"))
    pairs = stated.join(other, ["request_id", "field"]).where("answer_id < second").withColumn("kind", incompatible(F.col("field"), F.col("value"), F.col("value2"), F.col("number"), F.col("number2"), tolerance))
    return pairs.where("kind is not null").select("request_id", "field", F.col("answer_id").alias("first"), "second", "kind")


def stance_conflicts(answers: DataFrame) -> DataFrame:
    """(request_id, topic, positive, negative): the first answer that only affirms a topic and the first that only denies it."""
    text = F.lower(F.coalesce("content", F.lit("")))
    said = lambda w: text.rlike(rf"\b{w}\b")
    stances = F.array(*[F.struct(F.lit(a).alias("topic"), F.when(said(a) & ~said(b), 1).when(said(b) & ~said(a), -1).alias("sign")) for a, b in OPPOSITES])
    rows = answers.select("request_id", "answer_id", F.explode(F.filter(stances, lambda s: s["sign"].isNotNull())).alias("s"))
    sides = rows.groupBy("request_id", F.col("s.topic").alias("topic")).agg(F.min(F.when(F.col("s.sign") > 0, F.col("answer_id"))).alias("positive"), F.min(F.when(F.col("s.sign") < 0, F.col("answer_id"))).alias("negative"))
    return sides.where("positive is not null and negative is not null")


def resolutions(pairs: DataFrame, answers: DataFrame, margin: float = 0.15, min_gap: float = 0.1) -> DataFrame:
    """The pairs (request_id, first, second, ...) with strategy and winner; both null where no strategy decides.

    answers has (answer_id, confidence, calibrated, passed, authority), one row each. In order: the one that passes
    verification where the other fails; the calibrated one that leads by margin; the one of more authority by min_gap.
    """
    side = lambda name, n: answers.select(F.col("answer_id").alias(name), *[F.col(c).alias(f"{c}{n}") for c in ("calibrated", "passed", "authority")], F.coalesce("confidence", F.lit(0.0)).alias(f"confidence{n}"))
    both = pairs.join(side("first", 1), "first").join(side("second", 2), "second")
    lead = F.round(F.col("confidence1") - F.col("confidence2"), 9)
    rank = F.round(F.col("authority1") - F.col("authority2"), 9)
    one, two = F.lit(1), F.lit(2)
    verified = F.when(F.col("passed1") & ~F.col("passed2"), one).when(F.col("passed2") & ~F.col("passed1"), two)
    confident = F.when((lead >= margin) & F.col("calibrated1"), one).when((lead <= -margin) & F.col("calibrated2"), two)
    senior = F.when(rank >= min_gap, one).when(rank <= -min_gap, two)
    won = F.coalesce(verified, confident, senior)
    strategy = F.when(verified.isNotNull(), "verifier").when(confident.isNotNull(), "confidence").when(senior.isNotNull(), "authority")
    return both.select(*pairs.columns, strategy.alias("strategy"), F.when(won == 1, F.col("first")).when(won == 2, F.col("second")).alias("winner"))


def contributions(answers: DataFrame, lost: DataFrame) -> DataFrame:
    """answers (…, authority, passed) with accepted and weight: confidence times authority (.5 if unknown), two fifths of it if verification failed."""
    weight = F.coalesce("confidence", F.lit(0.0)) * F.coalesce("authority", F.lit(0.5)) * F.when(F.col("passed"), 1.0).otherwise(0.4)
    gone = lost.select("answer_id").distinct().withColumn("superseded", F.lit(True))
    return answers.join(gone, "answer_id", "left").withColumn("accepted", F.col("superseded").isNull()).drop("superseded").withColumn("weight", F.round(weight, 6))


def verified(answers: DataFrame, rules: list[dict]) -> DataFrame:
    """answers with violated (ids of rules in order) and passed (no rule of severity error is violated).

    answers has confidence, content, citations (a count) and structured (map of strings). An unknown rule is violated as
    a warning.
    """
    found, errors = [], []
    for rule in rules:
        bad = F.coalesce(_violates(rule), F.lit(False))
        severity = rule.get("severity", "error") if rule["type"] in RULES else "warning"
        found.append(F.when(bad, rule["id"]))
        errors.append(bad & F.lit(severity == "error"))
    failed = F.lit(False)
    for bad in errors:
        failed = failed | bad
    return answers.withColumn("violated", F.array_compact(F.array(*found))).withColumn("passed", ~failed)


def _number(field: str) -> Column:
    return as_number(F.try_element_at("structured", F.lit(field)))


def _required(r: dict) -> Column:
    return F.exists(F.array(*map(F.lit, r["fields"])), lambda f: F.coalesce(F.try_element_at("structured", f), F.lit("")) == "")


def _range(r: dict) -> Column:
    bad = F.lit(False)
    for f in r["fields"]:
        low = _number(f) < r["minimum"] if r.get("minimum") is not None else F.lit(False)
        high = _number(f) > r["maximum"] if r.get("maximum") is not None else F.lit(False)
        bad = bad | F.coalesce(low | high, F.lit(False))
    return bad


def _sum(r: dict) -> Column:
    if len(r["fields"]) < 2:
        return F.lit(False)
    parts = sum((_number(f) for f in r["fields"][1:]), F.lit(0.0))
    return F.abs(_number(r["fields"][0]) - parts) > F.greatest(F.lit(float(r["tolerance"])), F.abs(parts) * r["tolerance"])


def _forbidden(r: dict) -> Column:
    hay = F.lower(F.concat_ws(" ", "content", F.concat_ws(" ", F.map_values("structured"))))
    return F.exists(F.array(*[F.lit(t.lower()) for t in r["terms"]]), lambda t: F.contains(hay, t))


def _pattern(r: dict) -> Column:
    targets = F.array(*[F.coalesce(F.try_element_at("structured", F.lit(f)), F.lit("")) for f in r["fields"]]) if r.get("fields") else F.array(F.coalesce("content", F.lit("")))
    return ~F.exists(targets, lambda t: F.rlike(t, F.lit("(?i)" + r["pattern"])))


RULES = {
    "required_fields": _required,
    "requires_citation": lambda r: F.coalesce("citations", F.lit(0)) == 0,
    "numeric_range": _range,
    "numeric_consistency": _sum,
    "forbidden_terms": _forbidden,
    "regex_match": _pattern,
    "min_confidence": lambda r: F.coalesce("confidence", F.lit(0.0)) < (0.4 if r.get("minimum") is None else r["minimum"]),
}


def _violates(rule: dict) -> Column:
    return RULES[rule["type"]](rule) if rule["type"] in RULES else F.lit(True)


def weighed_mean() -> Column:
    """The mean confidence of a group of accepted answers by weight."""
    w = F.greatest("weight", F.lit(1e-6))
    return F.sum(w * F.coalesce("confidence", F.lit(0.0))) / F.sum(w)


def with_conflicts(mean: Column, open_: Column) -> Column:
    """A mean less a fifth for each open conflict, half of it at most."""
    return F.round(mean * F.greatest(F.lit(0.5), 1 - 0.2 * open_), 4)


def reply_confidence(parts: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(request_id, confidence): the mean over accepted answers by weight, less a fifth for each open conflict, half of it at most."""
    mean = parts.where("accepted").groupBy("request_id").agg(weighed_mean().alias("mean"))
    open_ = unresolved.groupBy("request_id").agg(F.count(F.lit(1)).alias("open"))
    return mean.join(open_, "request_id", "left").select("request_id", with_conflicts(F.col("mean"), F.coalesce("open", F.lit(0))).alias("confidence"))


def best_citations(cited: DataFrame) -> DataFrame:
    """cited (request_id, chunk_id, score, position) with one row for each chunk of a request: its best score, the first of equals."""
    w = Window.partitionBy("request_id", "chunk_id").orderBy(F.desc("score"), "position")
    return cited.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
