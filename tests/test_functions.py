"""Behaviour of scalars and policies on hand-written rows."""

from pyspark.sql import functions as F

from granary.functions import scores, text
from granary.operators import evaluation, policy


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_nearest_rank(spark):
    assert one(spark, scores.nearest_rank(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 100.0])), 0.5)) == 3
    assert one(spark, scores.nearest_rank(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 100.0])), 0.95)) == 100
    assert one(spark, scores.nearest_rank(F.array().cast("array<double>"), 0.95)) == 0


def test_as_number(spark):
    for raw, want in (("R$ 1,234.50", 1234.5), ("12%", None), ("clause 7.2", None), ("", None), ("-3", -3.0)):
        assert one(spark, text.as_number(F.lit(raw))) == want


def test_token_set_drops_stop_words_and_keeps_any_script(spark):
    assert one(spark, text.token_set(F.lit("The λόγος and the café are on"), text.ROUTING_STOP_WORDS)) == ["λόγος", "café"]


def test_numeric_gap(spark):
    assert one(spark, evaluation.numeric_gap(F.lit("about 1,020 or 7"), F.lit(1000.0))) == 0.02
    assert one(spark, evaluation.numeric_gap(F.lit("none"), F.lit(1000.0))) is None


def test_deny_wins_and_claims_veto(spark):
    rows = spark.createDataFrame([("a", "public", []), ("b", "restricted", ["root"]), ("c", "odd", ["root"])], "resource_id string, sensitivity string, claims array<string>")
    rules = [policy.Policy("allow", "allow", 900), policy.Policy("guard", "deny", 1, resources=("sensitivity:confidential",), unless_claims=("nobody",))]
    got = {r.resource_id: r.d.policy_id for r in rows.withColumn("d", policy.decision(rules)).collect()}
    assert got == {"a": "allow", "b": "guard", "c": "allow"}


def test_uncalibrated_confidence_shrinks(spark):
    assert one(spark, scores.calibrated(F.lit(0.9), F.lit(1.0), F.lit(0.0), F.lit(False))) == 0.74


def test_percentages_round_halves_as_the_quotient_does(spark):
    rows = spark.createDataFrame([(438250.0, "87,7%"), (439750.0, "88,0%"), (384750.0, "77,0%"), (1.0, "0,0%"), (None, "n/d")], "x double, want string")
    assert [r[0] for r in rows.where(~text.percent_ptbr(F.col("x"), 1, 500000).eqNullSafe(F.col("want"))).collect()] == []
