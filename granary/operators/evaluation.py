"""Graders, six-metric roll-ups, verdicts, calibration, drift and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text

# The metrics that decide, and those of them of which less is better.
METRICS = ["domain accuracy", "cost per query", "latency p95 (ms)", "fallback rate", "consistency", "auditability"]
LOWER_IS_BETTER = ["cost per query", "latency p95 (ms)"]
DECIDING = ["domain accuracy", "cost per query", "latency p95 (ms)", "consistency", "auditability"]


def keyword_score(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that stand anywhere in the answer; both are normalised."""
    hay = text.normalised(answer)
    hits = F.size(F.filter(keywords, lambda k: F.contains(hay, text.normalised(k))))
    return F.when(F.size(keywords) > 0, F.round(hits / F.size(keywords), 4)).otherwise(0.0)


def numeric_gap(answer: Column, expected: Column) -> Column:
    """Relative distance of the number nearest to the expected one; null without any."""
    found = F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(answer, F.lit("")), ",", ""), F.lit(r"-?\d+(?:\.\d+)?"), 0), lambda x: F.abs(x.cast("double") - expected))
    return F.array_min(found) / F.greatest(F.abs(expected), F.lit(1e-9))


def consistency(score: Column) -> Column:
    """1 less twice the population deviation, 0 at least; 1 for fewer than two scores."""
    return F.when(F.count(score) < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.stddev_pop(score) / 0.5, F.lit(1.0))))


def with_nearest_ranks(grouped: DataFrame, rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """grouped, one row for each group, with the nearest-rank value of each share as scores.nearest_rank gives it.

    Ranks come from counts of distinct values, so no group's values meet in one task: running sums go over bands of values
    of nearly equal size (1 / 4096 of a doubling), then over the values of just the bands that hold a rank.
    """
    d = F.col(value).cast("double")
    size = F.floor(F.least(F.log2(F.abs(d)), F.lit(1100.0)) * 4096) + (1 << 23)
    band = F.when(F.isnan(d), F.lit(1 << 40)).when(d > 0, size).when(d < 0, -size).otherwise(0)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, band.alias("_band"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*by)
    bands = counts.groupBy(*by, "_band").agg(F.sum("_n").alias("_m"))
    bands = bands.withColumn("_upto", F.sum("_m").over(own.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_m").over(own))
    at = lambda share: F.greatest(F.lit(0), F.least(F.col("_all") - 1, F.bround(share * F.col("_all") + F.lit(0.5), 0).cast("long") - 1))
    within = lambda share, upto, n: (at(share) >= upto - n) & (at(share) < upto)
    held = F.lit(False)
    for share in shares.values():
        held = held | within(share, F.col("_upto"), F.col("_m"))
    names = [f"_by{i}" for i in range(len(by))]
    same = lambda: [F.col(f"`{b}`").eqNullSafe(F.col(n)) for b, n in zip(by, names, strict=True)]
    picked = bands.where(held).select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.col("_band").alias("_b"), (F.col("_upto") - F.col("_m")).alias("_before"), "_all")
    inside = counts.join(picked, [*same(), F.col("_band") == F.col("_b")])
    run = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = inside.withColumn("_run", run).groupBy(*names).agg(*(F.max(F.when(within(share, F.col("_run"), F.col("_n")), F.col("_v"))).alias(f"_{name}") for name, share in shares.items()))
    both = grouped.join(ranks, same() or F.lit(True), "left")
    return both.select(*grouped.columns, *(F.when(F.col(f"_{n}").isNull(), 0.0).otherwise(F.round(f"_{n}", 3)).alias(n) for n in shares))


def metrics(results: DataFrame, *by: str) -> DataFrame:
    """The six metrics and their parts for each group; errors count in all denominators but that of consistency."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    out = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.round(share("correct"), 4).alias("accuracy"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.sum("cost_usd"), 8).alias("cost_total"), F.round(F.avg("cost_usd"), 8).alias("cost_mean"),
        F.round(F.avg("latency_ms"), 3).alias("latency_mean"), F.round(share("used_fallback"), 4).alias("fallback_rate"),
        F.round(consistency(F.when(~F.col("errored"), F.col("score"))), 4).alias("consistency"), F.round(share("trace_complete"), 4).alias("auditability"), F.round(F.avg("tokens"), 2).alias("tokens_per_query"), F.count_if("errored").alias("errors"),
    )
    at = out.columns.index("latency_mean") + 1
    order = [*out.columns[:at], "latency_p50", "latency_p95", *out.columns[at:]]
    return with_nearest_ranks(out, results, list(by), "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95}).select(*order)


def compare(arms: DataFrame, one: str = "federation", other: str = "baseline") -> DataFrame:
    """(metric, one, other, delta, won): won is null for a metric that doesn't decide; ties count as won."""
    columns = dict(zip(METRICS, ("accuracy", "cost_mean", "latency_p95", "fallback_rate", "consistency", "auditability"), strict=True))
    long = arms.select("arm", *(F.col(c).cast("double").alias(m) for m, c in columns.items())).unpivot("arm", METRICS, "metric", "value")
    both = long.groupBy("metric").agg(F.max(F.when(F.col("arm") == one, F.col("value"))).alias("one"), F.max(F.when(F.col("arm") == other, F.col("value"))).alias("other"))
    won = F.when(~F.col("metric").isin(DECIDING), None).when(F.col("metric").isin(LOWER_IS_BETTER), F.col("one") <= F.col("other")).otherwise(F.col("one") >= F.col("other"))
    return both.select("metric", "one", "other", F.round(F.col("one") - F.col("other"), 8).alias("delta"), won.alias("won"))


def verdict(comparison: DataFrame) -> DataFrame:
    """One row: the first arm wins if it holds accuracy and loses one deciding metric at most."""
    held = F.coalesce(F.bool_or((F.col("metric") == "domain accuracy") & F.col("won")), F.lit(False))
    count = comparison.agg(held.alias("held"), F.count_if("won").alias("won"), F.count("won").alias("total"))
    return count.select("won", "total", F.when(F.col("held") & (F.col("won") >= F.col("total") - 1), "federation").when(~F.col("held"), "baseline").otherwise("inconclusive").alias("verdict"))


def snapshots(answers: DataFrame, *by: str) -> DataFrame:
    """Metric snapshots of each expert and window; accuracy is what didn't fall back."""
    fallback = F.avg(F.col("used_fallback").cast("int"))
    out = answers.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_count"), F.round(1 - fallback, 6).alias("accuracy"), F.round(fallback, 6).alias("fallback_rate"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return with_nearest_ranks(out, answers, list(by), "latency_ms", {"p95_latency_ms": 0.95}).select(*by, "sample_count", "accuracy", "fallback_rate", "p95_latency_ms", "mean_confidence")


def drift(history: DataFrame, expert: str, at: str, *, lookback: int = 10, min_samples: int = 20, accuracy_drop: float = 0.05, fallback_rise: float = 0.10, latency_ratio: float = 0.5) -> DataFrame:
    """The newest snapshot of each expert against the mean of up to lookback before it."""
    order = Window.partitionBy(expert).orderBy(F.desc(at))
    before = order.rowsBetween(1, lookback)
    mean = lambda c: F.avg(c).over(before)
    d = history.withColumn("rn", F.row_number().over(order)).withColumn("before", F.count(F.lit(1)).over(before)).withColumn("baseline_samples", F.coalesce(F.sum("sample_count").over(before), F.lit(0)))
    d = d.withColumn("accuracy_delta", F.round(F.col("accuracy") - mean("accuracy"), 4)).withColumn("fallback_delta", F.round(F.col("fallback_rate") - mean("fallback_rate"), 4)).withColumn("latency_base", mean("p95_latency_ms"))
    d = d.withColumn("latency_delta_ms", F.round(F.col("p95_latency_ms") - F.col("latency_base"), 3)).where("rn = 1")
    judged = (F.col("before") >= 1) & (F.col("sample_count") >= min_samples) & (F.col("baseline_samples") >= min_samples)
    reasons = F.array_compact(F.array(F.when(F.col("accuracy_delta") <= -accuracy_drop, "accuracy"), F.when(F.col("fallback_delta") >= fallback_rise, "fallback"), F.when((F.col("latency_base") > 0) & (F.col("latency_delta_ms") / F.col("latency_base") >= latency_ratio), "latency")))
    keep = lambda c: F.when(judged, F.col(c)).otherwise(0.0).alias(c)
    flagged = F.when(judged, F.array_join(reasons, ",")).otherwise("")
    return d.select(expert, F.col("sample_count").alias("recent_samples"), "baseline_samples", keep("accuracy_delta"), keep("fallback_delta"), keep("latency_delta_ms"), judged.alias("judged"), flagged.alias("reasons"), (flagged != "").alias("drifted"))


def audit_summary(log: DataFrame, hours: int) -> DataFrame:
    """(expert, allow, deny, total, allowed, denied, deny_rate) of the hours before the newest record of log (expert_id, ts, decision).

    A blank expert is "-". For an expert whatever isn't "deny" counts as allowed; in the totals, which every row carries, whatever isn't "allow" as denied.
    """
    newest = log.agg(F.max("ts")).first()[0]
    own = log.where(F.col("ts") >= F.lit(newest) - F.expr(f"INTERVAL {hours} HOURS"))
    expert = F.coalesce(F.nullif("expert_id", F.lit("")), F.lit("-")).alias("expert")
    by = own.groupBy(expert).agg(F.count_if(F.col("decision") != "deny").alias("allow"), F.count_if(F.col("decision") == "deny").alias("deny"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "allow").alias("ok"))
    every = Window.partitionBy(F.lit(1))  # a row for each expert
    total, allowed = F.sum("n").over(every), F.sum("ok").over(every)
    return by.select("expert", "allow", "deny", total.alias("total"), allowed.alias("allowed"), (total - allowed).alias("denied"), F.round((total - allowed) / total, 4).alias("deny_rate"))
