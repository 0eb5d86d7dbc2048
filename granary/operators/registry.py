"""Models, their versions, and when an expert deserves a model of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import tier_rank


def served_name() -> Column:
    """adapter, else model_name, else base_model, else model_id; empty strings count as missing."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("adapter", "model_name", "base_model")], F.col("model_id"))


def default_by_tier(models: DataFrame) -> DataFrame:
    """(tier, model_id): the first active model marked as the tier's default, else its first active one."""
    own = models.where("status = 'active'")
    return own.groupBy("tier").agg(F.min_by("model_id", F.struct(~F.coalesce("tier_default", F.lit(False)), "model_id")).alias("model_id"))


def resolved(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """wanted (request_id, tier) with model_id: the tier's default, else that of the next tier above that has one, else null."""
    chosen = default_by_tier(models).select(F.col("model_id"), tier_rank(F.col("tier")).alias("_rank"))
    steps = chosen.agg(F.array_sort(F.collect_list(F.struct("_rank", "model_id"))).alias("_steps"))  # one entry for each of four tiers
    up = F.filter("_steps", lambda s: s["_rank"] >= tier_rank(F.col("tier")))
    return wanted.crossJoin(F.broadcast(steps)).select(*wanted.columns, F.get(up, 0)["model_id"].alias("model_id"))


def serving_summary(models: DataFrame) -> DataFrame:
    """(base_model, adapters, loads_saved): adapters that share a base need it loaded once."""
    own = models.where("coalesce(adapter, '') <> '' and coalesce(base_model, '') <> ''")
    return own.groupBy("base_model").agg(F.count(F.lit(1)).alias("adapters"), F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("loads_saved"))


def version_summary(versions: DataFrame) -> DataFrame:
    """(model_id, versions, active, candidates): a count, the newest active version, and how many are candidates."""
    order = F.struct("created_at", "version")
    return versions.groupBy("model_id").agg(F.count(F.lit(1)).alias("versions"), F.max_by(F.when(F.col("status") == "active", F.col("version")), F.when(F.col("status") == "active", order)).alias("active"), F.count_if(F.col("status") == "candidate").alias("candidates"))


def promoted(versions: DataFrame, metric: str = "accuracy", min_improvement: float = 0.0) -> DataFrame:
    """versions with their new status: a model's newest candidate becomes active, and the active ones retire, if its metric is there and at least the incumbents' best plus min_improvement."""
    w = Window.partitionBy("model_id")
    order = F.struct("created_at", "version")
    newest = F.max(F.when(F.col("status") == "candidate", order)).over(w)
    best = F.max(F.when(F.col("status") == "active", F.col(metric))).over(w)
    chosen = (F.col("status") == "candidate") & (order == newest)
    passes = F.coalesce(F.col(metric).isNotNull() & (best.isNull() | (F.round(F.col(metric) - best, 9) >= min_improvement)), F.lit(False))
    marked = versions.withColumn("_best", best).withColumn("_win", chosen & passes).withColumn("_any", F.max(F.col("_win")).over(w))
    status = F.when(F.col("_win"), "active").when(F.col("_any") & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("_best", "_win", "_any")


def rolled_back(versions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions with their status after a rollback, and (model_id, problem) of models that can't be rolled back.

    wanted is (model_id, version), a row for each model; a null version stands for the retired one that was created last (not
    the one that was retired last). It becomes active, and what was active retires; other models stay as they are.
    """
    order = F.struct("created_at", "version")
    last = versions.groupBy("model_id").agg(F.max_by(F.when(F.col("status") == "retired", F.col("version")), F.when(F.col("status") == "retired", order)).alias("_last"))
    named = wanted.select("model_id", F.col("version").alias("_asked")).join(last, "model_id", "left").withColumn("_target", F.coalesce("_asked", "_last"))
    held = named.join(versions.select("model_id", F.col("version").alias("_target"), F.lit(True).alias("_there")), ["model_id", "_target"], "left")
    known = versions.select("model_id").distinct().withColumn("_known", F.lit(True))
    problem = F.when(F.col("_known").isNull(), "no version history").when(F.col("_target").isNull(), "no retired version").when(F.col("_there").isNull(), "no such version")
    bad = held.join(known, "model_id", "left").select("model_id", problem.alias("problem")).where("problem is not null")
    target = held.where("_there").select("model_id", "_target").distinct()
    status = F.when(F.col("version") == F.col("_target"), "active").when(F.col("_target").isNotNull() & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return versions.join(target, "model_id", "left").withColumn("status", status).drop("_target"), bad


def promotion_triggers(usage: DataFrame, volume: int = 50_000) -> DataFrame:
    """usage (expert_id, sovereign, calls, p95_ms, required_ms, accuracy, target) with the names of confirmed triggers; any one promotes."""
    names = F.array_compact(F.array(F.when(F.col("sovereign"), "sovereignty"), F.when(F.col("calls") >= volume, "volume"), F.when(F.col("p95_ms") > F.col("required_ms"), "latency"), F.when(F.col("accuracy") < F.col("target"), "accuracy")))
    return usage.withColumn("triggers", names).withColumn("promote", F.size("triggers") > 0)


def plan_confidence(steps: DataFrame) -> DataFrame:
    """(plan_id, confidence) of steps (plan_id, confidence, matched, classification): the weakest step counts most, open steps cut it."""
    own = F.when(F.col("matched"), F.col("confidence"))
    g = steps.groupBy("plan_id").agg(F.min(own).alias("lo"), F.avg(own).alias("mean"), F.max("classification").alias("cls"), F.count_if(~F.col("matched")).alias("open"), F.count(F.lit(1)).alias("n"))
    core = 0.6 * F.col("lo") + 0.4 * F.col("mean")
    value = (core + (1 - core) * 0.35 * F.col("cls")) * (1 - 0.5 * F.col("open") / F.col("n"))
    return g.select("plan_id", F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4), F.lit(0.0)).alias("confidence"))


def registered(models: DataFrame, new: DataFrame) -> DataFrame:
    """models (model_id, tier, tier_default) with new in place of the same ids; of a tier's defaults the new one of largest id stays, or else the old ones do."""
    both = models.join(new.select("model_id"), "model_id", "left_anti").withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    chosen = new.where("tier_default").groupBy("tier").agg(F.max("model_id").alias("chosen"))
    out = both.join(chosen, "tier", "left")
    return out.select("model_id", "tier", F.when(F.col("chosen").isNull(), F.col("tier_default")).otherwise(F.col("model_id") == F.col("chosen")).alias("tier_default"))


def inventory(experts: DataFrame, calibrations: DataFrame) -> DataFrame:
    """experts with calibrated and calibration_samples; false and 0 without a fit."""
    out = experts.join(calibrations.select("expert_id", "fitted", "samples"), "expert_id", "left")
    return out.select(*experts.columns, F.coalesce("fitted", F.lit(False)).alias("calibrated"), F.coalesce("samples", F.lit(0)).cast("long").alias("calibration_samples"))


def health(listed: DataFrame) -> DataFrame:
    """One row of counts of an inventory (…, backend, calibrated): experts, uncalibrated ones, and those on a placeholder backend."""
    placeholder = F.col("backend").isin("heuristic", "scripted")
    return listed.agg(F.count(F.lit(1)).alias("experts"), F.count_if(~F.col("calibrated")).alias("uncalibrated"), F.count_if(placeholder).alias("placeholders"))


def capabilities(nodes: DataFrame) -> DataFrame:
    """(node_id, tier_hint, priority, outputs) of nodes (node_id, attributes as JSON); what is absent or malformed gets its default."""
    a = F.from_json("attributes", "tier_hint string, k bigint, outputs array<string>")
    return nodes.select("node_id", F.coalesce(a["tier_hint"], F.lit("")).alias("tier_hint"), F.coalesce(a["k"], F.lit(0)).alias("priority"), F.coalesce(a["outputs"], F.array().cast("array<string>")).alias("outputs"))
