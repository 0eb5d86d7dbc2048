"""Runs, traces, calibration fits and hierarchies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import materialize

# Layers that a complete trace has.
LAYERS = ["L2", "L4", "L5"]


def complete_traces(events: DataFrame) -> DataFrame:
    """(session_id, complete): whether the events of a session come from all layers needed."""
    seen = [F.coalesce(F.max((F.col("layer") == x).cast("int")), F.lit(0)) for x in LAYERS]
    return events.groupBy("session_id").agg(F.least(*seen).alias("complete")).withColumn("complete", F.col("complete") == 1)


def newest_runs(runs: DataFrame, cases: DataFrame, *, tenant: str = "default", limit: int = 20) -> DataFrame:
    """(run_id, created_at, arm, place, and the columns of cases) of a tenant's newest limit runs with their cases in the order of their ids.

    runs is (run_id, tenant, arm, created_at); of equal times the larger id is newer. The limit comes before the join: at most
    that many runs are broadcast to the cases, and a run without cases has one row without a case.
    """
    own = runs.where(F.col("tenant") == tenant).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit).select("run_id", "created_at", "arm")
    mine = cases.join(F.broadcast(own.select("run_id")), "run_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("case_id"))
    return own.join(mine.withColumn("place", place), "run_id", "left")


def export_rows(log: DataFrame, limit: int) -> DataFrame:
    """The newest limit rows as JSON, oldest first; ties by id."""
    newest = log.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    return newest.orderBy("ts", "id").select("id", F.to_json(F.struct(*newest.columns)).alias("line"))


def fit_calibrations(samples: DataFrame, *, least: int = 12, steps: int = 800, rate: float = 0.15, digits: int = 4) -> DataFrame:
    """(expert_id, slope, bias, samples, brier_before, brier_after, fitted) of samples (expert_id, confidence, correct).

    A Platt fit by gradient descent. Samples of equal confidence, to digits places, meet as counts, so an expert's group
    has at most 10 ** digits + 1 rows whatever its number of samples. With fewer than least samples, one outcome only, or a
    Brier score that the fit worsens, the identity stays and fitted is false. Null confidences take no part.
    """
    own = samples.where(F.col("confidence").isNotNull())
    counts = own.groupBy("expert_id", F.round("confidence", digits).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("good"))

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        p, n, good = (t[c].to_numpy(float) for c in ("p", "n", "good"))
        total, right = n.sum(), good.sum()
        x = np.clip(p, 1e-6, 1 - 1e-6)
        x = np.log(x / (1 - x))
        brier = lambda q: float((good * (1 - q) ** 2 + (n - good) * q**2).sum() / total)
        slope, bias, before = 1.0, 0.0, brier(p)
        after, fitted = before, False
        if total >= least and 0 < right < total:
            for _ in range(steps):
                error = n / (1 + np.exp(-np.clip(slope * x + bias, -30, 30))) - good
                slope, bias = slope - rate * float(error @ x) / total, bias - rate * float(error.sum()) / total
            now = brier(1 / (1 + np.exp(-np.clip(slope * x + bias, -30, 30))))
            fitted = now <= before
            after = now if fitted else before
        if not fitted:
            slope, bias = 1.0, 0.0
        return pd.DataFrame([[t["expert_id"].iloc[0], slope, bias, int(total), before, after, fitted]], columns=["expert_id", "slope", "bias", "samples", "brier_before", "brier_after", "fitted"])

    return counts.groupBy("expert_id").applyInPandas(fit, "expert_id string, slope double, bias double, samples long, brier_before double, brier_after double, fitted boolean")


def ancestors(parents: DataFrame) -> DataFrame:
    """(name, ancestor, steps) of a hierarchy (name, parent) of any depth; steps is the shortest way. On a cycle each name is its own ancestor.

    Each round joins the pairs known so far with themselves, so a hierarchy of depth n takes log2 n rounds; each is written.
    """
    up = parents.select("name", "parent").where("parent is not null").distinct()
    seen = materialize(up.select("name", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")))
    while True:
        onward = seen.select(F.col("name").alias("ancestor"), F.col("ancestor").alias("next"), F.col("steps").alias("more"))
        further = seen.join(onward, "ancestor").select("name", F.col("next").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        now = materialize(seen.unionByName(further).groupBy("name", "ancestor").agg(F.min("steps").alias("steps")))
        if now.count() == seen.count():
            return now
        seen = now


def type_problems(types: DataFrame) -> DataFrame:
    """(name, problem) of types (name, parent): duplicate, own parent, unknown parent, and cycle for a type that is its own ancestor."""
    twice = types.groupBy("name").count().where("count > 1").select("name", F.lit("duplicate").alias("problem"))
    own = types.where("name = parent").select("name", F.lit("own parent").alias("problem"))
    unknown = types.where("parent is not null").join(types.select(F.col("name").alias("parent")), "parent", "left_anti").select("name", F.lit("unknown parent").alias("problem"))
    cycle = ancestors(types.where("parent is null or name <> parent")).where("name = ancestor").select("name", F.lit("cycle").alias("problem"))
    return twice.unionByName(own).unionByName(unknown).unionByName(cycle).distinct()
