"""Property-graph and task-DAG operators on node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.scratch import forget, materialize


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "out", relation: str | None = None) -> DataFrame:
    """(node_id, neighbour_id, label): adjacent nodes, each once."""
    own = edges.where(F.col("relation") == relation) if relation else edges
    out = own.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour_id"))
    into = own.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour_id"))
    pairs = {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()
    return pairs.join(nodes.select(F.col("node_id").alias("neighbour_id"), "label"), "neighbour_id").select("node_id", "neighbour_id", "label")


def authority(pairs: DataFrame, edges: DataFrame, experts: DataFrame) -> DataFrame:
    """(expert_id, domain, weight): an explicit edge's weight, else 1 in the expert's own domain and .5 elsewhere; 0 for an unknown expert."""
    e = edges.select(F.col("source_id").alias("expert_id"), F.col("target_id").alias("domain"), F.col("weight").alias("given"))
    out = pairs.join(experts.select("expert_id", F.col("domain").alias("home")), "expert_id", "left").join(e, ["expert_id", "domain"], "left")
    weight = F.when(F.col("home").isNull(), 0.0).otherwise(F.coalesce("given", F.when(F.col("home") == F.col("domain"), 1.0).otherwise(0.5)))
    return out.select("expert_id", "domain", weight.alias("weight"))


def inferred_dependencies(produces: DataFrame, operates_on: DataFrame) -> DataFrame:
    """(producer, consumer): capabilities that share an entity, by an equi-join on it; both sides are (capability, entity)."""
    p, c = produces.select(F.col("capability").alias("producer"), "entity"), operates_on.select(F.col("capability").alias("consumer"), "entity")
    return p.join(c, "entity").where("producer <> consumer").select("producer", "consumer").distinct()


def plan_problems(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(task, needs, problem): dependencies that don't exist or are the task itself."""
    unknown = needs.join(tasks.select(F.col("task").alias("needs")), "needs", "left_anti").select("task", "needs", F.lit("unknown").alias("problem"))
    return unknown.unionByName(needs.where("task = needs").select("task", "needs", F.lit("self").alias("problem")))


def terminal(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """Tasks that nothing depends on."""
    return tasks.join(needs.select(F.col("needs").alias("task")), "task", "left_anti")


def _counted(tasks: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task, open) with the number of needs that exist, and those needs as (task, needs); both written."""
    own = tasks.select("task").distinct()
    arrows = materialize(needs.select("task", "needs").distinct().join(own.select(F.col("task").alias("needs")), "needs", "left_semi").select("task", "needs"))
    return materialize(own.join(arrows.groupBy("task").agg(F.count(F.lit(1)).alias("open")), "task", "left").select("task", F.coalesce("open", F.lit(0)).alias("open"))), arrows


def _next(state: DataFrame, arrows: DataFrame) -> DataFrame:
    """The tasks that wait on, each with its open needs less those that are ready in state; written."""
    met = arrows.join(state.where("open = 0").select(F.col("task").alias("needs")), "needs", "left_semi").groupBy("task").agg(F.count(F.lit(1)).alias("met"))
    return materialize(state.where("open > 0").join(met, "task", "left").select("task", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")))


def blocked(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(task): tasks that can never start, on a cycle or behind one. Needs that don't exist are dropped; a task that needs itself is a cycle.

    Each round takes away what can start; there are as many rounds as waves, each with one written table.
    """
    state, arrows = _counted(tasks, needs)
    while not state.where("open = 0").isEmpty():
        last, state = state, _next(state, arrows)
        forget(last)
    forget(arrows)
    return state.select("task")


def levels(spark: SparkSession, tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(task, level): the wave in which each task of an acyclic plan can start; needs is (task, needs). Tasks on cycles or behind one have no level; needs that don't exist are dropped.

    A task carries the number of its open needs, and a wave takes off those that got ready: one written table a wave, as many waves as the plan is deep.
    """
    state, arrows = _counted(tasks, needs)
    out, wave, since = None, 0, []
    while wave == 0 or not state.where("open = 0").isEmpty():
        ready = state.where("open = 0").select("task", F.lit(wave).alias("level"))
        since.append(state)
        out = ready if out is None else out.unionByName(ready)
        state, wave = _next(state, arrows), wave + 1
        if wave % 20 == 0:  # a union of many scans takes long to plan
            out = materialize(out)
            forget(*since)
            since = [out]
    forget(state, arrows)
    return out


def skipped(failed: DataFrame, needs: DataFrame) -> DataFrame:
    """(task): what is skipped as something that it needs, directly or not, has failed; the failed (task) themselves aren't in it. One written table a wave."""
    arrows = needs.select("task", "needs").distinct()
    first = seen = edge = materialize(failed.select("task").distinct())
    wave, since = 0, [first]
    while not edge.isEmpty():
        edge = materialize(arrows.join(edge.select(F.col("task").alias("needs")), "needs", "left_semi").select("task").distinct().join(seen, "task", "left_anti"))
        seen, wave = seen.unionByName(edge), wave + 1
        since.append(edge)
        if wave % 20 == 0:
            seen = materialize(seen)
            forget(*(x for x in since if x is not first and x is not edge))
            since = [seen, edge]
    return seen.join(first, "task", "left_anti")


def declared_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id): depends_on edges from a capability to a capability."""
    own = nodes.where("kind = 'capability'").select("node_id")
    return edges.where("relation = 'depends_on'").join(own.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").join(own.select(F.col("node_id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id")


def upstream(needs: DataFrame, answers: DataFrame) -> DataFrame:
    """(task, needs, content, missing): what each task is given; a need without an answer that is ok is missing and gives null."""
    ok = answers.where("ok").select(F.col("task").alias("needs"), "content", F.lit(False).alias("missing"))
    return needs.join(ok, "needs", "left").select("task", "needs", "content", F.coalesce("missing", F.lit(True)).alias("missing"))
