"""Cycles of task plans on edge tables: strongly connected components, one witness path for each, and plans without cycles.

Tasks are (task), needs are (task, needs); all plans of a table are worked on at once, so task ids are unique over them. First
whatever can't be on a cycle is trimmed, from both ends, which leaves little of an ordinary plan. Then each task takes the
smallest task that reaches it over its needs (the pivot), and a walk back from each pivot, within the tasks that took it, gives
the pivot's component; components go, and the rest starts anew. Every round is one written table; rounds are as many as a walk
is long, whatever the number of plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.scratch import forget, materialize


def known_needs(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """needs of known tasks on other known tasks, each once."""
    own = tasks.select("task").distinct()
    return needs.select("task", "needs").where("task <> needs").distinct().join(own, "task", "left_semi").join(own.select(F.col("task").alias("needs")), "needs", "left_semi").select("task", "needs")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between tasks that both need something and are needed, until all are; written, and edges deleted if they were."""
    left, size = edges, None
    while True:
        needed, needing = left.select(F.col("needs").alias("task")).distinct(), left.select(F.col("task").alias("needs")).distinct()
        now = materialize(left.join(needed, "task", "left_semi").join(needing, "needs", "left_semi").select("task", "needs"))
        if hasattr(left, "scratch"):
            forget(left)
        left, before, size = now, size, now.count()
        if size in (0, before):
            return left


def _spread(edges: DataFrame) -> DataFrame:
    """Written (task, pivot): the smallest task that reaches each over its needs, itself included."""
    both = edges.select("task").unionByName(edges.select(F.col("needs").alias("task"))).distinct()
    pivots = materialize(both.select("task", F.col("task").alias("pivot")))
    while True:
        from_others = edges.join(pivots, "task").select(F.col("needs").alias("task"), "pivot")
        now = materialize(pivots.select("task", "pivot", F.col("pivot").alias("was")).unionByName(from_others.withColumn("was", F.lit(None).cast(pivots.schema["pivot"].dataType))).groupBy("task").agg(F.min("pivot").alias("pivot"), F.max("was").alias("was")))
        still = now.where("pivot <> was").isEmpty()
        forget(pivots)
        if still:
            return now.select("task", "pivot")
        pivots = now.drop("was")
        pivots.scratch = now.scratch


def components(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(task, component): tasks on cycles, with the smallest task of their strongly connected component. A task that only needs itself is on none."""
    # Trimming comes before the checks for repeats and unknown tasks, as it leaves few needs to check.
    loose = _trimmed(needs.select("task", "needs").where("task <> needs"))
    left = _trimmed(materialize(known_needs(tasks, loose)))
    forget(loose)
    found = left.select("task", F.col("task").alias("component")).where("false")
    while not left.isEmpty():
        pivots = _spread(left)
        inner = left.join(pivots, "task").join(pivots.select(F.col("task").alias("needs"), F.col("pivot").alias("theirs")), "needs").where("pivot = theirs").select("task", "needs", "pivot")
        inner = materialize(inner)
        # The pivot reaches every task that took it; those that reach the pivot, too, are its component.
        seen = edge = materialize(pivots.where("task = pivot"))
        rounds = 0
        while not edge.isEmpty():
            edge = materialize(inner.join(edge.select(F.col("task").alias("needs"), "pivot"), ["needs", "pivot"], "left_semi").select("task", "pivot").distinct().join(seen, ["task", "pivot"], "left_anti"))
            seen, rounds = seen.unionByName(edge), rounds + 1
            if rounds % 20 == 0:  # a union of many scans takes long to plan
                seen = materialize(seen)
        many = seen.groupBy("pivot").count().where("count > 1").select("pivot")
        found = materialize(found.unionByName(seen.join(many, "pivot", "left_semi").select("task", F.col("pivot").alias("component"))))
        gone = seen.select("task")
        rest = inner.join(gone, "task", "left_anti").join(gone.select(F.col("task").alias("needs")), "needs", "left_anti").select("task", "needs")
        left = _trimmed(materialize(rest))
    return found


def _inner(found: DataFrame, needs: DataFrame) -> DataFrame:
    """(component, task, needs) of the needs within a component, each once; written. Most needs are on no cycle, so repeats are looked for among what is left."""
    mine = needs.select("task", "needs").where("task <> needs").join(found, "task")
    own = mine.join(found.select(F.col("task").alias("needs"), F.col("component").alias("theirs")), "needs").where("component = theirs")
    return materialize(own.select("component", "task", "needs").distinct())


def distances(found: DataFrame, needs: DataFrame) -> DataFrame:
    """(task, component, steps, by): how many needs lead from a component's smallest task to each, and the smallest task before it on such a way."""
    arrows = _inner(found, needs)
    out = _distances(found, arrows)
    forget(arrows)
    return out


def _distances(found: DataFrame, arrows: DataFrame) -> DataFrame:
    seen = edge = materialize(found.where("task = component").select("task", "component", F.lit(0).alias("steps"), F.lit(None).cast(found.schema["task"].dataType).alias("by")))
    step = 0
    while not edge.isEmpty():
        step += 1
        reached = arrows.join(edge.select("component", "task"), ["component", "task"]).groupBy("component", F.col("needs").alias("next")).agg(F.min("task").alias("by"))
        edge = materialize(reached.select(F.col("next").alias("task"), "component", F.lit(step).alias("steps"), "by").join(seen, "task", "left_anti"))
        seen = seen.unionByName(edge)
        if step % 20 == 0:
            seen = materialize(seen)
    return seen


def cycle_paths(found: DataFrame, needs: DataFrame) -> DataFrame:
    """(component, step, task, needs): the edges of one shortest cycle through each component's smallest task, in order from it."""
    arrows = _inner(found, needs)
    at = _distances(found, arrows)
    closing = arrows.where("needs = component").join(at, ["task", "component"]).groupBy("component").agg(F.min(F.struct("steps", "task", "by")).alias("last"))
    walk = materialize(closing.select("component", F.col("last.steps").alias("step"), F.col("last.task").alias("task"), F.col("component").alias("needs"), F.col("last.by").alias("by")))
    out, rounds = walk, 0
    while True:
        walk = walk.where("by is not null")
        if walk.isEmpty():
            forget(arrows)
            return out.select("component", "step", "task", "needs")
        before = at.select(F.col("task").alias("by"), F.col("by").alias("earlier"))
        walk = materialize(walk.join(before, "by").select("component", (F.col("step") - 1).alias("step"), F.col("by").alias("task"), F.col("task").alias("needs"), F.col("earlier").alias("by")))
        out, rounds = out.unionByName(walk), rounds + 1
        if rounds % 20 == 0:
            out = materialize(out)


def without_cycles(tasks: DataFrame, needs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(task, needs): the needs that are kept so that no cycle is left; unknown and own ones and repeats go, too.

    Within a component the tasks have an order: by how many needs lead to them from its smallest task, then by task. A need
    goes if it points back in that order. Needs that are on no cycle stay, and so does one way from the smallest task to each
    other.
    """
    found = components(tasks, needs) if found is None else found
    order = distances(found, needs)
    side = lambda name: order.select(F.col("task").alias(name), F.col("component").alias(f"{name}_in"), F.struct("steps", "task").alias(f"{name}_at"))
    both = known_needs(tasks, needs).join(side("task"), "task", "left").join(side("needs"), "needs", "left")
    back = F.coalesce((F.col("task_in") == F.col("needs_in")) & (F.col("needs_at") < F.col("task_at")), F.lit(False))
    return both.where(~back).select("task", "needs")
