"""Calibration fits against sample-by-sample descent, and broken hierarchies."""

import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from granary.functions import scores
from granary.operators import evaluation, graph, runs
from granary.plans import fixtures

DATA = "/root/testdata/sf0.001"


def plain_fit(pairs, steps=800, rate=0.15):
    slope, bias, n = 1.0, 0.0, len(pairs)
    x = [math.log(c / (1 - c)) for c, _ in pairs]
    for _ in range(steps):
        e = [1 / (1 + math.exp(-(slope * a + bias))) - o for a, (_, o) in zip(x, pairs)]
        slope, bias = slope - rate * sum(a * b for a, b in zip(e, x)) / n, bias - rate * sum(e) / n
    return slope, bias


def test_fits(spark):
    mixed = [(0.9, i % 3 == 0) for i in range(8)] + [(0.3, i % 4 == 0) for i in range(8)]
    rows = [("few", 0.5, i % 2 == 0) for i in range(11)] + [("sure", 0.5, True)] * 12 + [("mixed", *x) for x in mixed] + [("mixed", None, True)]
    got = {r.expert_id: r for r in runs.fit_calibrations(spark.createDataFrame(rows, "expert_id string, confidence double, correct boolean")).collect()}
    slope, bias = plain_fit(mixed)
    assert not got["few"].fitted and not got["sure"].fitted and got["few"].slope == 1.0
    assert got["mixed"].fitted and got["mixed"].samples == 16 and got["mixed"].brier_after < got["mixed"].brier_before
    assert abs(got["mixed"].slope - slope) < 1e-9 and abs(got["mixed"].bias - bias) < 1e-9


def test_hierarchy_problems(spark):
    rows = [("a", None), ("b", "a"), ("b", "a"), ("c", "c"), ("d", "gone"), ("x", "y"), ("y", "x")]
    got = runs.type_problems(spark.createDataFrame(rows, "name string, parent string")).collect()
    assert sorted(map(tuple, got)) == [("b", "duplicate"), ("c", "own parent"), ("d", "unknown parent"), ("x", "cycle"), ("y", "cycle")]


def test_nearest_ranks_without_a_groups_values_in_one_array(spark):
    values = {"a": [5.0, -3.0, 0.0, None, 2.5, 2.5, 1e9], None: [1.0, float("nan"), float("inf")], "b": [None], "c": [float(i % 37) - 18 for i in range(500)]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    shares = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    want = rows.groupBy("g").agg(*(scores.nearest_rank(F.collect_list("v"), s).alias(n) for n, s in shares.items()))
    got = evaluation.with_nearest_ranks(rows.select("g").distinct(), rows, ["g"], "v", shares)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for plan in (evaluation.metrics(fixtures.case_results(spark, DATA), "arm"), evaluation.snapshots(fixtures.answers(spark, DATA), "expert_id", "day")):
        assert "collect_list" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_large_streams_are_read_from_files(spark):
    for name in ("stream_dedup", "stream_session", "stream_tumbling", "stream_sliding", "stream_trace_counts"):
        rows = entry.queries()[name](spark, DATA)
        assert rows.inputFiles() and rows.count() > 0


def test_levels_of_a_long_chain(spark):
    tasks = spark.range(66).withColumnRenamed("id", "task")
    needs = spark.createDataFrame([(i, i - 1) for i in range(1, 64)] + [(63, 0), (64, 65), (65, 64), (2, 999)], "task long, needs long")
    assert {r.task: r.level for r in graph.levels(spark, tasks, needs).collect()} == {i: i for i in range(64)}


def test_hierarchies_of_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)] + [("n25", None)], "name string, parent string")
    assert runs.ancestors(chain).where("name = 'n0'").agg({"steps": "max"}).first()[0] == 25
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)], "name string, parent string")
    assert runs.type_problems(ring).where("problem = 'cycle'").count() == 30
