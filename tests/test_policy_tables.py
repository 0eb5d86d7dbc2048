"""Policies as a table are tried in the order that the compiled ones have."""

import random

from granary.operators import policy


def test_order_of_a_table_is_that_of_the_list(spark):
    rng = random.Random(5)
    own = [policy.Policy(f"p{i:03}", rng.choice(policy.EFFECTS), rng.choice([1, 5, 100]), points=rng.choice([(), ("admission",), ("emission", "admission")]), tenants=rng.choice([(), ("t1",), ("t2",)]), enabled=rng.random() < 0.8) for i in range(200)]
    rows = [("g", p.id, p.effect, p.priority, p.enabled, list(p.points) or None, list(p.tenants)) for p in own]
    table = spark.createDataFrame(rows, "grp string, id string, effect string, priority int, enabled boolean, points array<string>, tenants array<string>")
    for point, tenant in (("emission", "t1"), ("admission", "t2"), ("", "default")):
        got = policy.ordered(table, "grp", "id", point=point, tenant=tenant).orderBy("place").collect()
        assert [r.id for r in got] == [p.id for p in policy.in_order(own, point, tenant)]
        assert [r.place for r in got] == list(range(1, len(got) + 1))
    assert policy.ordered(table.where("false"), "grp", "id").count() == 0
