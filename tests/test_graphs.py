"""Cycles of plans against a plain walk, and ontologies and registrations applied again."""

import random

from pyspark.sql import functions as F

from granary.operators import components, ontology
from granary.operators.graph import levels


def reached(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.insert(0, b)
        todo.pop()
    return seen


def test_cycles_of_random_plans(spark):
    rng = random.Random(2)
    tasks = list(range(60))
    edges = {(10 * g + rng.randrange(10), 10 * g + rng.randrange(10)) for g in range(6) for _ in range(4 + 3 * g)}
    t = spark.createDataFrame([(i,) for i in tasks], "task long")
    n = spark.createDataFrame([*edges, *list(edges)[:5], (3, 999), (999, 3)], "task long, needs long")
    proper = {(a, b) for a, b in edges if a != b}
    reach = {i: reached(proper, i) for i in tasks}
    want = {i: min(j for j in tasks if j in reach[i] and i in reach[j]) for i in tasks if i in reach[i]}
    found = components.components(t, n)
    assert {r.task: r.component for r in found.collect()} == want and len(set(want.values())) > 2
    paths = {}
    for r in components.cycle_paths(found, n).orderBy("component", "step").collect():
        paths.setdefault(r.component, []).append((r.task, r.needs))
    assert paths.keys() == set(want.values())
    for c, path in paths.items():
        assert path[0][0] == path[-1][1] == c and all(e in proper for e in path) and all(a[1] == b[0] for a, b in zip(path, path[1:], strict=False))
        assert len({a for a, _ in path}) == len(path)
    kept = components.without_cycles(t, n, found)
    rows = {tuple(r) for r in kept.collect()}
    assert rows <= proper and {e for e in proper - rows} <= {(a, b) for a, b in proper if want.get(a, -1) == want.get(b, -2)}
    assert not any(i in reached(rows, i) for i in tasks) and all(reached(rows, c) >= {i for i in want if want[i] == c} - {c} for c in set(want.values()))
    assert levels(spark, t, kept).count() == len(tasks)


def test_plans_without_cycles_stay(spark):
    t = spark.createDataFrame([(i,) for i in range(5)], "task long")
    n = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (2, 2)], "task long, needs long")
    assert components.components(t, n).collect() == []
    assert {tuple(r) for r in components.without_cycles(t, n).collect()} == {(1, 0), (2, 1), (2, 0)}
    none = n.limit(0)
    assert components.components(t, none).collect() == [] and components.cycle_paths(components.components(t, none), none).collect() == []


ONTOLOGY = "domain string, label string, description string, version string, entities array<struct<name:string,label:string,description:string,parent:string,keywords:array<string>,sensitivity:string>>, relations array<struct<name:string,source:string,target:string,cardinality:string>>"
EXPERT = "expert_id string, domain string, description string, model_id string, capabilities array<struct<capability_id:string,description:string,domain:string,keywords:array<string>,operates_on:array<string>,produces:array<string>,tier_hint:string>>, authority map<string,double>"


def told(graph):
    return [sorted(map(str, df.collect())) for df in graph]


def test_ontologies_are_idempotent_and_two_relations_of_one_pair_overwrite(spark):
    specs = spark.createDataFrame([("law", "Law", None, "2", [("Clause", None, "a part", None, ["term"], None), ("Penalty", "A penalty", None, "Clause", None, "restricted")], [("first", "Clause", "Penalty", "1:n"), ("second", "Clause", "Penalty", None)]), ("bare", None, None, None, None, None)], ONTOLOGY)
    once = ontology.applied(*ontology.empty_graph(spark), ontology.ontology_facts(specs))
    twice = ontology.applied(*once, ontology.ontology_facts(specs), prune=True)
    assert told(once) == told(twice)
    nodes = {r.node_id: r for r in once[0].collect()}
    assert nodes.keys() == {"domain:law", "domain:bare", "entity_type:Clause", "entity_type:Penalty"}
    assert (nodes["domain:law"].label, nodes["domain:bare"].label, nodes["entity_type:Clause"].label, nodes["entity_type:Penalty"].label) == ("Law", "bare", "Clause", "A penalty")
    edges = {(r.source_id, r.relation, r.target_id): r.attributes for r in once[1].collect()}
    assert '"name":"second"' in edges["entity_type:Clause", "related_to", "entity_type:Penalty"] and ("entity_type:Penalty", "subclass_of", "entity_type:Clause") in edges and len(edges) == 4


def expert(caps, **more):
    return ("x", more.get("domain", "law"), "an expert", more.get("model", "m1"), [(c, "", "", ["k"], on, [], "slm") for c, on in caps], more.get("authority"))


def test_registration_makes_ends_keeps_known_ones_and_prunes_on_request(spark):
    specs = spark.createDataFrame([("law", "Law", None, "2", [("Clause", "A clause", None, None, None, None)], None)], ONTOLOGY)
    base = ontology.applied(*ontology.empty_graph(spark), ontology.ontology_facts(specs))
    first = ontology.applied(*base, ontology.expert_facts(spark.createDataFrame([expert([("c1", ["Clause", "Party"]), ("c2", None)], authority={"tax": 0.7})], EXPERT)))
    nodes = {r.node_id: r for r in first[0].collect()}
    assert nodes["entity_type:Clause"].label == "A clause" and nodes["domain:law"].label == "Law"  # there before, so not made anew
    assert {"entity_type:Party", "domain:tax", "model:m1", "capability:c1", "capability:c2", "expert:x"} <= nodes.keys()
    assert {(r.target_id, r.weight) for r in first[1].where("relation = 'has_authority_over'").collect()} == {("domain:tax", 0.7)}
    second = ontology.expert_facts(spark.createDataFrame([expert([("c1", ["Clause"])], model="")], EXPERT))
    added = ontology.applied(*first, second)
    assert added[0].where("removed").count() == added[1].where("removed").count() == 0 and added[1].count() == first[1].count()
    nodes, edges = ontology.applied(*first, second, prune=True)
    assert {(r.source_id, r.target_id) for r in edges.where("removed").collect()} == {("expert:x", "capability:c2"), ("capability:c2", "domain:law"), ("capability:c1", "entity_type:Party"), ("expert:x", "domain:tax"), ("expert:x", "model:m1")}
    assert {r.node_id for r in nodes.where("removed").collect()} == {"capability:c2", "model:m1"}
    assert told(ontology.applied(nodes, edges, second, prune=True)) == told((nodes, edges))
    back = ontology.applied(nodes, edges, ontology.expert_facts(spark.createDataFrame([expert([("c2", None)])], EXPERT)), prune=True)
    assert back[0].where("node_id = 'capability:c2'").first().removed is False and back[0].where("node_id = 'capability:c1'").first().removed is True


def test_pack_problems(spark):
    shape = "pack_id string, ontologies array<struct<domain:string,entities:array<struct<name:string,parent:string>>,relations:array<struct<name:string,source:string,target:string>>>>, experts array<struct<id:string,domain:string,model:string,capabilities:array<struct<id:string,description:string,examples:array<string>,operates_on:array<string>>>,retrieval_domains:array<string>>>, models array<string>, defaults map<string,string>"
    good = [("d", [("A", None), ("B", "A")], [("r", "A", "B")])], [("x", "d", "m", [("c", "", ["say so"], ["A"])], ["d"])], ["m"], {"expert_model": "m"}
    loop = [("d", [("A", "B"), ("B", "C"), ("C", "B"), ("D", "A")], None)], [("x", "d", None, [("c", "yes", None, None)], None)], None, None
    packs = spark.createDataFrame([("good", *good), ("empty", None, None, None, None), ("loop", *loop)], shape)
    got = {}
    for r in ontology.pack_problems(packs).collect():
        got.setdefault(r.pack_id, []).append(r.problem)
    assert "good" not in got and sorted(got["empty"]) == ["pack declares no experts", "pack declares no ontology; the router has nothing to match on"]
    assert sorted(got["loop"]) == [f"ontology 'd': subclass cycle involving '{e}' via '{v}'" for e, v in (("A", "B"), ("B", "C"), ("C", "B"), ("D", "B"))]
    assert ontology.pack_problems(packs.limit(0)).collect() == []
    assert ontology.applied(*ontology.empty_graph(spark), ontology.ontology_facts(spark.createDataFrame([], ONTOLOGY)))[1].where(F.lit(True)).count() == 0


def test_packs_are_dealt_once_and_ontologies_without_grandparents_are_left(spark):
    from granary.plans import graph_queries

    plan = ontology.claims(graph_queries._packs(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    up = spark.createDataFrame([("p", 0, "d", "A", "B"), ("p", 0, "d", "B", "C"), ("p", 0, "d", "D", "D"), ("q", 0, "d", "A", "B"), ("p", 1, "d", "B", "A")], "pack_id string, n int, domain string, name string, parent string")
    assert sorted((r.pack_id, r.n, r.name) for r in ontology._onward(up).collect()) == [("p", 0, "A"), ("p", 0, "D")]
    shape = "pack_id string, ontologies array<struct<domain:string,entities:array<struct<name:string,parent:string>>,relations:array<struct<name:string,source:string,target:string>>>>, experts array<struct<id:string,domain:string,model:string,capabilities:array<struct<id:string,description:string,examples:array<string>,operates_on:array<string>>>,retrieval_domains:array<string>>>, models array<string>, defaults map<string,string>"
    packs = spark.createDataFrame([("x", [("d", [("A", None), ("A", None), ("A", None)], None)], [("e", "d", "m", [("c", "yes", None, ["A"])], None), ("e", "d", "n", [("c", "yes", None, None)], None)], ["m"], None)], shape)
    problems = sorted(r.problem for r in ontology.pack_problems(packs, spark.createDataFrame([("n",)], "model_id string")).collect())
    assert [p.partition(" ")[0] for p in problems] == ["capability", "duplicate", "ontology", "ontology"]


def test_every_customer_has_a_pack_and_those_without_ontologies_say_so(spark):
    from granary.plans import graph_queries

    d = "/root/testdata/sf0.001"
    customers = spark.read.parquet(f"{d}/customer.parquet")
    nation = {r.c_custkey: r.c_nationkey for r in customers.collect()}
    assert {r.pack_id for r in graph_queries._packs(spark, d).select("pack_id").collect()} == set(nation)
    got = {}
    for r in graph_queries.pack_validate(spark, d).collect():
        got.setdefault(r.pack_id, []).append(r.problem)
    bare = "pack declares no ontology; the router has nothing to match on"
    assert {k for k, problems in got.items() if bare in problems} == {k for k in nation if k % 25 == 24} != set()
    own = f"domain 'd{nation[74]}', which"  # 74 has a third expert, without capabilities
    assert sorted(got[74]) == sorted([
        bare, *[f"expert '{x}' declares {own} no ontology in this pack defines" for x in "abz"], *[f"expert '{x}' retrieves from {own} this pack does not define" for x in "abz"],
        *[f"expert '{x}' capability '{c}' operates on '{e}', which the ontology does not define" for x, c, e in (("a", "c1", "Order"), ("b", "c2", "Line"))], "expert 'z' declares no capabilities",
    ])


def test_unknown_tasks_on_a_ring_are_on_no_cycle_and_components_are_of_few_written_rows(spark, monkeypatch):
    """Trimming comes first, so a long plan without cycles is never written whole; a ring through an unknown task isn't one."""
    real = components.materialize
    chain = [(i, i - 1) for i in range(1, 4)]
    ring = [(10, 11), (11, 12), (12, 10), (12, 10), (20, 21), (21, 20), (10, 10)]
    tasks = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 10, 11, 12, 20)], "task long")
    needs = spark.createDataFrame(chain + ring, "task long, needs long")
    sizes = []

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "materialize", counted)
    found = components.components(tasks, needs)
    assert sorted(map(tuple, found.collect())) == [(10, 10), (11, 10), (12, 10)]
    assert sizes[0] < len(chain + ring) - 2
    assert sorted(map(tuple, components.without_cycles(tasks, needs, found).collect())) == [(1, 0), (2, 1), (3, 2), (10, 11), (11, 12)]
