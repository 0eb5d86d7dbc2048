"""Queries of cycles in plans, ontologies and registrations; importing this module adds them to those of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import components, ontology
from granary.sources.scratch import dealt

from .fixtures import table
from .queries import query


def _looped(spark, d):
    """Each order is a plan of its lines: a line needs the one before it and, in some orders, one after it."""
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task"), "l_orderkey", "l_linenumber", "l_partkey").where("l_orderkey % 5 < 4")
    chain = lines.where("l_linenumber > 1").select("task", (F.col("task") - 1).alias("needs"))
    back = lines.where("l_partkey % 3 = 0").select("task", (F.col("task") + 1 + F.col("l_orderkey") % 3).alias("needs"))
    own = lines.where("l_partkey % 7 = 0").select("task", F.col("task").alias("needs"))
    return lines.select("task"), chain.unionByName(back).unionByName(own)


_LOOPED = """l AS (SELECT l_orderkey * 10 + l_linenumber AS task, l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_orderkey % 5 < 4),
a AS (SELECT task, task - 1 AS needs FROM l WHERE n > 1 UNION SELECT task, task + 1 + o % 3 FROM l WHERE p % 3 = 0),
e AS (SELECT task, needs FROM a WHERE needs IN (SELECT task FROM l) AND task IN (SELECT task FROM l)),
reach(x, y) AS (SELECT task, needs FROM e UNION SELECT reach.x, e.needs FROM reach JOIN e ON e.task = reach.y),
c AS (SELECT a.x AS task, min(a.y) AS component FROM reach a JOIN reach b ON a.x = b.y AND a.y = b.x GROUP BY 1),
i AS (SELECT component, task, needs FROM e JOIN c USING (task) JOIN (SELECT task AS needs, component AS theirs FROM c) USING (needs) WHERE component = theirs),
walk(component, task, steps) AS (SELECT component, component, 0 FROM (SELECT DISTINCT component FROM c) UNION SELECT i.component, i.needs, walk.steps + 1 FROM walk JOIN i ON i.component = walk.component AND i.task = walk.task WHERE walk.steps < 8),
at AS (SELECT component, task, min(steps) AS steps FROM walk GROUP BY ALL)""".replace("\nat AS", "\nplace AS")


@query(f"WITH RECURSIVE {_LOOPED} SELECT task, component FROM c")
def dag_components(spark, d):
    return components.components(*_looped(spark, d))


@query(f"""WITH RECURSIVE {_LOOPED}, b AS (SELECT i.task, i.needs FROM i JOIN place x ON x.task = i.task JOIN place y ON y.task = i.needs WHERE y.steps < x.steps OR (y.steps = x.steps AND y.task < x.task))
SELECT task, needs FROM e EXCEPT SELECT task, needs FROM b""")
def dag_break_cycles(spark, d):
    return components.without_cycles(*_looped(spark, d))


@query(f"""WITH RECURSIVE {_LOOPED}, last AS (SELECT i.component, min(struct_pack(s := x.steps, t := i.task)) AS z FROM i JOIN place x ON x.task = i.task WHERE i.needs = i.component GROUP BY 1),
path(component, step, task, needs) AS (SELECT component, z.s, z.t, component FROM last
  UNION ALL SELECT p.component, p.step - 1, (SELECT min(i.task) FROM i JOIN place x ON x.task = i.task AND x.steps = p.step - 1 WHERE i.component = p.component AND i.needs = p.task), p.task FROM path p WHERE p.step > 0)
SELECT component, step, task, needs FROM path""")
def dag_cycle_path(spark, d):
    tasks, needs = _looped(spark, d)
    return components.cycle_paths(components.components(tasks, needs), needs)


# --- ontologies, experts and packs -------------------------------------------------------------------------------------


def _ontologies(spark, d):
    """A brand is a domain, its sizes and types are entity types, and its parts relate the two."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("domain"), F.concat(F.col("p_brand"), F.lit("/size "), F.col("p_size")).alias("c"), F.concat(F.col("p_brand"), F.lit("/"), F.split("p_type", " ")[0]).alias("t"), F.col("p_partkey").alias("k"))
    entity = lambda name, parent: F.struct(name.alias("name"), F.lit("").alias("label"), F.concat(F.lit("of "), F.col("domain")).alias("description"), parent.cast("string").alias("parent"), F.array(F.lower(name)).alias("keywords"), F.lit(None).cast("string").alias("sensitivity"))
    by = p.groupBy("domain").agg(
        F.array_sort(F.collect_set(F.col("t"))).alias("types"), F.array_sort(F.collect_set(F.struct("c", "t"))).alias("pairs"), F.max("k").cast("string").alias("version"),
    )
    kinds = F.transform("types", lambda t: entity(t, F.lit(None)))
    boxes = F.transform(F.array_distinct(F.transform("pairs", lambda x: x["c"])), lambda c: entity(c, F.col("types")[0]))
    links = F.transform("pairs", lambda x: F.struct(F.lit("packs").alias("name"), x["c"].alias("source"), x["t"].alias("target"), F.lit("n:m").alias("cardinality")))
    return by.select("domain", F.lit(None).cast("string").alias("label"), F.lit("a brand").alias("description"), "version", F.concat(kinds, boxes).alias("entities"), links.alias("relations"))


_ONTOLOGY = """p AS (SELECT DISTINCT p_brand AS d, p_brand || '/size ' || p_size AS c, p_brand || '/' || string_split(p_type, ' ')[1] AS t FROM part), f AS (SELECT d, min(t) AS top FROM p GROUP BY 1)"""


@query(f"""WITH {_ONTOLOGY}
SELECT 'domain:' || d AS node_id, d AS label, d AS domain, '' AS target_id, 'node' AS relation FROM f UNION ALL SELECT 'entity_type:' || c, c, d, '', 'node' FROM (SELECT DISTINCT d, c FROM p) UNION ALL SELECT 'entity_type:' || t, t, d, '', 'node' FROM (SELECT DISTINCT d, t FROM p)
UNION ALL SELECT 'entity_type:' || c, '', '', 'domain:' || d, 'belongs_to_domain' FROM (SELECT DISTINCT d, c FROM p) UNION ALL SELECT 'entity_type:' || t, '', '', 'domain:' || d, 'belongs_to_domain' FROM (SELECT DISTINCT d, t FROM p)
UNION ALL SELECT DISTINCT 'entity_type:' || c, '', '', 'entity_type:' || top, 'subclass_of' FROM p JOIN f USING (d) UNION ALL SELECT 'entity_type:' || c, '', '', 'entity_type:' || t, 'related_to' FROM p""")
def graph_ontology(spark, d):
    """Applied twice: the second time changes nothing."""
    facts = ontology.ontology_facts(_ontologies(spark, d))
    nodes, edges = ontology.applied(*ontology.applied(*ontology.empty_graph(spark), facts), facts)
    none = F.lit("")
    as_rows = nodes.select("node_id", "label", "domain", none.alias("target_id"), F.lit("node").alias("relation"))
    return as_rows.unionByName(edges.select(F.col("source_id").alias("node_id"), none.alias("label"), none.alias("domain"), "target_id", "relation"))


def _specs(spark, d, version):
    """Suppliers as experts; in their second version, which every third has, one capability and one domain are others."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    cap = lambda i, on: F.struct(F.format_string("c%d-%d", F.col("s_suppkey"), F.lit(i)).alias("capability_id"), F.lit("does it").alias("description"), F.lit("").alias("domain"), F.array(F.lower("n_name")).alias("keywords"), F.array(*on).alias("operates_on"), F.array().cast("array<string>").alias("produces"), F.lit("slm").alias("tier_hint"))
    caps = F.array(cap(1, [F.lit("Order"), F.col("n_name")]), cap(1 + version, [F.lit("Part")]))
    over = F.create_map(F.col("n_name"), F.lit(0.9), F.concat(F.lit("other "), (F.col("s_nationkey") + version).cast("string")), F.lit(0.4))
    rows = s if version == 1 else s.where("s_suppkey % 3 = 0")
    return rows.select(F.concat(F.lit("x"), "s_suppkey").alias("expert_id"), F.col("n_name").alias("domain"), F.col("s_name").alias("description"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("m"), F.col("s_suppkey") % 7)).alias("model_id"), caps.alias("capabilities"), over.alias("authority"))


@query("""WITH s AS (SELECT 'x' || s_suppkey AS x, s_suppkey AS k, s_nationkey AS n, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey), v AS (SELECT s.*, 1 AS ver FROM s UNION ALL SELECT s.*, 2 FROM s WHERE k % 3 = 0),
c AS (SELECT *, 'c' || k || '-1' AS cap, ['Order', n_name] AS ons FROM v UNION ALL SELECT *, 'c' || k || '-' || (1 + ver), ['Part'] FROM v),
e AS (SELECT k, ver, 'expert:' || x AS source_id, 'belongs_to_domain' AS relation, 'domain:' || n_name AS target_id, 1.0::DOUBLE AS weight FROM v UNION SELECT k, ver, 'expert:' || x, 'backed_by_model', 'model:m' || (k % 7), 1 FROM v WHERE k % 4 > 0
 UNION SELECT k, ver, 'expert:' || x, 'provides_capability', 'capability:' || cap, 1 FROM c UNION SELECT k, ver, 'capability:' || cap, 'belongs_to_domain', 'domain:' || n_name, 1 FROM c
 UNION SELECT k, ver, 'capability:' || cap, 'operates_on', 'entity_type:' || unnest(ons), 1 FROM c UNION SELECT k, ver, 'expert:' || x, 'has_authority_over', 'domain:' || n_name, 0.9 FROM v UNION SELECT k, ver, 'expert:' || x, 'has_authority_over', 'domain:other ' || (n + ver), 0.4 FROM v)
SELECT source_id, relation, target_id, any_value(weight) AS weight, k % 3 = 0 AND max(ver) = 1 AS removed FROM e GROUP BY k, source_id, relation, target_id""")
def graph_register(spark, d):
    """Every expert is registered, a third of them anew: what these no longer declare becomes a tombstone."""
    graph = ontology.applied(*ontology.empty_graph(spark), ontology.expert_facts(_specs(spark, d, 1)))
    _, edges = ontology.applied(*graph, ontology.expert_facts(_specs(spark, d, 2)), prune=True)
    return edges.select("source_id", "relation", "target_id", "weight", "removed")


def _packs(spark, d):
    """A pack for each customer with a key: its nation's ontology, or none in every 25th, some experts, and in most something wrong, by its number."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text, none = (lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])), F.lit(None).cast("string")
    entity = lambda name, parent: F.struct(name.alias("name"), parent.alias("parent"))
    entities = F.array(
        entity(F.lit("Order"), F.when(k % 12 == 1, "Line").when(k % 12 == 2, "Order")), entity(F.lit("Line"), F.when(k % 12 == 3, F.lit("Box")).otherwise("Order")),
        entity(F.when(k % 12 == 4, "Line").otherwise("Part"), none),
    )
    relations = F.array(F.struct(F.lit("has").alias("name"), F.lit("Order").alias("source"), F.when(k % 12 == 5, "Gone").otherwise("Line").alias("target")))
    cap = lambda name, on, said: F.struct(name.alias("id"), said.alias("description"), F.array().cast("array<string>").alias("examples"), F.array(on).alias("operates_on"))
    expert = lambda name, domain, model, caps, more: F.struct(name.alias("id"), domain.alias("domain"), model.alias("model"), caps.alias("capabilities"), F.array(more).alias("retrieval_domains"))
    one = expert(F.lit("a"), text("d", n), F.when(k % 12 == 6, "m9").otherwise("m1"), F.array(cap(F.lit("c1"), F.when(k % 12 == 7, "Void").otherwise("Order"), F.when(k % 12 == 8, "").otherwise("yes"))), text("d", n))
    other = expert(F.when(k % 12 == 9, "a").otherwise("b"), F.when(k % 12 == 10, "nowhere").otherwise(text("d", n)), F.lit(""), F.array(cap(F.when(k % 12 == 11, "c1").otherwise("c2"), F.lit("Line"), F.lit("yes"))), F.when(k % 24 == 0, "far").otherwise(text("d", n)))
    lone = expert(F.lit("z"), text("d", n), F.lit("m2"), F.array().cast("array<struct<id:string,description:string,examples:array<string>,operates_on:array<string>>>"), text("d", n))
    defaults = F.create_map(F.lit("expert_model"), F.lit("m2"), F.lit("router_model"), F.when(k % 24 == 1, "m8").otherwise(""))
    ontologies = F.when(k % 25 == 24, F.array().cast("array<struct<domain:string,entities:array<struct<name:string,parent:string>>,relations:array<struct<name:string,source:string,target:string>>>>")).otherwise(F.array(F.struct(text("d", n).alias("domain"), entities.alias("entities"), relations.alias("relations"))))
    return dealt(table(spark, d, "customer").where("c_custkey is not null").select("c_custkey", "c_nationkey"), 10_000, "c_custkey").select(k.alias("pack_id"), ontologies.alias("ontologies"), F.when(k % 24 == 2, F.array(one, other, lone)).otherwise(F.array(one, other)).alias("experts"), F.array(F.lit("m1")).alias("models"), defaults.alias("defaults"))


@query("""WITH c AS (SELECT c_custkey AS k, 'd' || c_nationkey AS d FROM customer), o AS (SELECT *, 'ontology ''' || d || ''': ' AS head FROM c WHERE k % 25 <> 24),
n AS (SELECT *, CASE WHEN k % 12 = 9 THEN 'a' ELSE 'b' END AS other FROM c WHERE k % 25 = 24), x AS (SELECT k, d, 'a' AS id FROM n UNION ALL SELECT k, d, other FROM n UNION ALL SELECT k, d, 'z' FROM n WHERE k % 24 = 2)
SELECT k AS pack_id, head || 'subclass cycle involving ''Order'' via ''Line''' AS problem FROM o WHERE k % 12 = 1 UNION ALL SELECT k, head || 'subclass cycle involving ''Line'' via ''Order''' FROM o WHERE k % 12 IN (1, 2)
UNION ALL SELECT k, head || 'subclass cycle involving ''Order'' via ''Order''' FROM o WHERE k % 12 = 2 UNION ALL SELECT k, head || 'entity ''Order'' is its own parent' FROM o WHERE k % 12 = 2
UNION ALL SELECT k, head || 'entity ''Line'' declares unknown parent ''Box''' FROM o WHERE k % 12 = 3 UNION ALL SELECT k, head || 'duplicate entity type ''Line''' FROM o WHERE k % 12 = 4 UNION ALL SELECT k, head || 'relation ''has'' has unknown target ''Gone''' FROM o WHERE k % 12 = 5
UNION ALL SELECT k, 'expert ''a'' is bound to model ''m9'', which is neither declared in this pack nor registered' FROM c WHERE k % 12 = 6 UNION ALL SELECT k, 'expert ''a'' capability ''c1'' operates on ''Void'', which the ontology does not define' FROM c WHERE k % 12 = 7
UNION ALL SELECT k, 'capability ''c1'' has neither a description nor examples; the router has no signal to match it' FROM c WHERE k % 12 = 8 UNION ALL SELECT k, 'duplicate expert id ''a''' FROM c WHERE k % 12 = 9
UNION ALL SELECT k, 'expert ''b'' declares domain ''nowhere'', which no ontology in this pack defines' FROM c WHERE k % 12 = 10 UNION ALL SELECT k, 'capability ''c1'' is declared by both ''a'' and ''b''; capability ids must be unique so routing is unambiguous' FROM c WHERE k % 12 = 11
UNION ALL SELECT k, 'expert ''b'' retrieves from domain ''far'', which this pack does not define' FROM c WHERE k % 24 = 0 UNION ALL SELECT k, 'defaults.router_model points at unknown model ''m8''' FROM c WHERE k % 24 = 1
UNION ALL SELECT k, 'expert ''z'' declares no capabilities' FROM c WHERE k % 24 = 2
UNION ALL SELECT k, 'pack declares no ontology; the router has nothing to match on' FROM n UNION ALL SELECT k, 'expert ''' || id || ''' declares domain ''' || d || ''', which no ontology in this pack defines' FROM x WHERE NOT (id = 'b' AND k % 12 = 10)
UNION ALL SELECT k, 'expert ''' || id || ''' retrieves from domain ''' || d || ''', which this pack does not define' FROM x WHERE NOT (id = 'b' AND k % 24 = 0) UNION ALL SELECT k, 'expert ''a'' capability ''c1'' operates on ''Order'', which the ontology does not define' FROM n WHERE k % 12 <> 7
UNION ALL SELECT k, 'expert ''' || other || ''' capability ''' || CASE WHEN k % 12 = 11 THEN 'c1' ELSE 'c2' END || ''' operates on ''Line'', which the ontology does not define' FROM n""")
def pack_validate(spark, d):
    return ontology.pack_problems(_packs(spark, d), spark.createDataFrame([("m2",)], "model_id string"))
