"""Ontologies and experts onto a property graph, and the checks of a pack of both.

A graph is nodes (node_id, kind, key, label, description, domain, attributes, owner, removed) and edges (source_id, relation,
target_id, weight, attributes, owner, removed); a node's id is kind:key, attributes are JSON, owner is the spec that declared
the row, and removed rows are tombstones. A nested spec fans out to one table of facts, each a node or an edge, in one pass.
Nodes that an edge needs are made if neither the graph nor the batch has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import ancestors

NODE = "struct<node_id:string,kind:string,key:string,label:string,description:string,domain:string,attributes:string>"
EDGE = "struct<source_id:string,relation:string,target_id:string,weight:double,attributes:string>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _node(kind: str, key: Column, domain: Column, label: Column | None = None, description: Column | None = None, attributes: Column | None = None, made: bool = False) -> Column:
    """A fact: a node, made where it is only there because an edge needs it."""
    name = key if label is None else F.coalesce(F.nullif(label, F.lit("")), key)
    own = F.struct(F.concat(F.lit(kind + ":"), key).alias("node_id"), F.lit(kind).alias("kind"), key.alias("key"), name.alias("label"), _text(F.lit("") if description is None else description).alias("description"), domain.alias("domain"), (F.lit("{}") if attributes is None else F.to_json(attributes)).alias("attributes"))
    return F.struct(F.lit(made).alias("made"), own.cast(NODE).alias("node"), F.lit(None).cast(EDGE).alias("edge"))


def _edge(source: tuple[str, Column], relation: str, target: tuple[str, Column], weight: Column | None = None, attributes: Column | None = None) -> Column:
    end = lambda e: F.concat(F.lit(e[0] + ":"), e[1])
    own = F.struct(end(source).alias("source_id"), F.lit(relation).alias("relation"), end(target).alias("target_id"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"), (F.lit("{}") if attributes is None else F.to_json(attributes)).alias("attributes"))
    return F.struct(F.lit(False).alias("made"), F.lit(None).cast(NODE).alias("node"), own.cast(EDGE).alias("edge"))


def _facts(specs: DataFrame, owner: Column, order: str, parts: list[Column]) -> DataFrame:
    """(owner, order, place, made, node, edge); a later order, and of one spec a later place, comes after."""
    each = specs.select(owner.alias("owner"), F.col(order).alias("order"), F.posexplode(F.concat(*parts)).alias("place", "f"))
    return each.select("owner", "order", "place", "f.made", "f.node", "f.edge")


def ontology_facts(specs: DataFrame, order: str = "domain") -> DataFrame:
    """Facts of specs (domain, label, description, version, entities, relations).

    entities are structs (name, label, description, parent, keywords, sensitivity), relations (name, source, target,
    cardinality). An entity belongs to its domain and may be a subclass; two relations between the same ends overwrite each
    other, the later one stays.
    """
    domain, no_facts = F.col("domain"), F.array().cast(f"array<struct<made:boolean,node:{NODE},edge:{EDGE}>>")
    own = F.array(_node("domain", domain, domain, F.col("label"), F.col("description"), F.struct(F.col("version").alias("ontology_version"))))
    nodes = F.transform("entities", lambda e: _node("entity_type", e["name"], domain, e["label"], e["description"], F.struct(_text(e["parent"]).alias("parent"), e["keywords"].alias("keywords"), F.coalesce(e["sensitivity"], F.lit("internal")).alias("sensitivity"))))
    member = F.transform("entities", lambda e: _edge(("entity_type", e["name"]), "belongs_to_domain", ("domain", domain)))
    parent = F.transform(F.filter("entities", lambda e: _text(e["parent"]) != ""), lambda e: _edge(("entity_type", e["name"]), "subclass_of", ("entity_type", e["parent"])))
    related = F.transform("relations", lambda r: _edge(("entity_type", r["source"]), "related_to", ("entity_type", r["target"]), attributes=F.struct(r["name"].alias("name"), _text(r["cardinality"]).alias("cardinality"))))
    return _facts(specs, F.concat(F.lit("ontology:"), domain), order, [F.coalesce(x, no_facts) for x in (own, nodes, member, parent, related)])


def expert_facts(specs: DataFrame, order: str = "expert_id") -> DataFrame:
    """Facts of specs (expert_id, domain, description, model_id, capabilities, authority).

    capabilities are structs (capability_id, description, domain, keywords, operates_on, produces, tier_hint), authority is a
    map of domains to weights. Domains, models and entity types are made where there are none.
    """
    domain, me, no_facts = F.col("domain"), ("expert", F.col("expert_id")), F.array().cast(f"array<struct<made:boolean,node:{NODE},edge:{EDGE}>>")
    model = _text(F.col("model_id"))
    own = F.array(
        _node("domain", domain, domain, made=True), _node("expert", F.col("expert_id"), domain, None, F.col("description"), F.struct(model.alias("model_id"))), _edge(me, "belongs_to_domain", ("domain", domain)),
    )
    backed = F.when(model != "", F.array(_node("model", model, domain), _edge(me, "backed_by_model", ("model", model))))
    of = lambda c: F.coalesce(F.nullif(c["domain"], F.lit("")), domain)
    caps = F.transform("capabilities", lambda c: F.array(
        _node("capability", c["capability_id"], of(c), None, c["description"], F.struct(F.col("expert_id"), c["keywords"].alias("keywords"), c["operates_on"].alias("operates_on"), c["produces"].alias("produces"), c["tier_hint"].alias("tier_hint"))),
        _edge(me, "provides_capability", ("capability", c["capability_id"])), _edge(("capability", c["capability_id"]), "belongs_to_domain", ("domain", domain)),
    ))
    scope = F.transform("capabilities", lambda c: F.flatten(F.transform(F.coalesce(c["operates_on"], F.array().cast("array<string>")), lambda e: F.array(_node("entity_type", e, of(c), made=True), _edge(("capability", c["capability_id"]), "operates_on", ("entity_type", e))))))
    over = F.flatten(F.transform(F.map_entries("authority"), lambda a: F.array(_node("domain", a["key"], a["key"], made=True), _edge(me, "has_authority_over", ("domain", a["key"]), a["value"]))))
    return _facts(specs, F.concat(F.lit("expert:"), F.col("expert_id")), order, [F.coalesce(x, no_facts) for x in (own, backed, F.flatten(caps), F.flatten(scope), over)])


def _merged(old: DataFrame, new: DataFrame, keys: list[str], prune: bool) -> DataFrame:
    """old with new in place of the same keys; with prune, what the owners in new no longer declare becomes a tombstone.

    new has _rank: 0 for rows that are only made where there are none, 2 for declared ones, and _at, their order.
    """
    columns = [c for c in old.columns if c not in keys]
    kind = new.schema["_at"].dataType
    held = old.withColumn("_rank", F.lit(1)).withColumn("_at", F.lit(None).cast(kind)).withColumn("_had", F.col("owner"))
    fresh = new.withColumn("removed", F.lit(False)).withColumn("_had", F.lit(None).cast("string"))
    both = held.select(*keys, *columns, "_rank", "_at", "_had").unionByName(fresh.select(*keys, *columns, "_rank", "_at", "_had"))
    by = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("_rank", "_at")).alias("v"), F.max("_rank").alias("_rank"), F.max("_had").alias("_had"))
    out = by.select(*keys, *[F.col(f"v.{c}").alias(c) for c in columns], "_rank")
    if not prune:
        return out.drop("_rank")
    owners = new.where("_rank = 2").select(F.col("owner")).distinct().withColumn("_active", F.lit(True))
    stale = F.coalesce((F.col("_rank") == 1) & F.col("_active"), F.lit(False))
    return out.join(owners, "owner", "left").withColumn("removed", F.col("removed") | stale).select(*old.columns)


def applied(nodes: DataFrame, edges: DataFrame, facts: DataFrame, *, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph with the facts in it; applying them again changes nothing.

    Without prune what a spec declared before and no longer does stays, as in a graph that only adds; with it such nodes and
    edges become tombstones, unless another spec declared them since.
    """
    at = F.struct("order", "place").alias("_at")
    rank = F.when(F.col("made"), 0).otherwise(2).alias("_rank")
    own = F.when(F.col("made"), "").otherwise(F.col("owner")).alias("owner")
    new_nodes = facts.where("node is not null").select("node.*", own, rank, at)
    new_edges = facts.where("edge is not null").select("edge.*", "owner", rank, at)
    return _merged(nodes, new_nodes, ["node_id"], prune), _merged(edges, new_edges, ["source_id", "relation", "target_id"], prune)


def empty_graph(spark) -> tuple[DataFrame, DataFrame]:
    kinds = lambda s: s.removeprefix("struct<").removesuffix(">").replace(":", " ")
    return spark.createDataFrame([], kinds(NODE) + ", owner string, removed boolean"), spark.createDataFrame([], kinds(EDGE) + ", owner string, removed boolean")


# --- packs -----------------------------------------------------------------------------------------------------------


def _claim(role: str, space: str, name: Column, said: Column, owner: Column | None = None) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(space).alias("space"), name.alias("name"), said.alias("said"), (F.lit("") if owner is None else owner).alias("owner"))


def _said(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def claims(packs: DataFrame) -> DataFrame:
    """(pack_id, place, role, space, name, said, owner): all that a pack has, needs, or does wrong, as one long table.

    packs is (pack_id, ontologies, experts, models, defaults): ontologies are structs (domain, entities (name, parent),
    relations (name, source, target)), experts (id, domain, model, capabilities (id, description, examples, operates_on),
    retrieval_domains), models and the values of the map defaults are model ids.
    """
    inside = lambda o: F.concat(F.lit("entity:"), o["domain"])  # noqa: E731  entities are looked for within their ontology, too
    space = lambda role, where, name, said: F.struct(F.lit(role).alias("role"), where.alias("space"), name.alias("name"), said.alias("said"), F.lit("").alias("owner"))
    head = lambda o: F.concat(F.lit("ontology '"), o["domain"], F.lit("': "))
    ontologies, experts = F.coalesce("ontologies", F.array()), F.coalesce("experts", F.array())
    whole = F.array_compact(F.array(
        F.when(F.size(ontologies) == 0, _claim("wrong", "", F.lit(""), F.lit("pack declares no ontology; the router has nothing to match on"))),
        F.when(F.size(experts) == 0, _claim("wrong", "", F.lit(""), F.lit("pack declares no experts"))),
    ))
    of_ontology = F.flatten(F.transform("ontologies", lambda o: F.concat(
        F.array(_claim("has", "domain", o["domain"], F.lit(""))),
        F.coalesce(F.flatten(F.transform(o["entities"], lambda e: F.array_compact(F.array(
            _claim("has", "entity", e["name"], F.lit("")), space("has", inside(o), e["name"], F.concat(head(o), _said("duplicate entity type '%s'", e["name"]))),
            F.when(_text(e["parent"]) != "", space("needs", inside(o), e["parent"], F.concat(head(o), _said("entity '%s' declares unknown parent '%s'", e["name"], e["parent"])))),
            F.when(e["parent"] == e["name"], _claim("wrong", "", e["name"], F.concat(head(o), _said("entity '%s' is its own parent", e["name"])))),
        )))), F.array()),
        F.coalesce(F.flatten(F.transform(o["relations"], lambda r: F.array(
            space("needs", inside(o), r["source"], F.concat(head(o), _said("relation '%s' has unknown source '%s'", r["name"], r["source"]))),
            space("needs", inside(o), r["target"], F.concat(head(o), _said("relation '%s' has unknown target '%s'", r["name"], r["target"]))),
        ))), F.array()),
    )))
    of_expert = F.flatten(F.transform("experts", lambda x: F.concat(
        F.array_compact(F.array(
            _claim("has", "expert", x["id"], _said("duplicate expert id '%s'", x["id"])),
            _claim("needs", "domain", x["domain"], _said("expert '%s' declares domain '%s', which no ontology in this pack defines", x["id"], x["domain"])),
            F.when(F.coalesce(F.size(x["capabilities"]), F.lit(0)) <= 0, _claim("wrong", "", x["id"], _said("expert '%s' declares no capabilities", x["id"]))),
            F.when(_text(x["model"]) != "", _claim("needs", "model", x["model"], _said("expert '%s' is bound to model '%s', which is neither declared in this pack nor registered", x["id"], x["model"]))),
        )),
        F.transform(F.coalesce(x["retrieval_domains"], F.array().cast("array<string>")), lambda n: _claim("needs", "domain", n, _said("expert '%s' retrieves from domain '%s', which this pack does not define", x["id"], n))),
        F.coalesce(F.flatten(F.transform(x["capabilities"], lambda c: F.concat(
            F.array_compact(F.array(
                _claim("has", "capability", c["id"], F.lit(""), x["id"]),
                F.when((_text(c["description"]) == "") & (F.coalesce(F.size(c["examples"]), F.lit(0)) <= 0), _claim("wrong", "", c["id"], _said("capability '%s' has neither a description nor examples; the router has no signal to match it", c["id"]))),
            )),
            F.transform(F.coalesce(c["operates_on"], F.array().cast("array<string>")), lambda e: _claim("needs", "entity", e, _said("expert '%s' capability '%s' operates on '%s', which the ontology does not define", x["id"], c["id"], e))),
        ))), F.array()),
    )))
    of_models = F.transform("models", lambda m: _claim("has", "model", m, F.lit("")))
    of_defaults = F.transform(F.filter(F.map_entries("defaults"), lambda v: _text(v["value"]) != ""), lambda v: _claim("needs", "model", v["value"], _said("defaults.%s points at unknown model '%s'", v["key"], v["value"])))
    parts = [whole, *[F.coalesce(x, F.array()) for x in (of_ontology, of_expert, of_models, of_defaults)]]
    return packs.select("pack_id", F.posexplode(F.concat(*parts)).alias("place", "c")).select("pack_id", "place", "c.*")



def pack_problems(packs: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """(pack_id, problem) of packs as in claims: duplicates, unknown references, lacks, and subclass cycles, all of them at once.

    registered (model_id) are models known besides a pack's own. Problems that are worded alike are given once for each time
    they occur; a pack without problems has no row.
    """
    # One sort by name within a pack: what has it comes first, so a need is met if the first row has it, and a repeat follows the one before.
    same = Window.partitionBy("pack_id", "space", "name").orderBy("role", "place")
    at = claims(packs).withColumns({"before": F.lag("owner").over(same), "first": F.first("role").over(same)})
    named = F.col("pack_id").isNotNull() & F.col("space").isNotNull() & F.col("name").isNotNull()
    needs = F.col("role") == "needs"
    again = (F.col("role") == "has") & (F.col("space").isin("expert", "capability") | F.col("space").startswith("entity:")) & F.col("before").isNotNull()
    bad = at.where((F.col("role") == "wrong") | (needs & ~((F.col("first") == "has") & named)) | again)
    if registered is not None:
        known = registered.select(F.lit("model").alias("_space"), F.col("model_id").alias("_name")).distinct()
        bad = bad.withColumn("_space", F.when(needs, F.col("space"))).withColumn("_name", F.when(needs, F.col("name"))).join(known, ["_space", "_name"], "left_anti")
    owned_twice = F.format_string("capability '%s' is declared by both '%s' and '%s'; capability ids must be unique so routing is unambiguous", "name", "before", "owner")
    problem = F.when((F.col("role") == "has") & (F.col("space") == "capability"), owned_twice).otherwise(F.col("said"))
    return bad.select("pack_id", problem.alias("problem")).unionByName(_subclass_cycles(packs))


def _onward(up: DataFrame) -> DataFrame:
    """up (pack_id, n, domain, name, parent) without the rows whose parent has no parent, as these lead into no cycle."""
    ends = F.array(F.struct(F.col("name").alias("key"), F.lit(None).cast("string").alias("below")), F.struct(F.col("parent").alias("key"), F.col("name").alias("below")))
    each = up.select("pack_id", "n", "domain", F.explode(ends).alias("e")).select("pack_id", "n", "domain", "e.key", "e.below")
    has_parent = F.max(F.col("below").isNull()).over(Window.partitionBy("pack_id", "n", "domain", "key"))
    return each.withColumn("_on", has_parent).where(F.col("_on") & F.col("below").isNotNull()).select("pack_id", "n", "domain", F.col("below").alias("name"), F.col("key").alias("parent"))


def _subclass_cycles(packs: DataFrame) -> DataFrame:
    """A problem for each entity from which its parents lead into a cycle, with the parent where the walk closes; an entity's first declaration counts."""
    each = packs.select("pack_id", F.posexplode("ontologies").alias("n", "o")).select("pack_id", "n", F.col("o.domain").alias("domain"), F.posexplode("o.entities").alias("place", "e"))
    first = each.groupBy("pack_id", "n", "domain", F.col("e.name").alias("name")).agg(F.min_by("e.parent", "place").alias("parent"))
    key = lambda c: F.to_json(F.struct("pack_id", "n", F.col(c).alias("name")))
    up = _onward(first.where(F.coalesce("parent", F.lit("")) != "")).select("pack_id", "domain", "name", "parent", key("name").alias("own"), key("parent").alias("up"))
    over = ancestors(up.select(F.col("own").alias("name"), F.col("up").alias("parent")))
    on_cycle = over.where("name = ancestor").select(F.col("name").alias("ancestor"))
    entered = over.join(on_cycle, "ancestor", "left_semi").groupBy("name").agg(F.min_by("ancestor", "steps").alias("entry"), F.max((F.col("name") == F.col("ancestor")).cast("int")).alias("on"))
    found = up.join(entered.withColumnRenamed("name", "own"), "own")
    via = F.when(F.col("on") == 1, F.col("parent")).otherwise(F.get_json_object("entry", "$.name"))
    return found.select("pack_id", F.concat(F.lit("ontology '"), F.col("domain"), F.format_string("': subclass cycle involving '%s' via '%s'", F.col("name"), via)).alias("problem"))
