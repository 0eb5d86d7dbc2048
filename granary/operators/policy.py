"""Declarative access policies, compiled to one Column: the first match in order decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sensitivity levels, least strict first; an unknown level counts as internal.
LEVELS = ["public", "internal", "confidential", "restricted"]
# Effects in the order in which they are tried.
EFFECTS = ["deny", "require_approval", "allow"]


@dataclass(frozen=True)
class Policy:
    id: str
    effect: str
    priority: int = 100
    subjects: Sequence[str] = ()
    resources: Sequence[str] = ()
    actions: Sequence[str] = ()
    when_claims: Sequence[str] = ()
    unless_claims: Sequence[str] = ()
    points: Sequence[str] = ()
    tenants: Sequence[str] = ()
    enabled: bool = True


def level_rank(level: Column | str) -> Column:
    at = F.array_position(F.array(*map(F.lit, LEVELS)), level if isinstance(level, Column) else F.lit(level))
    return F.when(at > 0, at - 1).otherwise(1).cast("int")


def strictest(levels: Column) -> Column:
    """The strictest level of an array; internal if it is empty."""
    top = F.array_max(F.transform(levels, level_rank))
    return F.when(F.size(levels) > 0, F.get(F.array(*map(F.lit, LEVELS)), top)).otherwise("internal")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def subject_matches(selector: str) -> Column:
    kind, _, name = selector.strip().partition(":")
    if selector.strip() in ("*", ""):
        return F.lit(True)
    column = {"expert": "expert_id", "domain": "domain", "principal": "principal"}.get(kind)
    return F.col(column) == name if column and name else F.col("expert_id") == selector.strip()


def resource_matches(selector: str) -> Column:
    kind, _, name = selector.strip().partition(":")
    if selector.strip() in ("*", ""):
        return F.lit(True)
    if kind == "sensitivity":
        return level_rank(F.col("sensitivity")) >= level_rank(name)
    if kind == "entity":
        return F.array_contains("entities", name)
    if kind == "domain":
        return F.coalesce(F.nullif("resource_domain", F.lit("")), "domain") == name
    if kind in ("capability", "model"):
        return F.col({"capability": "capability_id", "model": "model_id"}[kind]) == name
    return F.col("resource_id") == selector.strip()


def in_order(policies: Sequence[Policy], point: str = "", tenant: str = "default") -> list[Policy]:
    """Those that apply, deny first, then by priority from the largest, then by id."""
    own = [p for p in policies if p.enabled and (not p.points or point in p.points) and (not p.tenants or tenant in p.tenants)]
    return sorted(own, key=lambda p: (EFFECTS.index(p.effect), -p.priority, p.id))


def applies(point: str = "", tenant: str = "default") -> Column:
    """Whether a row of a policy table (enabled, points, tenants) is on and names the point and the tenant, or none; null lists name none."""
    open_to = lambda c, own: (F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0) | F.array_contains(c, own)
    return F.coalesce(F.col("enabled"), F.lit(True)) & open_to(F.col("points"), point) & open_to(F.col("tenants"), tenant)


def ordered(policies: DataFrame, group: str, id_col: str, *, point: str = "", tenant: str = "default") -> DataFrame:
    """policies (group, id_col, effect, priority, enabled, points, tenants) that apply, with the place from 1 in which their group tries them: as in_order has it. An unknown effect comes last."""
    effect = F.array_position(F.array(*map(F.lit, EFFECTS)), F.col("effect"))
    order = [F.when(effect > 0, effect).otherwise(len(EFFECTS) + 1), F.desc("priority"), F.asc(id_col)]
    return policies.where(applies(point, tenant)).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def decision(policies: Sequence[Policy], *, point: str = "", tenant: str = "default", default: str = "allow") -> Column:
    """struct(effect, policy_id) of the first policy that matches a row's subject, resource, action and claims; default where none does."""
    tests = []
    for p in in_order(policies, point, tenant):
        hit = _any([subject_matches(s) for s in p.subjects or ("*",)]) & _any([resource_matches(s) for s in p.resources or ("*",)])
        if p.actions:
            hit = hit & (F.col("action").isin(*p.actions) | F.lit("*" in p.actions))
        for c in p.when_claims:
            hit = hit & F.array_contains("claims", c)
        if p.unless_claims:
            hit = hit & ~F.arrays_overlap("claims", F.array(*map(F.lit, p.unless_claims)))
        tests.append(F.when(hit, F.struct(F.lit(p.effect).alias("effect"), F.lit(p.id).alias("policy_id"))))
    return F.coalesce(*tests, F.struct(F.lit(default).alias("effect"), F.lit("").alias("policy_id")))


def resource_label() -> Column:
    """Tagged parts of a row's resource, the first four entities among them; * if there is none."""
    part = lambda tag, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(tag), F.col(c)))
    entities = F.when(F.size("entities") > 0, F.concat(F.lit("entity:"), F.array_join(F.slice("entities", 1, 4), ",")))
    label = F.concat_ws(" ", part("domain:", "resource_domain"), part("capability:", "capability_id"), part("model:", "model_id"), entities, part("sensitivity:", "sensitivity"), part("", "resource_id"))
    return F.when(label == "", "*").otherwise(label)
