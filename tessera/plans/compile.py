"""Declarations compiled to DataFrame plans: sources, their projections and vault entities, and the domain's entities.

A declaration is checked before anything is planned; every gate raises ValueError with the part it found at fault.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import blank_to_null, normalise_name, normalise_prefixed_id, safe_cast, type_of
from tessera.operators import resolution, survivorship, vault
from tessera.operators.relational import tagged_union

RULES = ("plain", "blank_to_null", "normalise_name", "normalise_prefixed_id")


@dataclass
class Column_:
    """One output of a staging projection: from a raw column by a rule, then typed."""

    name: str
    source: str
    token: str = "string"
    rule: str = "plain"
    prefix: str = ""

    def expression(self) -> Column:
        raw = F.col(self.source)
        if self.rule == "blank_to_null":
            raw = blank_to_null(raw)
        elif self.rule == "normalise_name":
            raw = normalise_name(raw)
        elif self.rule == "normalise_prefixed_id":
            raw = normalise_prefixed_id(raw, self.prefix)
        return safe_cast(raw, self.token).alias(self.name)


@dataclass
class Source:
    """A feed's table: its projection, record id, match keys and payload."""

    name: str
    table: str
    columns: list[Column_]
    record_id: str
    entity: str
    effective: str
    payload: list[str]
    excluded: list[str] = field(default_factory=list)


@dataclass
class Entity:
    """A hub with ranked match keys, transitive or not, and survivorship rules."""

    name: str
    ranked: list[str]
    rules: list[survivorship.Rule]
    transitive: bool = False


@dataclass
class Domain:
    entities: list[Entity]
    sources: list[Source]

    def entity(self, name: str) -> Entity:
        for e in self.entities:
            if e.name == name:
                return e
        raise ValueError(f"no entity {name!r}")

    def of(self, entity: str) -> list[Source]:
        return [s for s in self.sources if s.entity == entity]


def check(domain: Domain) -> None:
    names = [e.name for e in domain.entities]
    if len(set(names)) < len(names):
        raise ValueError("an entity is declared twice")
    for s in domain.sources:
        made = {c.name for c in s.columns}
        if s.entity not in names:
            raise ValueError(f"{s.name}: unknown entity {s.entity!r}")
        for c in s.columns:
            type_of(c.token)
            if c.rule not in RULES:
                raise ValueError(f"{s.name}.{c.name}: unknown rule {c.rule!r}")
            if c.rule == "normalise_prefixed_id" and not c.prefix:
                raise ValueError(f"{s.name}.{c.name}: a prefix is missing")
        if missing := {s.record_id, s.effective, *s.payload}.difference(made):
            raise ValueError(f"{s.name}: not projected: {sorted(missing)}")
        vault.payload(s.payload, s.excluded)
    for e in domain.entities:
        branches = domain.of(e.name)
        if not branches:
            raise ValueError(f"{e.name}: no source")
        made = {c.name for s in branches for c in s.columns}
        if missing := set(e.ranked).difference(made):
            raise ValueError(f"{e.name}: no source has keys {sorted(missing)}")
        survivorship.check(e.rules, {s.name: None for s in branches})


@dataclass
class Built:
    """The frames that one entity's declaration gives, from staging to the golden record."""

    staged: dict[str, DataFrame]
    resolved: DataFrame
    hub: DataFrame
    satellites: dict[str, DataFrame]
    golden: DataFrame


def build(domain: Domain, entity: str, tables: dict[str, DataFrame], loaded: Column) -> Built:
    """Plan staging, resolution, hub, satellites and golden record of an entity over raw tables."""
    check(domain)
    e, branches = domain.entity(entity), domain.of(entity)
    staged = {s.name: tables[s.table].select(*[c.expression() for c in s.columns]) for s in branches}
    candidates = {}
    for s in branches:
        have = {c.name for c in s.columns}
        keys = [F.col(k) if k in have else F.lit(None).cast("string").alias(k) for k in e.ranked]
        candidates[s.name] = staged[s.name].select(F.col(s.record_id).cast("string").alias("source_record_id"), *keys)
    union = tagged_union(candidates)
    if e.transitive:
        union = union.withColumn("record", F.concat_ws(":", "source_system", "source_record_id"))
        resolved = resolution.transitive(union, e.name, e.ranked)
    else:
        resolved = resolution.ranked_keys(union, e.name, e.ranked)
    hubs, satellites, key = [], {}, f"hub_{e.name}_hk"
    for s in branches:
        own = resolved.where(F.col("source_system") == s.name).select(F.col("source_record_id").alias(s.record_id), "golden_key")
        met = vault.bridge(staged[s.name].withColumn(s.record_id, F.col(s.record_id).cast("string")), {e.name: (own, [s.record_id])})
        rows = vault.stage(met, {key: [f"{e.name}_golden_key"]}, vault.payload(s.payload, s.excluded), s.name, loaded)
        hubs.append(rows.withColumnRenamed(f"{e.name}_golden_key", "golden_key"))
        satellites[s.name] = vault.load_satellite(rows, key, s.payload, s.effective).withColumnRenamed(s.effective, "effective_from")
    hub = vault.load_hub(hubs, key, ["golden_key"])
    return Built(staged, resolved, hub, satellites, survivorship.golden_record(hub, satellites, e.rules, key))
