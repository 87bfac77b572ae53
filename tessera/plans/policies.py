"""Declared rules of deliveries and estates: the policy matrix, the fixed plan of a delivery, bindings, structure budgets."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import TopologicalSorter

# What each delivery mode admits, and the patterns of a delivery plan.
PROGRESS = {"cdc": {"sequence"}, "append_only": {"sequence", "opaque_batch"}, "complete_snapshot": {"opaque_batch"}}
DELETES = {"cdc": {"none", "explicit_tombstone"}, "append_only": {"none"}, "complete_snapshot": {"snapshot_diff"}}
REQUIRED_TIME = {"cdc": "event_field", "complete_snapshot": "effective_field"}
MANDATORY = ["batch_ingestion", "data_validation", "data_contracts", "lineage_capture", "metadata_capture", "schema_publish", "data_publish", "checkpoint_retries"]
OPTIONAL = ["batch_transfer"]
FORBIDDEN = ["schema_transform", "calculated_fields", "data_enrichment", "data_filtering", "data_aggregation", "data_curation"]
STEPS = {
    "ingest": [], "validate": ["ingest"], "contract": ["validate"], "schema": ["contract"], "publish": ["validate", "contract", "schema"],
    "lineage": ["ingest", "validate", "publish"], "metadata": ["contract", "validate", "publish"],
}


@dataclass
class Delivery:
    """A declared delivery. Times name fields; minutes and seconds are whole numbers."""

    mode: str
    progress: str
    deletes: str = "none"
    event_field: str | None = None
    effective_field: str | None = None
    tombstone: dict | None = None
    snapshot: dict | None = None
    record_key: list[str] = field(default_factory=list)
    fingerprint_scope: dict | None = None
    hmac_key: str | None = None
    on_error: str = "all_or_nothing"
    max_error_share: str = "0"
    late_minutes: tuple[int, int] = (30, 60)
    age_minutes: tuple[int, int] | None = None
    retry_seconds: tuple[int, int] = (1, 60)


def violations(d: Delivery) -> list[str]:
    """Every rule of the matrix that a delivery breaks; none if it may run."""
    if d.mode not in PROGRESS:
        return [f"unknown mode {d.mode}"]
    keyed = d.deletes in ("explicit_tombstone", "snapshot_diff")
    prints = (d.fingerprint_scope is not None, d.hmac_key is not None)
    time = REQUIRED_TIME.get(d.mode)
    rules = {
        f"progress {d.progress} is not for {d.mode}": d.progress not in PROGRESS[d.mode],
        f"deletes {d.deletes} are not for {d.mode}": d.deletes not in DELETES[d.mode],
        f"{d.mode} needs {time}": time is not None and getattr(d, time) is None,
        "explicit tombstones, and these alone, have a tombstone block": (d.deletes == "explicit_tombstone") != (d.tombstone is not None),
        "snapshot diffs, and these alone, have a snapshot block": (d.deletes == "snapshot_diff") != (d.snapshot is not None),
        "a record key is needed": not d.record_key,
        "a record key names a field twice": len(set(d.record_key)) < len(d.record_key),
        f"deletes {d.deletes} need a fingerprint scope and a key": keyed and not all(prints),
        "without deletes there is no fingerprint": d.deletes == "none" and any(prints),
        "the snapshot's scope is the fingerprint's": d.snapshot is not None and d.fingerprint_scope is not None and d.snapshot.get("scope") != d.fingerprint_scope,
        "valid rows alone are published only of opaque batches that are appended": d.on_error == "publish_valid_rows" and (d.mode, d.progress) != ("append_only", "opaque_batch"),
        "all or nothing allows no errors": d.on_error == "all_or_nothing" and d.max_error_share != "0",
        "lateness warns before it fails": d.late_minutes[0] >= d.late_minutes[1],
        "age warns before it fails": d.age_minutes is not None and d.age_minutes[0] >= d.age_minutes[1],
        "the cap of retries is below their base": d.retry_seconds[1] < d.retry_seconds[0],
    }
    return [text for text, broken in rules.items() if broken]


def execution_plan(requested: list[str]) -> list[str]:
    """The steps of a delivery in order: always the same graph, inside one wrapper of checkpoints and retries.

    requested: patterns beside the mandatory ones; forbidden ones would transform what a delivery must keep as it came.
    """
    known = {*MANDATORY, *OPTIONAL, *FORBIDDEN}
    if unknown := sorted(set(requested).difference(known)):
        raise ValueError(f"unknown patterns: {unknown}")
    if bad := sorted(set(requested).intersection(FORBIDDEN)):
        raise ValueError(f"patterns that a delivery can't hold: {bad}")
    order = TopologicalSorter({step: sorted(before) for step, before in STEPS.items()})
    return list(order.static_order())


@dataclass(frozen=True)
class NodeBinding:
    entity: str
    table: str
    keys: tuple[str, str]
    origin: str  # golden record or hub


@dataclass(frozen=True)
class EdgeBinding:
    verb: str
    table: str
    key: str
    source: str
    target: str
    source_key: str
    target_key: str


def bind(golden: dict[str, tuple[str, str, str]], hubs: dict[str, tuple[str, str, str]], links: dict[str, tuple], tables: dict[str, list[str]]) -> tuple[list[NodeBinding], list[EdgeBinding]]:
    """Nodes and edges of a graph over physical tables.

    golden, hubs: entity -> (table, hash key, natural key); an entity takes its golden record, else its hub. links: verb ->
    (table, key, source entity, target entity, source key, target key); edges need a link table of their own. tables: the
    columns that exist; whatever is declared and not there is an error that names it.
    """
    nodes = {}
    for entity in sorted({*golden, *hubs}):
        origin, (table, *keys) = ("golden", golden[entity]) if entity in golden else ("hub", hubs[entity])
        _exists(entity, table, keys, tables)
        nodes[entity] = NodeBinding(entity, table, tuple(keys), origin)
    edges = []
    for verb, (table, key, source, target, source_key, target_key) in sorted(links.items()):
        if missing := [e for e in (source, target) if e not in nodes]:
            raise ValueError(f"{verb}: no node for {missing}")
        _exists(verb, table, [key, source_key, target_key], tables)
        edges.append(EdgeBinding(verb, table, key, source, target, source_key, target_key))
    return list(nodes.values()), edges


def _exists(what: str, table: str, columns: list[str], tables: dict[str, list[str]]) -> None:
    if table not in tables:
        raise ValueError(f"{what}: no table {table!r}")
    if missing := [c for c in columns if c not in tables[table]]:
        raise ValueError(f"{what}: {table} has no columns {missing}")


@dataclass
class Model:
    """A model as planned: what it reads, how it is stored, and its statement."""

    name: str
    reads: list[str]
    stored: str  # table or view
    statement: str = ""
    interface: bool = False  # views are allowed at declared interfaces


def structure_faults(models: list[Model], max_view_chain: int = 1, max_statement_bytes: int = 262_144, max_name: int = 255) -> list[tuple[str, str, int, int]]:
    """(budget, model, measured, limit) of every model beyond a budget: views outside interfaces, chains of views,
    statements and names that are too long."""
    by_name = {m.name: m for m in models}
    depth: dict[str, int] = {}
    for name in TopologicalSorter({m.name: [r for r in m.reads if r in by_name] for m in models}).static_order():
        below = max((depth[r] for r in by_name[name].reads if r in by_name), default=0)
        depth[name] = below + 1 if by_name[name].stored == "view" else 0
    out = []
    for m in models:
        measured = [
            ("view_boundary", int(m.stored == "view" and not m.interface), 0), ("max_view_chain", depth[m.name], max_view_chain),
            ("max_statement_bytes", len(m.statement.encode()), max_statement_bytes), ("max_name", len(m.name), max_name),
        ]
        out += [(budget, m.name, n, limit) for budget, n, limit in measured if n > limit]
    return out
