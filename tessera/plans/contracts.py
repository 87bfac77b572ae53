"""Boundary artefacts: contracts from schemas, their evolution, descriptors and importers of table definitions."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_LOGICAL = {"string": "string", "bigint": "integer", "int": "integer", "double": "number", "date": "date", "timestamp": "timestamp", "boolean": "boolean", "binary": "string"}


def contract(df: DataFrame, name: str, version: str, keys: list[str], checks: dict[str, list[str]] | None = None) -> dict:
    """A data contract of df: properties with logical types, keys, nullability and quality rules."""
    properties = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        logical = "number" if kind.startswith("decimal") else "array" if kind.startswith("array") else "object" if kind.startswith(("struct", "map")) else _LOGICAL.get(kind, "string")
        properties.append({
            "name": f.name, "logicalType": logical, "physicalType": kind, "required": not f.nullable or f.name in keys,
            "primaryKey": f.name in keys, "quality": [{"rule": r} for r in (checks or {}).get(f.name, [])],
        })
    return {"apiVersion": "v3.0.2", "kind": "DataContract", "id": name, "version": version, "schema": [{"name": name, "properties": properties}]}


def product_descriptor(name: str, version: str, contracts: list[dict], inputs: list[str]) -> dict:
    return {
        "apiVersion": "v1.0.0", "kind": "DataProduct", "id": name, "version": version, "inputPorts": [{"name": i} for i in inputs],
        "outputPorts": [{"name": c["id"], "version": c["version"], "contractId": c["id"]} for c in contracts],
    }


def schema_of(odcs: dict) -> StructType:
    """The Spark schema that a contract's first object declares."""
    names = {"string": "string", "integer": "bigint", "number": "double", "date": "date", "timestamp": "timestamp", "boolean": "boolean", "object": "string"}
    out = StructType()
    for p in odcs["schema"][0]["properties"]:
        kind = p.get("physicalType") or names.get(p.get("logicalType", "string"))
        if kind is None:
            raise ValueError(f"{p['name']}: unknown type")
        (column,) = StructType.fromDDL(f"`{p['name']}` {kind}").fields
        out.add(p["name"], column.dataType, not p.get("required", False))
    return out


def canonical_digest(value: object) -> str:
    """sha256 of canonical JSON: keys in order, no spaces, no floats."""

    def plain(x: object) -> object:
        if isinstance(x, float):
            raise ValueError("floats have no canonical form here")
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x

    return hashlib.sha256(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def evolution(old: dict, new: dict) -> str:
    """none, patch (words), minor (columns added that may be null, other quality rules), major, new_product.

    Columns are compared by name, so their order is no change; one that is gone, has another type or key, or may be null
    where it might not, or the reverse, breaks what was agreed, as does a new one that every delivery must have.
    """
    if old["id"] != new["id"]:
        return "new_product"
    a, b = ({p["name"]: p for p in c["schema"][0]["properties"]} for c in (old, new))
    core = lambda p: (p.get("physicalType"), p.get("logicalType"), bool(p.get("primaryKey")), bool(p.get("required")))
    added = [b[n] for n in b if n not in a]
    if any(n not in b or core(a[n]) != core(b[n]) for n in a) or any(p.get("required") for p in added):
        return "major"
    rules = lambda p: sorted(json.dumps(q, sort_keys=True) for q in p.get("quality") or [])
    if added or any(rules(a[n]) != rules(b[n]) for n in a):
        return "minor"
    plain = lambda c, own: {**{k: v for k, v in c.items() if k not in ("version", "schema")}, "columns": own}
    return "none" if plain(old, a) == plain(new, b) else "patch"


def version_allows(old: str, new: str, change: str) -> bool:
    """Whether the step from one version to the next is at least what the change asks for."""
    x, y = ([int(p) for p in v.split(".")] for v in (old, new))
    step = "major" if y[0] > x[0] else "minor" if y[:2] > x[:2] else "patch" if y > x else "none"
    order = ["none", "patch", "minor", "major"]
    return change == "new_product" or (y >= x and order.index(step) >= order.index(change))


@dataclass
class Table:
    name: str
    columns: dict[str, str]
    nullable: dict[str, bool] = field(default_factory=dict)
    primary: list[str] = field(default_factory=list)
    foreign: list[tuple[list[str], str, list[str]]] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)

    @property
    def is_junction(self) -> bool:
        """Whether its key is made of foreign keys to two or more tables: a link, not a hub."""
        ends = {c for f in self.foreign for c in f[0]}
        return len(self.foreign) >= 2 and bool(self.primary) and set(self.primary) <= ends


def declarations(tables: list[Table]) -> dict[str, dict]:
    """What imported tables declare: hubs with their keys, links of junctions, edges of single foreign keys, seeds with a
    type token per column, and checks."""
    hubs, links, edges, seeds, checks = {}, {}, [], {}, []
    for t in tables:
        seeds[t.name] = {"columns": t.columns, "key": t.primary}
        checks += [("not_null", t.name, [c]) for c, loose in t.nullable.items() if not loose]
        checks += [("unique", t.name, u) for u in [t.primary, *t.unique] if u]
        checks += [("relationships", t.name, [*own, to, *there]) for own, to, there in t.foreign]
        if t.is_junction:
            links[t.name] = {"ends": {to: own for own, to, _ in t.foreign}, "key": t.primary}
        else:
            hubs[t.name] = {"key": t.primary or (t.unique[0] if t.unique else list(t.columns)[:1])}
            edges += [(t.name, own, to) for own, to, _ in t.foreign]
    return {"hubs": hubs, "links": links, "edges": edges, "seeds": seeds, "checks": checks}


_TOKENS = [
    (r"(big|small|tiny)?int(eger)?|serial|bigserial", "int"), (r"(decimal|numeric|number)\b.*|money", "numeric"), (r"float.*|double.*|real", "float"),
    (r"bool(ean)?", "boolean"), (r"date", "date"), (r".*", "string"),
]


def import_ddl(text: str) -> list[Table]:
    """Tables of CREATE TABLE statements, with keys, nullability and logical type tokens."""
    out = []
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\(", text, re.I):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        if depth:
            raise ValueError(f"{m[1]}: parenthesis not closed")
        table = Table(_name(m[1]), {})
        for part in _top_level(text[m.end() : i - 1]):
            _definition(table, part.strip())
        out.append(table)
    return out


def _name(text: str) -> str:
    return text.strip().strip('"`').split(".")[-1].strip('"`').lower()


def _names(text: str) -> list[str]:
    return [_name(x) for x in text.split(",")]


def _top_level(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def _definition(t: Table, part: str) -> None:
    body = re.sub(r"^constraint\s+\S+\s+", "", part, flags=re.I)
    if m := re.match(r"primary\s+key\s*\(([^)]*)\)", body, re.I):
        t.primary = _names(m[1])
    elif m := re.match(r"foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w.\"`]+)\s*(?:\(([^)]*)\))?", body, re.I):
        t.foreign.append((_names(m[1]), _name(m[2]), _names(m[3]) if m[3] else []))
    elif m := re.match(r"unique\s*\(([^)]*)\)", body, re.I):
        t.unique.append(_names(m[1]))
    elif re.match(r"check\b", body, re.I):
        return
    elif m := re.match(r"([\w\"`]+)\s+(\w+(?:\s*\([^)]*\))?)(.*)", body, re.S):
        name, kind, rest = _name(m[1]), m[2].lower(), m[3].lower()
        t.columns[name] = next(token for pattern, token in _TOKENS if re.fullmatch(pattern, kind, re.S))
        t.nullable[name] = "not null" not in rest and "primary key" not in rest
        if "primary key" in rest:
            t.primary = [name]
        if "unique" in rest:
            t.unique.append([name])
        if r := re.search(r"references\s+([\w.\"`]+)\s*(?:\(([^)]*)\))?", m[3], re.I):
            t.foreign.append(([name], _name(r[1]), _names(r[2]) if r[2] else []))
    elif body:
        raise ValueError(f"{t.name}: can't read {body.split()[0]!r}")
