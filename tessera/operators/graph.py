"""Property graphs over hubs and links: node and edge frames, degrees, and paths of fixed steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class NodeSpec:
    label: str
    table: DataFrame
    key: str


@dataclass
class EdgeSpec:
    """verb from source to target, with the verb of the way back and what a source may have at most: one or many."""

    verb: str
    inverse: str
    source: str
    target: str
    table: DataFrame
    source_key: str
    target_key: str
    cardinality: str = "many"


def nodes(specs: list[NodeSpec]) -> DataFrame:
    out = None
    for s in specs:
        part = s.table.select(F.lit(s.label).alias("label"), F.col(s.key).cast("string").alias("node_id")).where("node_id is not null").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def edges(specs: list[EdgeSpec], labels: set[str] | None = None) -> DataFrame:
    out = None
    for s in specs:
        if not s.inverse or s.cardinality not in ("one", "many"):
            raise ValueError(f"{s.verb}: an edge needs an inverse and a cardinality")
        if labels is not None and not {s.source, s.target} <= labels:
            raise ValueError(f"{s.verb}: unknown node label")
        part = s.table.select(
            F.lit(s.verb).alias("verb"), F.lit(s.source).alias("source_label"), F.col(s.source_key).cast("string").alias("source_id"),
            F.lit(s.target).alias("target_label"), F.col(s.target_key).cast("string").alias("target_id"),
        ).where("source_id is not null and target_id is not null").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def degrees(edge: DataFrame) -> DataFrame:
    """Per label and verb: sources, edges and the largest number from one source."""
    one = edge.groupBy("verb", "source_label", "source_id").agg(F.count(F.lit(1)).alias("d"))
    return one.groupBy("verb", "source_label").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("d").alias("n_edges"), F.max("d").alias("max_degree"))


def dangling(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    n = node.select(F.col("label").alias("_l"), F.col("node_id").alias("_n"))
    out = edge.join(n, (F.col("source_label") == F.col("_l")) & (F.col("source_id") == F.col("_n")), "left_anti")
    return out.unionByName(edge.join(n, (F.col("target_label") == F.col("_l")) & (F.col("target_id") == F.col("_n")), "left_anti")).distinct()


def path(edge: DataFrame, verbs: list[str]) -> DataFrame:
    """Distinct (start_id, end_id) over edges of the verbs in turn."""
    out = edge.where(F.col("verb") == verbs[0]).select(F.col("source_id").alias("start_id"), F.col("target_id").alias("end_id"))
    for v in verbs[1:]:
        step = edge.where(F.col("verb") == v).select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"))
        out = out.join(step, F.col("end_id") == F.col("_s")).select("start_id", F.col("_t").alias("end_id"))
    return out.distinct()


def cardinality_faults(edge: DataFrame, specs: list[EdgeSpec]) -> DataFrame:
    one = [s.verb for s in specs if s.cardinality == "one"]
    return edge.where(F.col("verb").isin(one)).groupBy("verb", "source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
