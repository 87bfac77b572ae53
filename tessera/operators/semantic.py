"""A small metric layer: models with entities, dimensions and measures; metrics by name, dimensions and grain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGGREGATES = {
    "sum": F.sum,
    "average": F.avg,
    "count_distinct": F.countDistinct,
    "sum_boolean": lambda c: F.sum(c.cast("int")),
    "count": F.count,
    "min": F.min,
    "max": F.max,
}


@dataclass
class Measure:
    name: str
    aggregate: str
    expression: str
    where: str | None = None

    def column(self) -> Column:
        if self.aggregate not in _AGGREGATES:
            raise ValueError(f"{self.name}: unknown aggregate {self.aggregate!r}")
        value = F.expr(self.expression)
        if self.where:
            value = F.when(F.expr(self.where), value)
        return _AGGREGATES[self.aggregate](value).alias(self.name)


@dataclass
class SemanticModel:
    name: str
    entity: str
    time: str
    dimensions: dict[str, str]
    measures: list[Measure] = field(default_factory=list)

    def query(self, df: DataFrame, measures: list[str], by: list[str] | None = None, grain: str | None = None, where: str | None = None) -> DataFrame:
        """The measures over the dimensions, and over time at the grain (day, month, quarter, year) if one is given."""
        known = {m.name: m for m in self.measures}
        if missing := [m for m in measures if m not in known]:
            raise ValueError(f"{self.name}: no measures {missing}")
        if missing := [d for d in by or [] if d not in self.dimensions]:
            raise ValueError(f"{self.name}: no dimensions {missing}")
        groups = [F.expr(self.dimensions[d]).alias(d) for d in by or []]
        if grain:
            groups.append(F.date_trunc(grain, F.col(self.time)).cast("date").alias(f"{grain}_start"))
        rows = df.where(where) if where else df
        return rows.groupBy(*groups).agg(*[known[m].column() for m in measures])
