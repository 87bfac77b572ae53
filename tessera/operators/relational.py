"""Small relational operators that the others build on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under sort expressions, which may mix directions: a window, so all rows of a key meet in
    one task. Where the order is ascending in all its columns, ``newest`` combines before the shuffle instead.
    """
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest values of ``order``: combines before the shuffle, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def tagged_union(branches: dict[str, DataFrame], tag: str = "source_system") -> DataFrame:
    """UNION ALL of branches, each with its constant tag."""
    out = None
    for name, df in branches.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no branches")
    return out


def distinct_over(column: str, keys: list[str]) -> Column:
    """count(distinct column) over (partition by keys)."""
    return F.size(F.collect_set(column).over(Window.partitionBy(*keys)))


def insert_only(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key target doesn't hold, one for each key: what an insert-only merge appends. Null keys match null."""
    return anti(rows.dropDuplicates(keys), target, keys)


def anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    held = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct()
    on = [left[k].eqNullSafe(held[f"_r_{k}"]) for k in keys]
    return left.join(held, on, "left_anti")


def pair_key(a: str, b: str) -> list[Column]:
    """An unordered pair as two columns, so that a join needs no OR."""
    return [F.least(a, b).alias("pair_low"), F.greatest(a, b).alias("pair_high")]


def set_difference(prior: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    return anti(prior.select(*keys).distinct(), candidate, keys)


def bounds(df: DataFrame, column: str) -> DataFrame:
    """One row: the least and greatest value, for joins that a scalar subquery would express."""
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def governance_gate(df: DataFrame, confidence: str = "confidence", least: float = 0.85) -> DataFrame:
    return df.where(F.col(confidence).isNotNull() & (F.col(confidence) >= least))
