"""Checks as frames of offending rows: a check holds if its frame is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    known = df.where(" and ".join(f"{c} is not null" for c in columns))
    return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def accepted_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    out = F.lit(False)
    if low is not None:
        out = out | (F.col(column) < low)
    if high is not None:
        out = out | (F.col(column) > high)
    return df.where(out)


def relationships(df: DataFrame, column: str, to: DataFrame, field: str) -> DataFrame:
    held = to.select(F.col(field).alias("_to")).distinct()
    return df.where(F.col(column).isNotNull()).join(held, F.col(column) == F.col("_to"), "left_anti")


def expression_is_true(df: DataFrame, expression: str) -> DataFrame:
    return df.where(~F.coalesce(F.expr(expression), F.lit(False)))


def conservation(lines: DataFrame, headers: DataFrame, key: str, part: str, whole: str, tolerance: float) -> DataFrame:
    """Headers whose lines don't add up to them."""
    sums = lines.groupBy(key).agg(F.sum(part).alias("line_total"))
    met = headers.select(key, whole).join(sums, key, "left")
    gap = F.abs(F.coalesce("line_total", F.lit(0)) - F.col(whole))
    return met.where(gap > tolerance)


def overlaps(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of versions of one key whose intervals overlap."""
    a = versions.select(*keys, F.col("effective_from").alias("from_a"), F.col("effective_to").alias("to_a"))
    b = versions.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("effective_from").alias("from_b"), F.col("effective_to").alias("to_b"))
    on = [a[k] == b[f"_{k}"] for k in keys]
    return a.join(b, [*on, a["from_a"] < b["from_b"], b["from_b"] < a["to_a"]])


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check: its name and the number of offending rows."""
    out = None
    for name, faults in checks.items():
        part = faults.agg(F.count(F.lit(1)).alias("n_faults")).select(F.lit(name).alias("check_name"), "n_faults")
        out = part if out is None else out.unionByName(part)
    return out


def row_checks(df: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """One row per check, as summary gives: conditions on single rows, all counted in one scan. A null is no fault."""
    counts = df.agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in faults.items()])
    told = [F.struct(F.lit(n).alias("check_name"), F.coalesce(F.col(n), F.lit(0)).alias("n_faults")) for n in faults]
    return counts.select(F.explode(F.array(*told)).alias("_check")).select("_check.check_name", "_check.n_faults")


def vacuous(df: DataFrame, least: int = 1) -> DataFrame:
    """One row if df has fewer rows than its checks need to mean anything."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < least)
