"""History: slowly changing dimensions, point-in-time joins, spines and overlays. The current date is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import date_key, date_trunc

END_OF_TIME = "9999-12-31"


def scd2(history: DataFrame, keys: list[str], start: str, ties: list[str] | None = None) -> DataFrame:
    """Half-open intervals [effective_from, effective_to) of each key's versions; the last one is open.

    Versions of one day give empty intervals in the order of ``ties``; the last of them carries on.
    """
    order = Window.partitionBy(*keys).orderBy(start, *(ties or []))
    following = F.lead(start).over(order)
    return (
        history.withColumn("effective_to", F.coalesce(following.cast("date"), F.lit(END_OF_TIME).cast("date")))
        .withColumn("effective_from", F.col(start).cast("date"))
        .withColumn("is_current", following.isNull())
    )


def with_unknown(dimension: DataFrame, member: dict[str, Column]) -> DataFrame:
    """dimension with its reserved member for facts that match none."""
    row = dimension.sparkSession.range(1).select(*[member.get(c, F.lit(None)).cast(dimension.schema[c].dataType).alias(c) for c in dimension.columns])
    return dimension.unionByName(row)


def days_in_state(as_of: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    return F.datediff(F.least(F.col(end), as_of), F.col(start))


def point_in_time(facts: DataFrame, versions: DataFrame, keys: dict[str, str], at: str, how: str = "left", columns: list[str] | None = None) -> DataFrame:
    """Facts with the version in force at their date: an equi join with a half-open range beside it."""
    held = versions.select(*[F.col(v).alias(f"_k_{v}") for v in keys.values()], F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), *(columns or []))
    on = [facts[f] == held[f"_k_{v}"] for f, v in keys.items()]
    day = facts[at].cast("date")
    joined = facts.join(held, [*on, day >= held["_from"], day < held["_to"]], how)
    return joined.drop(*[f"_k_{v}" for v in keys.values()], "_from", "_to")


def in_force(versions: DataFrame, as_of: Column) -> DataFrame:
    return versions.where((F.col("effective_from") <= as_of) & (as_of < F.col("effective_to")))


def date_spine(df: DataFrame, column: str) -> DataFrame:
    """One row per day from the first to the last date, with the usual parts."""
    days = df.agg(F.min(F.col(column).cast("date")).alias("a"), F.max(F.col(column).cast("date")).alias("b")).where("a is not null")
    out = days.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return out.select(
        date_key(F.col("day")).alias("date_key"),
        "day",
        F.year("day").alias("year"),
        F.quarter("day").alias("quarter"),
        F.month("day").alias("month"),
        date_trunc("month", F.col("day")).alias("month_start"),
        date_trunc("quarter", F.col("day")).alias("quarter_start"),
    )


def load_pointers(hub: DataFrame, satellites: dict[str, DataFrame], key: str, as_of: str, load: str) -> DataFrame:
    """For every hub row, each satellite's latest load not after the row's as-of; aggregated first, then joined."""
    out = hub
    for name, sat in satellites.items():
        s = sat.select(F.col(key).alias("_k"), F.col(load).alias("_l"))
        latest = hub.select(key, as_of).join(s, (F.col(key) == F.col("_k")) & (F.col("_l") <= F.col(as_of))).groupBy(key, as_of).agg(F.max("_l").alias(f"{name}_load"))
        out = out.join(latest, [key, as_of], "left")
    return out


def succession_overlay(base: DataFrame, events: DataFrame, key: str, owner: str, first_day: str = "1900-01-01") -> DataFrame:
    """Owners over time: the base owner from the first day, each successor from its event. events: predecessor,
    successor, effective_date."""
    start = base.select(key, F.col(owner).alias("owner"), F.lit(first_day).cast("date").alias("start"), F.lit(0).alias("priority"))
    moved = base.join(events, base[owner] == events["predecessor"]).select(
        key, F.col("successor").alias("owner"), F.col("effective_date").cast("date").alias("start"), F.lit(1).alias("priority")
    )
    return scd2(start.unionByName(moved), [key], "start", ["priority", "owner"]).drop("start", "priority")
