"""Golden records: one row per hub key, every attribute with the source it came from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import newest

STRATEGIES = ("first_non_null", "most_recent")


@dataclass
class Rule:
    attribute: str
    strategy: str
    priority: list[str]


def check(rules: list[Rule], satellites: dict[str, DataFrame]) -> None:
    for r in rules:
        if r.strategy not in STRATEGIES:
            raise ValueError(f"{r.attribute}: unknown strategy {r.strategy!r}")
        if len(set(r.priority)) < len(r.priority):
            raise ValueError(f"{r.attribute}: a source has two priorities")
        if missing := [s for s in r.priority if s not in satellites]:
            raise ValueError(f"{r.attribute}: no satellite {missing}")


def golden_record(hub: DataFrame, satellites: dict[str, DataFrame], rules: list[Rule], key: str, effective: str = "effective_from") -> DataFrame:
    """hub keys with attribute, attribute__source and attribute__load_datetime under each rule.

    Each source counts with its latest version by effective date (then hashdiff; load time never orders). A source
    that leaves an attribute null passes to the next one; most_recent takes the latest effective date, then priority.
    """
    check(rules, satellites)
    out = hub.select(key)
    for name, sat in satellites.items():
        used = [r.attribute for r in rules if name in r.priority]
        ties = [c for c in ("hashdiff",) if c in sat.columns]
        latest = newest(sat.select(key, effective, "load_datetime", *ties, *used), [key], [effective, *ties])
        out = out.join(latest.select(key, F.struct(effective, "load_datetime", *used).alias(f"_{name}")), key, "left")
    for r in rules:
        options = [
            F.when(F.col(f"_{s}.{r.attribute}").isNotNull(), F.struct(
                F.col(f"_{s}.{effective}").alias("at"), F.lit(-i).alias("rank"), F.col(f"_{s}.{r.attribute}").alias("value"),
                F.lit(s).alias("source"), F.col(f"_{s}.load_datetime").alias("loaded"),
            ))
            for i, s in enumerate(r.priority)
        ]
        best = F.coalesce(*options) if r.strategy == "first_non_null" or len(options) == 1 else F.greatest(*options)
        out = out.withColumn("_best", best).withColumns({
            r.attribute: F.col("_best.value"), f"{r.attribute}__source": F.col("_best.source"), f"{r.attribute}__load_datetime": F.col("_best.loaded"),
        }).drop("_best")
    return out.drop(*[f"_{s}" for s in satellites])
