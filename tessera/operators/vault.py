"""Append-only history: stages with hash columns, hubs, links and satellites. Loading twice adds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import vault_hash
from tessera.operators.relational import anti


def bridge(staged: DataFrame, resolutions: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Staged rows with the golden key of each resolution (name: frame with golden_key, join keys); unresolved rows go."""
    out = staged
    for name, (resolved, keys) in resolutions.items():
        key = resolved.select(*keys, F.col("golden_key").alias(f"{name}_golden_key")).where(f"{name}_golden_key is not null")
        out = out.join(key, keys)
    return out


def payload(columns: list[str], excluded: list[str]) -> list[str]:
    """Columns that the hashdiff covers: the payload without the declared exclusions."""
    unknown = set(excluded).difference(columns)
    if unknown:
        raise ValueError(f"exclusions outside the payload: {sorted(unknown)}")
    return [c for c in columns if c not in excluded]


def stage(df: DataFrame, keys: dict[str, list[str]], hashdiff: list[str] | None, source: str, loaded: Column) -> DataFrame:
    """df with its hash keys, hashdiff, record source and load time."""
    out = df
    for name, columns in keys.items():
        out = out.withColumn(name, vault_hash(*[F.col(c) for c in columns]))
    if hashdiff is not None:
        out = out.withColumn("hashdiff", vault_hash(*[F.col(c) for c in sorted(hashdiff)]))
    return out.withColumn("record_source", F.lit(source)).withColumn("load_datetime", loaded)


def _first_rows(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    out = sources[0].select(key, *columns, "load_datetime", "record_source")
    for s in sources[1:]:
        out = out.unionByName(s.select(key, *columns, "load_datetime", "record_source"))
    first = F.min_by(F.struct(*columns, "load_datetime", "record_source"), F.struct("load_datetime", "record_source")).alias("r")
    rows = out.where(F.col(key).isNotNull()).groupBy(key).agg(first)
    return rows.select(key, *[F.col(f"r.{c}").alias(c) for c in (*columns, "load_datetime", "record_source")])


def load_hub(sources: list[DataFrame], key: str, business: list[str], target: DataFrame | None = None) -> DataFrame:
    """New business keys over all sources, each with its first load; keys that target holds are left out."""
    rows = _first_rows(sources, key, business)
    return rows if target is None else anti(rows, target, [key])


def load_link(sources: list[DataFrame], key: str, ends: list[str], target: DataFrame | None = None) -> DataFrame:
    """New tuples of hub keys; tuples with an unknown end are left out."""
    whole = [s.where(" and ".join(f"{e} is not null" for e in ends)) for s in sources]
    return load_hub(whole, key, ends, target)


def load_satellite(
    staged: DataFrame, key: str, columns: list[str], effective: str, target: DataFrame | None = None
) -> DataFrame:
    """Versions to append: those whose hashdiff differs from the version just before them, by effective date.

    Held and staged versions are laid in one order per key, so late and backdated ones are compared with their own
    predecessor, not with the newest; staged ones that the target holds already (key, hashdiff, effective date) are no
    news, whatever stands between. Loading a stage again adds nothing.
    """
    rows = staged.select(key, "hashdiff", *columns, effective, "load_datetime", "record_source").withColumn("_held", F.lit(False))
    if target is not None:
        rows = target.select(*rows.columns[:-1]).withColumn("_held", F.lit(True)).unionByName(rows)
    same = Window.partitionBy(key, effective, "hashdiff")
    order = Window.partitionBy(key).orderBy(effective, F.desc("_held"), "load_datetime", "hashdiff")
    known = F.max("_held").over(same)
    before = F.lag("hashdiff").over(order)
    # a staged copy of a held version must not stand between others, so copies go before neighbours are compared
    rows = rows.withColumn("_known", known).where("_held or not _known")
    fresh = rows.withColumn("_before", before).where("not _held and (_before is null or _before <> hashdiff)")
    return fresh.drop("_before", "_held", "_known")


def crosswalk_history(seed: DataFrame, labels: DataFrame, resolved: DataFrame, external: str, known: DataFrame, value: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Seeded history by external label -> (system, record) -> golden key; values outside ``known`` become unknown."""
    to_key = labels.join(resolved.select("source_system", "source_record_id", "golden_key"), ["source_system", "source_record_id"]).where("golden_key is not null").groupBy(external).agg(F.min("golden_key").alias("golden_key"))
    values = known.select(F.col(value).alias("_v")).distinct()
    out = seed.join(to_key, external).join(values, seed[value] == values["_v"], "left")
    return out.withColumn(value, F.coalesce("_v", F.lit(unknown))).drop("_v")
