"""Delivered batches: findings per row, dispositions, the decision to publish, and what changed since.

Findings name rules, fields and codes, never values of the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import hmac_sha256
from tessera.operators.relational import anti, newest


@dataclass
class FieldRule:
    """kind: not_null, accepted_values or range."""

    name: str
    kind: str
    column: str
    severity: str = "error"
    values: list = field(default_factory=list)
    low: float | None = None
    high: float | None = None
    allow_null: bool = False

    def fault(self, nullable: bool) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "accepted_values":
            return c.isNotNull() & ~c.isin(self.values)
        if self.kind == "range":
            out = F.lit(False)
            if self.low is not None:
                out = out | (c < self.low)
            if self.high is not None:
                out = out | (c > self.high)
            null_fault = F.lit(False) if nullable and self.allow_null else c.isNull()
            return F.coalesce(out, F.lit(False)) | null_fault
        raise ValueError(f"{self.name}: unknown rule kind {self.kind!r}")


_CODES = {"not_null": "NULL_NOT_ALLOWED", "accepted_values": "VALUE_NOT_ACCEPTED", "range": "OUT_OF_RANGE"}
FINDING = "struct<kind:string,rule:string,field:string,code:string,severity:string>"


def _finding(kind: str, rule: str, column: str, code: str, severity: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.lit(column).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def field_findings(rows: DataFrame, rules: list[FieldRule], nullable: set[str] | None = None) -> DataFrame:
    """rows with ``findings``: distinct, in order of kind, rule, field and code; one projection for all rules."""
    made = [F.when(r.fault(r.column in (nullable or set())), _finding("field", r.name, r.column, _CODES[r.kind], r.severity)) for r in rules]
    prior = F.coalesce(F.col("findings"), F.array().cast(f"array<{FINDING}>")) if "findings" in rows.columns else F.array().cast(f"array<{FINDING}>")
    new = F.array_compact(F.array(*made)).cast(f"array<{FINDING}>") if made else F.array().cast(f"array<{FINDING}>")
    return rows.withColumn("findings", F.array_sort(F.array_distinct(F.concat(prior, new))))


def unique_findings(rows: DataFrame, name: str, keys: list[str], severity: str = "error") -> DataFrame:
    """Every member of a group of equal keys gets a finding and the group's size; a null part of a key is a finding of
    its own. Group sizes are aggregated before they meet the rows."""
    known = " and ".join(f"{k} is not null" for k in keys)
    sizes = rows.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    out = rows.join(sizes, keys, "left")
    label = ",".join(keys)
    found = F.when(~F.expr(known), _finding("unique_key", name, label, "NULL_NOT_ALLOWED", severity)).when(
        F.col("group_size") > 1, _finding("unique_key", name, label, "DUPLICATE_KEY", severity)
    )
    prior = F.col("findings") if "findings" in rows.columns else F.array().cast(f"array<{FINDING}>")
    more = F.array_compact(F.array(found)).cast(f"array<{FINDING}>")
    return out.withColumn("findings", F.array_sort(F.array_distinct(F.concat(prior, more)))).withColumn("group_size", F.coalesce("group_size", F.lit(0)))


def dispose(rows: DataFrame) -> DataFrame:
    """accepted unless a finding is an error; warnings don't reject."""
    bad = F.exists("findings", lambda x: x["severity"] == "error")
    return rows.withColumn("disposition", F.when(bad, "rejected").otherwise("accepted"))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows."""
    return rows.where("disposition = 'accepted'"), rows.where("disposition = 'rejected'")


@dataclass
class Policy:
    """How a delivery may be published."""

    mode: str = "append_only"  # cdc, append_only, complete_snapshot
    progress: str = "opaque_batch"
    on_error: str = "publish_valid_rows"  # or reject_batch
    max_error_share: float = 0.0
    min_rows: int | None = None
    max_rows: int | None = None

    def check(self) -> None:
        if self.mode not in ("cdc", "append_only", "complete_snapshot"):
            raise ValueError(f"unknown delivery mode {self.mode!r}")
        if self.on_error not in ("publish_valid_rows", "reject_batch"):
            raise ValueError(f"unknown error policy {self.on_error!r}")
        if self.on_error == "publish_valid_rows" and (self.mode, self.progress) != ("append_only", "opaque_batch"):
            raise ValueError("partial publication needs append_only batches of opaque progress")


def decide(rows: DataFrame, policy: Policy, keys: list[str] | None = None) -> DataFrame:
    """One row per batch (of the keys): framed, passed and failed rows and the decision.

    Row counts outside their bounds reject; no rows or no errors publish all; a part is published only where the policy
    allows it, something passed, and the share of errors is within bounds.
    """
    failed = F.sum((F.col("disposition") == "rejected").cast("int"))
    out = rows.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("framed"), F.coalesce(failed, F.lit(0)).alias("failed"))
    out = out.withColumn("passed", F.col("framed") - F.col("failed"))
    outside = F.lit(False)
    if policy.min_rows is not None:
        outside = outside | (F.col("framed") < policy.min_rows)
    if policy.max_rows is not None:
        outside = outside | (F.col("framed") > policy.max_rows)
    partial = F.lit(policy.on_error == "publish_valid_rows" and policy.mode == "append_only" and policy.progress == "opaque_batch")
    within = (F.col("passed") >= 1) & (F.col("failed") / F.col("framed") <= policy.max_error_share)
    decision = F.when(outside, "reject").when((F.col("framed") == 0) | (F.col("failed") == 0), "publish_all").when(partial & within, "publish_partial").otherwise("reject")
    return out.withColumn("decision", decision)


def record_tag(secret: bytes, *columns: Column) -> Column:
    """Keyed tag of a record key: parts are framed by their lengths, so no two keys share a message."""
    parts = [F.concat(F.length(F.coalesce(c.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in columns]
    return hmac_sha256(secret, F.concat(*parts))


def snapshot_diff(prior: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``change``: inserted or deleted between two complete snapshots."""
    added = anti(candidate.select(*keys).distinct(), prior, keys).withColumn("change", F.lit("inserted"))
    gone = anti(prior.select(*keys).distinct(), candidate, keys).withColumn("change", F.lit("deleted"))
    return added.unionByName(gone)


def latest_state(changes: DataFrame, keys: list[str], sequence: str, deleted: str) -> DataFrame:
    """Last change of every key; tombstoned keys go."""
    return newest(changes, keys, [sequence]).where(~F.coalesce(F.col(deleted), F.lit(False)))


def sequence_faults(changes: DataFrame, sequence: str, stream: list[str]) -> DataFrame:
    """Sequence numbers of a stream that are null or occur more than once."""
    return changes.groupBy(*stream, sequence).agg(F.count(F.lit(1)).alias("n")).where(F.col(sequence).isNull() | (F.col("n") > 1))


def timeliness(deliveries: DataFrame, due: str, arrived: str, now: Column, warn_seconds: int, error_seconds: int) -> DataFrame:
    """on_time, late (from the warning on), missing (from the error on, or not there by then), awaiting."""
    due_at, at = F.unix_timestamp(due), F.unix_timestamp(F.coalesce(F.col(arrived), now))
    delay = at - due_at
    state = (
        F.when(F.col(arrived).isNotNull() & (delay < warn_seconds), "on_time")
        .when(delay >= error_seconds, "missing")
        .when(delay >= warn_seconds, "late")
        .otherwise("awaiting")
    )
    return deliveries.withColumn("delay_seconds", delay).withColumn("state", state)


def boundaries(spark: SparkSession, first: str, last: str, seconds: int) -> DataFrame:
    """Scheduled instants from first to last inclusive, one every so many seconds."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr(f"interval {seconds} seconds"))).alias("boundary"))


def projection_faults(expected: DataFrame, applied: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """State of every expected stream against what the target shows.

    expected: stream, digest. applied: stream, digest, committed_at, heartbeat_at. In order: missing, duplicate,
    wrong_digest, null_committed, stale_heartbeat, healthy.
    """
    found = applied.groupBy("stream").agg(
        F.count(F.lit(1)).alias("n"), F.min("digest").alias("shown"), F.min("committed_at").alias("committed_at"), F.max("heartbeat_at").alias("heartbeat_at")
    )
    met = expected.join(found, "stream", "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at")
    state = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "missing")
        .when(F.col("n") > 1, "duplicate")
        .when(~F.col("shown").eqNullSafe(F.col("digest")), "wrong_digest")
        .when(F.col("committed_at").isNull(), "null_committed")
        .when(F.coalesce(age, F.lit(stale_seconds + 1)) > stale_seconds, "stale_heartbeat")
        .otherwise("healthy")
    )
    return met.select("stream", state.alias("state"))


def visible(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the ledger of published batches shows."""
    return rows.join(ledger.select(*keys).distinct(), keys, "left_semi")


def claim(attempts: DataFrame, delivery: DataFrame) -> DataFrame:
    """delivery (delivery_id, digest) with ``outcome``: replay of the same claim, conflict with another one, or new."""
    held = attempts.groupBy("delivery_id").agg(F.collect_set("digest").alias("held"))
    met = delivery.join(held, "delivery_id", "left")
    outcome = F.when(F.col("held").isNull(), "new").when(F.array_contains("held", F.col("digest")), "replay").otherwise("conflict")
    return met.withColumn("outcome", outcome).drop("held")


def release(quarantined: DataFrame, rules: list[FieldRule], released: DataFrame, locator: str = "locator") -> DataFrame:
    """Quarantined rows that pass a full new evaluation and weren't released before, each locator once."""
    clean = dispose(field_findings(quarantined.drop("findings", "disposition"), rules)).where("disposition = 'accepted'")
    return anti(clean, released, [locator]).dropDuplicates([locator])
