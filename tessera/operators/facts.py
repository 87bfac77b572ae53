"""Facts over conformed records: valuations, vehicle flows, successions, order lines, performance and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import joined_distinct, safe_divide, surrogate_key
from tessera.operators.finance import CalculatedField
from tessera.operators.relational import governance_gate, insert_only, newest, top1

# How sources name flows, and what decisions make of a deal.
CALLS = ["capital_call", "call", "contribution"]
DISTRIBUTIONS = ["distribution", "return_of_capital", "income", "gain"]
APPROVED, DECLINED = ["approve", "approve_with_conditions"], ["decline"]

DPI_GAP = CalculatedField(
    "fund_dpi_gap_to_one", ["fund_id"],
    {"dpi_gap_to_one": ("target_dpi - dpi", "numeric"), "dpi_target_reached": ("dpi >= target_dpi", "boolean")},
    inputs=["dpi", "target_dpi"], pass_through=["dpi", "target_dpi"],
)


def valuations(rows: DataFrame) -> DataFrame:
    """One valuation for each fund, company, date, method and level: the latest load, then the least source id."""
    same = ["fund_id", "company_id", "valuation_date", "method", "valuation_level"]
    one = top1(rows, same, [F.col("load_datetime").desc(), F.col("source_valuation_id")])
    return one.withColumn("valuation_id", surrogate_key(*[F.col(c) for c in same]))


def vehicle_flows(rows: DataFrame) -> DataFrame:
    """Vehicle flows with a normalised type and sign, the latest load of each source flow.

    A call, or an outflow of any name, is a contribution; a distribution, or an inflow, a distribution; amounts are
    negative for outflows.
    """
    kind, way = F.lower("cash_flow_type"), F.lower("direction")
    flow_type = F.when(kind.isin(CALLS) | (way == "outflow"), "contribution").when(kind.isin(DISTRIBUTIONS) | (way == "inflow"), "distribution").otherwise(kind)
    signed = F.when(way == "outflow", -F.abs("amount")).otherwise(F.abs("amount"))
    out = rows.withColumn("flow_type", flow_type).withColumn("direction", way).withColumn("signed_amount", signed)
    return newest(out, ["vehicle_id", "cash_flow_id"], ["load_datetime"]).withColumn("vehicle_cash_flow_id", surrogate_key(F.col("vehicle_id"), F.col("cash_flow_id")))


def vehicle_bridge(flows: DataFrame, owners: DataFrame, fund_flows: DataFrame) -> DataFrame:
    """Per fund: what its vehicles' signed flows add up to, its own total, and the gap. owners: vehicle_id, fund_id;
    flows: vehicle_id, signed_amount; fund_flows: fund_id, signed_amount. Sums come before both joins' results meet."""
    below = flows.groupBy("vehicle_id").agg(F.sum("signed_amount").alias("part")).join(owners, "vehicle_id").groupBy("fund_id").agg(F.sum("part").alias("vehicle_total"))
    own = fund_flows.groupBy("fund_id").agg(F.sum("signed_amount").alias("fund_total"))
    return below.join(own, "fund_id", "left").withColumn("delta", F.col("vehicle_total") - F.col("fund_total"))


def conservation_faults(bridge: DataFrame, tolerance: float = 50_000) -> DataFrame:
    """Funds whose vehicles invent or lose cash beyond the tolerance, or that have no total of their own."""
    return bridge.where(F.col("delta").isNull() | (F.abs("delta") > tolerance))


def decision_insert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Logged decisions that target lacks, in its types: blank cells become nulls of the column's type; a logged decision
    is never changed."""
    typed = rows.select(*[F.nullif(F.trim(F.col(f.name).cast("string")), F.lit("")).cast(f.dataType).alias(f.name) for f in target.schema.fields])
    return insert_only(target, typed, keys)


def succession_events(rows: DataFrame) -> DataFrame:
    """One event for each predecessor, successor and source event, the latest load."""
    out = newest(rows.withColumn("event_type", F.lower("event_type")), ["predecessor", "successor", "event_id"], ["load_datetime"])
    return out.withColumn("succession_id", surrogate_key(F.col("predecessor"), F.col("successor"), F.col("event_id")))


def lineage_status(managers: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """managers with successor, predecessor and lineage_status: superseded if one follows, current if one came before,
    else active. Both roles are aggregated first, so each join is by key."""
    after = events.groupBy(F.col("predecessor").alias("_p")).agg(F.max("successor").alias("successor"))
    before = events.groupBy(F.col("successor").alias("_s")).agg(F.max("predecessor").alias("predecessor"))
    out = managers.join(after, F.col(key) == F.col("_p"), "left").join(before, F.col(key) == F.col("_s"), "left").drop("_p", "_s")
    status = F.when(F.col("successor").isNotNull(), "superseded").when(F.col("predecessor").isNotNull(), "current").otherwise("active")
    return out.withColumn("lineage_status", status)


def valuation_fact(rows: DataFrame) -> DataFrame:
    """Net asset value of each fund and date over its valuations."""
    return rows.groupBy("fund_id", "valuation_date").agg(
        F.sum("value").alias("nav"), F.countDistinct("company_id").alias("valued_companies"), joined_distinct("method").alias("methods"),
        F.min("company_id").alias("representative_company"), F.avg("confidence_score").alias("average_confidence"), F.max("load_datetime").alias("load_datetime"),
    )


def latest_nav(fact: DataFrame) -> DataFrame:
    return newest(fact.select("fund_id", "valuation_date", "nav"), ["fund_id"], ["valuation_date"])


def irr_flows(flows: DataFrame, fact: DataFrame, funds: DataFrame) -> DataFrame:
    """(fund_id, flow_date, amount) for the rate search: calls out, distributions in, and the latest net asset value as a
    last inflow, of funds whose identity is confirmed."""
    confirmed = governance_gate(funds).select("fund_id").distinct()
    amount = F.when(F.col("called") > 0, -F.col("called")).otherwise(F.col("distributed"))
    legs = flows.where("called > 0 or distributed > 0").select("fund_id", "flow_date", amount.alias("amount"))
    nav = latest_nav(fact).where("nav is not null").select("fund_id", F.col("valuation_date").alias("flow_date"), F.col("nav").alias("amount"))
    return legs.unionByName(nav).join(confirmed, "fund_id")


def performance_base(funds: DataFrame, flows: DataFrame, fact: DataFrame, irr: DataFrame, basis: DataFrame) -> DataFrame:
    """One row for each confirmed fund with flows: paid_in, distributed, nav, called_pct, unfunded, invested_capital
    (paid in less recallable distributions and fee offsets), xirr. funds: fund_id, committed, confidence; basis: fund_id,
    recallable, fee_offset; irr: fund_id, xirr."""
    sums = flows.groupBy("fund_id").agg(F.sum("called").alias("paid_in"), F.sum("distributed").alias("distributed"))
    out = governance_gate(funds).join(sums, "fund_id").join(latest_nav(fact).withColumnRenamed("valuation_date", "as_of"), "fund_id", "left")
    out = out.join(irr, "fund_id", "left").join(basis, "fund_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "fund_id", "as_of", "committed", "paid_in", "distributed", zero("nav").alias("nav"), safe_divide(F.col("paid_in"), F.col("committed")).alias("called_pct"),
        (F.col("committed") - F.col("paid_in")).alias("unfunded"), (F.col("paid_in") - zero("recallable") - zero("fee_offset")).alias("invested_capital"), "xirr",
    )


def invested_multiple(base: DataFrame) -> DataFrame:
    """moic: distributions and net asset value over invested capital, which is a basis of its own beside paid-in."""
    return base.withColumn("moic", safe_divide(F.col("distributed") + F.col("nav"), F.col("invested_capital")))


def order_lines(branches: dict[str, DataFrame], link: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per source line: lines without a resolved product go, lines without a customer stay.

    branches: lines of each source with source_record_id and line_key; link: line_key, order_id, product_id; customers:
    order_id, customer_id.
    """
    out = None
    for source, lines in branches.items():
        part = lines.withColumn("source_system", F.lit(source))
        out = part if out is None else out.unionByName(part)
    met = out.join(link, "line_key").join(customers, "order_id", "left")
    return met.withColumn("order_line_key", surrogate_key(F.col("source_system"), F.col("source_record_id")))


def classified(fact: DataFrame, versions: DataFrame, kinds: dict[str, str], key: str, at: str, unknown: str = "UNKNOWN") -> DataFrame:
    """fact with the value in force of every kind of classification, unknown where none is: one point-in-time join for
    each. versions: key, kind, value, effective_from, effective_to; kinds: output column by kind."""
    out = fact
    for kind, name in kinds.items():
        held = versions.where(F.col("kind") == kind).select(F.col(key).alias("_k"), F.col("value").alias("_v"), F.col("effective_from").alias("_a"), F.col("effective_to").alias("_b"))
        day = F.col(at).cast("date")
        out = out.join(held, (F.col(key) == F.col("_k")) & (day >= F.col("_a")) & (day < F.col("_b")), "left")
        out = out.withColumn(name, F.coalesce("_v", F.lit(unknown))).drop("_k", "_v", "_a", "_b")
    return out


def next_stage(decision: Column) -> Column:
    """Stage that a decision leads to; none for a deferral."""
    return F.when(decision.isin(APPROVED), "COMMITTED").when(decision.isin(DECLINED), "DECLINED")


def stages_from_decisions(history: DataFrame, decisions: DataFrame, at_stage: str = "DECISION") -> DataFrame:
    """Stages that the latest terminal decisions add, for deals whose last recorded stage awaits one.

    history: deal, stage, effective_from, recorded_at, as recorded and without derived rows; decisions: deal, decision,
    decided_at. A later deferral withdraws an earlier approval, as only the latest decision counts.
    """
    last = newest(history.select("deal", "stage", "effective_from", "recorded_at"), ["deal"], ["effective_from", "recorded_at", "stage"])
    latest = newest(decisions.select("deal", "decision", "decided_at"), ["deal"], ["decided_at", "decision"])
    open_ = last.where(F.col("stage") == at_stage).select("deal")
    met = latest.join(open_, "deal").withColumn("stage", next_stage(F.col("decision"))).where("stage is not null")
    return met.select("deal", "stage", F.col("decided_at").cast("date").alias("effective_from"), F.col("decided_at").alias("recorded_at"))


def approval_queue(history: DataFrame, decisions: DataFrame, as_of: Column, at_stage: str = "DECISION") -> DataFrame:
    """Deals that await a decision, derived stages included, with the latest (non-terminal) decision and days waited."""
    shown = ["deal", "stage", "effective_from", "recorded_at"]
    whole = history.select(*shown).unionByName(stages_from_decisions(history, decisions, at_stage))
    now = newest(whole, ["deal"], ["effective_from", "recorded_at", "stage"]).where(F.col("stage") == at_stage)
    latest = newest(decisions.select("deal", "decision", "decided_at"), ["deal"], ["decided_at", "decision"])
    return now.join(latest, "deal", "left").withColumn("days_waiting", F.datediff(as_of, F.col("effective_from")))
