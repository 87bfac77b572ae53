"""Investment measures over dated signed flows, and declared calculated fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import safe_divide, type_of
from tessera.operators.relational import top1

#: The bracket, halvings and guard of the rate search.
RATE_LOW, RATE_HIGH, HALVINGS, GUARD = -0.9999, 100.0, 20, 0.005


def conform_flows(flows: DataFrame, types: dict[str, str], outgoing: list[str], keys: list[str], priority: dict[str, int]) -> DataFrame:
    """Flows with normalised type and sign, one of equal ones kept by source priority.

    flows: source_system, flow_id, keys.., flow_date, raw_type, amount, currency. Equality is by normalised type and
    signed amount.
    """
    kind = F.lit("other")
    for raw, name in reversed(types.items()):
        kind = F.when(F.lower("raw_type") == raw, F.lit(name)).otherwise(kind)
    signed = F.when(F.col("flow_type").isin(outgoing), -F.abs("amount")).otherwise(F.abs("amount"))
    rank = F.coalesce(*[F.when(F.col("source_system") == s, F.lit(p)) for s, p in priority.items()], F.lit(len(priority) + 1))
    out = flows.withColumn("flow_type", kind).withColumn("signed_amount", signed).withColumn("_rank", rank)
    same = [*keys, "flow_date", "flow_type", "signed_amount", "currency"]
    return top1(out, same, [F.col("_rank"), F.col("source_system"), F.col("flow_id")]).drop("_rank")


def xirr(flows: DataFrame, key: str, date: str = "flow_date", amount: str = "signed_amount") -> DataFrame:
    """(key, xirr): the yearly rate at which discounted flows cancel, by bisection inside one expression.

    Flows are added up by entity and day first, before the shuffle, so the array that a second one gathers is bounded by
    days, not by flows; the halvings run over that array, so plans stay small. Null
    where both ends of the bracket have one sign, or the rate ends within the guard of a bound.
    """
    daily = flows.groupBy(key, date).agg(F.sum(amount).cast("double").alias("a"))
    first = daily.groupBy(key).agg(F.min(date).alias("_first"), F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), "a"))).alias("_f"))

    def npv(rate: Column) -> Column:
        year = lambda x: F.datediff(x["d"], F.col("_first")) / F.lit(365.0)
        return F.aggregate("_f", F.lit(0.0), lambda total, x: total + x["a"] * F.pow(1.0 + rate, -year(x)))

    sign = lambda x: F.when(x >= 0, 1).otherwise(-1)
    start = F.struct(F.lit(RATE_LOW).alias("lo"), F.lit(RATE_HIGH).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2
        low_side = sign(npv(middle)) == F.col("_s")
        return F.struct(F.when(low_side, middle).otherwise(state["lo"]).alias("lo"), F.when(low_side, state["hi"]).otherwise(middle).alias("hi"))

    ends = first.withColumn("_s", sign(npv(F.lit(RATE_LOW)))).withColumn("_t", sign(npv(F.lit(RATE_HIGH))))
    solved = ends.withColumn("_b", F.when(F.col("_s") != F.col("_t"), F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)))
    rate = (F.col("_b.lo") + F.col("_b.hi")) / 2
    inside = (rate - RATE_LOW > GUARD) & (RATE_HIGH - rate > GUARD)
    return solved.select(key, F.when(inside, rate).alias("xirr"))


def multiples(base: DataFrame) -> DataFrame:
    """tvpi, dpi, rvpi, called_pct, unfunded of rows with paid_in, distributed, nav, committed."""
    return base.withColumns({
        "tvpi": safe_divide(F.col("distributed") + F.col("nav"), F.col("paid_in")), "dpi": safe_divide(F.col("distributed"), F.col("paid_in")),
        "rvpi": safe_divide(F.col("nav"), F.col("paid_in")), "called_pct": safe_divide(F.col("paid_in"), F.col("committed")),
        "unfunded": F.col("committed") - F.col("paid_in"),
    })


def public_market_equivalent(flows: DataFrame, index: DataFrame, key: str, date: str = "flow_date", amount: str = "signed_amount") -> DataFrame:
    """Kaplan-Schoar ratio: distributions over calls, both carried forward by the index; null if a month isn't covered.

    index: month (first day), level. Flows meet it by month.
    """
    months = index.select(F.col("month").alias("_m"), "level")
    last = index.agg(F.max_by("level", "month").alias("end_level"))
    met = flows.withColumn("_month", F.trunc(date, "month")).join(months, F.col("_month") == F.col("_m"), "left").crossJoin(last)
    forward = F.col(amount).cast("double") * F.col("end_level") / F.col("level")
    out = met.groupBy(key).agg(
        F.sum(F.when(F.col(amount) > 0, forward)).alias("fv_in"), F.sum(F.when(F.col(amount) < 0, -forward)).alias("fv_out"),
        F.sum(F.col("level").isNull().cast("int")).alias("uncovered"),
    )
    return out.select(key, F.when(F.col("uncovered") == 0, safe_divide(F.col("fv_in"), F.col("fv_out"))).alias("pme"))


def alpha_bps(irr: Column, start_level: Column, end_level: Column, days: Column) -> Column:
    return F.round((irr - (F.pow(end_level / start_level, 365.0 / days) - 1)) * 10000)


def peer_quartile(df: DataFrame, peers: list[str], measure: str, ties: list[str]) -> DataFrame:
    return df.withColumn("quartile", F.ntile(4).over(Window.partitionBy(*peers).orderBy(F.col(measure).desc_nulls_last(), *ties)))


def capital_decomposition(values: DataFrame, key: str, source: str = "source_system", amount: str = "amount") -> DataFrame:
    """Ordered pairs of sources that disagree on a key's amount, with the part that a slip of scale explains.

    A ratio within half a percent of a thousand or a million is a slip of units; the rest is residual, in tolerance if
    it is at most one percent of the larger amount.
    """
    a = values.select(F.col(key), F.col(source).alias("source_a"), F.col(amount).alias("amount_a"))
    b = values.select(F.col(key).alias("_k"), F.col(source).alias("source_b"), F.col(amount).alias("amount_b"))
    met = a.join(b, (F.col(key) == F.col("_k")) & (F.col("source_a") < F.col("source_b")) & (F.col("amount_a") != F.col("amount_b"))).drop("_k")
    big, small = F.greatest("amount_a", "amount_b"), F.least("amount_a", "amount_b")
    ratio = safe_divide(big, small)
    near = lambda x: F.abs(ratio / x - 1) <= 0.005
    slip = F.coalesce(near(1000.0) | near(1000000.0), F.lit(False))
    delta = F.col("amount_a") - F.col("amount_b")
    unit = F.when(slip, delta).otherwise(F.lit(0.0))
    out = met.withColumns({"delta": delta, "unit_scale_component": unit, "is_unit_scale": slip})
    out = out.withColumn("residual", F.col("delta") - F.col("unit_scale_component"))
    return out.withColumn("within_tolerance", F.abs("residual") <= 0.01 * F.greatest(F.abs("amount_a"), F.abs("amount_b")))


@dataclass
class CalculatedField:
    """One declared output table: a base at a grain, joins, pass-through columns and typed expressions."""

    name: str
    grain: list[str]
    outputs: dict[str, tuple[str, str]]  # column: (SQL expression, type token)
    inputs: list[str] = field(default_factory=list)
    joins: list[tuple[str, list[str]]] = field(default_factory=list)
    pass_through: list[str] = field(default_factory=list)
    where: str | None = None

    def check(self) -> None:
        for part in ("name", "grain", "outputs"):
            if not getattr(self, part):
                raise ValueError(f"calculated field lacks {part}")
        for _, token in self.outputs.values():
            type_of(token)


def calculated_field(spec: CalculatedField, base: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    spec.check()
    out = base
    for name, keys in spec.joins:
        if name not in (tables or {}):
            raise ValueError(f"{spec.name}: no table {name!r} to join")
        out = out.join(tables[name], keys, "left")
    if missing := [c for c in (*spec.grain, *spec.inputs, *spec.pass_through) if c not in out.columns]:
        raise ValueError(f"{spec.name}: no columns {missing}")
    if spec.where:
        out = out.where(spec.where)
    made = [F.expr(text).cast(type_of(token)).alias(c) for c, (text, token) in spec.outputs.items()]
    return out.select(*spec.grain, *spec.pass_through, *made)


def hurdle_for(funds: DataFrame, hurdles: DataFrame) -> DataFrame:
    """Each fund's hurdle: its own, else its strategy's. hurdles: config_scope, fund_id, strategy, hurdle_rate."""
    own = hurdles.where("config_scope = 'fund'").select(F.col("fund_id"), F.col("hurdle_rate").alias("own_rate"))
    by_strategy = hurdles.where("config_scope = 'strategy'").select(F.col("strategy"), F.col("hurdle_rate").alias("strategy_rate"))
    out = funds.join(own, "fund_id", "left").join(by_strategy, "strategy", "left")
    scope = F.when(F.col("own_rate").isNotNull(), "fund").when(F.col("strategy_rate").isNotNull(), "strategy")
    return out.withColumn("hurdle_rate", F.coalesce("own_rate", "strategy_rate")).withColumn("hurdle_scope", scope).drop("own_rate", "strategy_rate")
