"""Registered queries of the facts, approvals and publication operators, with their DuckDB statements."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera.operators import bronze, facts, finance, publication, resolution, temporal
from tessera.plans.queries import KEYED, RANKED, RULES, day, derived, feeds, plain, query, t
from tessera.streaming import ingest

# -- facts

VALUED = """
    select o_custkey as fund_id, o_orderkey % 5 as company_id, cast(o_orderdate as date) as valuation_date, case when o_orderkey % 2 = 0 then 'model' else 'market' end as method,
           'position' as valuation_level, 'v' || o_orderkey as source_valuation_id, cast(o_totalprice as decimal(18,4)) as value, cast(o_orderkey % 4 as double) / 4 as confidence_score, 1 as load_datetime from {orders}
    union all
    select o_custkey, o_orderkey % 5, cast(o_orderdate as date), case when o_orderkey % 2 = 0 then 'model' else 'market' end, 'position', 'w' || o_orderkey,
           cast(o_totalprice * 2 as decimal(18,4)), cast(o_orderkey % 4 as double) / 4, 1 + o_orderkey % 2 from {orders} where o_orderkey % 3 = 0"""
VALUES = f"""
    x as ({plain(VALUED)}),
    y as (select * from x qualify row_number() over (partition by fund_id, company_id, valuation_date, method, valuation_level order by load_datetime desc, source_valuation_id) = 1),
    z as (select fund_id, valuation_date, sum(value) as nav, count(distinct company_id) as valued_companies, string_agg(distinct method, ', ' order by method) as methods,
                 min(company_id) as representative_company, avg(confidence_score) as average_confidence from y group by 1, 2)"""


def valued(spark, d):
    return facts.valuation_fact(facts.valuations(derived(spark, d, VALUED)))


@query("q57_fund_valuation_fact", f"""
    with {VALUES} select fund_id, strftime(valuation_date, '%Y-%m-%d') as valuation_date, cast(nav as double) as nav, valued_companies, methods, representative_company, round(average_confidence, 6) as average_confidence from z""")
def q57(spark, d):
    out = valued(spark, d)
    return out.select("fund_id", day("valuation_date").alias("valuation_date"), F.col("nav").cast("double").alias("nav"), "valued_companies", "methods", "representative_company", F.round("average_confidence", 6).alias("average_confidence"))


FUNDS = "select c_custkey as fund_id, cast(c_acctbal * 100 + 2000000 as decimal(18,4)) as committed, case when c_custkey % 11 = 0 then 0.5 when c_custkey % 13 <> 0 then 0.95 end as confidence from {customer}"
MOVES = "select o_custkey as fund_id, cast(o_orderdate as date) as flow_date, case when o_orderkey % 3 <> 0 then cast(o_totalprice as decimal(18,4)) else 0 end as called, case when o_orderkey % 3 = 0 then cast(o_totalprice as decimal(18,4)) else 0 end as distributed from {orders} where o_orderkey % 7 <> 0"
SURE = f"{VALUES}, s as (select * from ({plain(FUNDS)}) where confidence >= 0.85), m as ({plain(MOVES)}), k as (select fund_id, arg_max(nav, valuation_date) as nav, max(valuation_date) as as_of from z group by 1)"


@query("q58_irr_flows_with_terminal_value", f"""
    with {SURE}, l as (select fund_id, flow_date, case when called > 0 then -called else distributed end as amount from m where called > 0 or distributed > 0 union all select fund_id, as_of, nav from k)
    select fund_id, strftime(flow_date, '%Y-%m-%d') as flow_date, cast(amount as double) as amount from l join s using (fund_id)""")
def q58(spark, d):
    out = facts.irr_flows(derived(spark, d, MOVES), valued(spark, d), derived(spark, d, FUNDS))
    return out.select("fund_id", day("flow_date").alias("flow_date"), F.col("amount").cast("double").alias("amount"))


BASIS = "select c_custkey as fund_id, cast(1000 as decimal(18,4)) as recallable, cast(case when c_custkey % 6 = 0 then 50 end as decimal(18,4)) as fee_offset from {customer} where c_custkey % 3 = 0"


@query("q59_performance_base", f"""
    with {SURE}, f as (select fund_id, sum(called) as paid_in, sum(distributed) as distributed from m group by 1), b as ({plain(BASIS)})
    select fund_id, strftime(as_of, '%Y-%m-%d') as as_of, cast(paid_in as double) as paid_in, cast(distributed as double) as distributed, cast(coalesce(nav, 0) as double) as nav,
           round(cast(paid_in as double) / nullif(cast(committed as double), 0), 6) as called_pct, cast(committed - paid_in as double) as unfunded,
           cast(paid_in - coalesce(recallable, 0) - coalesce(fee_offset, 0) as double) as invested_capital
    from s join f using (fund_id) left join k using (fund_id) left join b using (fund_id)""")
def q59(spark, d):
    rates = finance.xirr(facts.irr_flows(derived(spark, d, MOVES), valued(spark, d), derived(spark, d, FUNDS)), "fund_id", "flow_date", "amount")
    out = facts.performance_base(derived(spark, d, FUNDS), derived(spark, d, MOVES), valued(spark, d), rates, derived(spark, d, BASIS))
    figures = [F.col(c).cast("double").alias(c) for c in ("paid_in", "distributed", "nav", "unfunded", "invested_capital")]
    return out.select("fund_id", day("as_of").alias("as_of"), F.round(F.col("called_pct").cast("double"), 6).alias("called_pct"), *figures)


@query("q60_dpi_gap", f"""
    with {SURE}, f as (select fund_id, cast(sum(distributed) as double) / nullif(cast(sum(called) as double), 0) as dpi from m join s using (fund_id) group by 1)
    select fund_id, cast(cast(1 - dpi as decimal(28,6)) as double) as dpi_gap_to_one, dpi >= 1 as dpi_target_reached from f""")
def q60(spark, d):
    base = derived(spark, d, MOVES).groupBy("fund_id").agg(F.sum("called").cast("double").alias("paid_in"), F.sum("distributed").cast("double").alias("distributed"))
    sure = base.join(derived(spark, d, FUNDS).where("confidence >= 0.85").select("fund_id", F.col("committed").cast("double").alias("committed")), "fund_id")
    out = finance.calculated_field(facts.DPI_GAP, finance.multiples(sure.withColumn("nav", F.lit(0.0))).withColumn("target_dpi", F.lit(1.0)))
    return out.select("fund_id", F.col("dpi_gap_to_one").cast("double").alias("dpi_gap_to_one"), "dpi_target_reached")


VEHICLE = """
    select s_suppkey as vehicle_id, 'f' || s_suppkey as cash_flow_id, case s_suppkey % 4 when 0 then 'Call' when 1 then 'Gain' when 2 then 'fee' else 'Transfer' end as cash_flow_type,
           case when s_suppkey % 4 in (0, 2) then 'Outflow' else 'INFLOW' end as direction, s_acctbal as amount, 1 as load_datetime from {supplier}
    union all select s_suppkey, 'f' || s_suppkey, 'Income', 'inflow', s_acctbal + 1, 2 from {supplier} where s_suppkey % 3 = 0"""


@query("q61_vehicle_flows", f"""
    with v as (select * from ({plain(VEHICLE)}) qualify row_number() over (partition by vehicle_id, cash_flow_id order by load_datetime desc) = 1)
    select vehicle_id, cash_flow_id, case when lower(cash_flow_type) = 'call' or lower(direction) = 'outflow' then 'contribution' when lower(cash_flow_type) in ('gain', 'income') or lower(direction) = 'inflow' then 'distribution' else lower(cash_flow_type) end as flow_type,
           case when lower(direction) = 'outflow' then -abs(amount) else abs(amount) end as signed_amount, md5(concat_ws('-', vehicle_id, cash_flow_id)) as vehicle_cash_flow_id from v""")
def q61(spark, d):
    return facts.vehicle_flows(derived(spark, d, VEHICLE)).select("vehicle_id", "cash_flow_id", "flow_type", "signed_amount", "vehicle_cash_flow_id")


FOLLOWED = """
    select s_suppkey as predecessor, s_suppkey + 1 as successor, 'e' || s_suppkey as event_id, 'Renamed' as event_type, 1 as load_datetime from {supplier} where s_suppkey % 5 in (0, 1)
    union all select s_suppkey, s_suppkey + 1, 'e' || s_suppkey, 'MERGED', 2 from {supplier} where s_suppkey % 10 = 0"""


@query("q62_lineage_status", f"""
    with e as (select * from ({plain(FOLLOWED)}) qualify row_number() over (partition by predecessor, successor, event_id order by load_datetime desc) = 1),
    a as (select predecessor as k, max(successor) as successor, max(lower(event_type)) as event_type from e group by 1), b as (select successor as k, max(predecessor) as predecessor from e group by 1)
    select s_suppkey, successor, predecessor, case when successor is not null then 'superseded' when predecessor is not null then 'current' else 'active' end as lineage_status
    from supplier left join a on a.k = s_suppkey left join b on b.k = s_suppkey""")
def q62(spark, d):
    return facts.lineage_status(t(spark, d, "supplier").select("s_suppkey"), facts.succession_events(derived(spark, d, FOLLOWED)), "s_suppkey")


LINES = "select l_orderkey || '-' || l_linenumber as source_record_id, l_orderkey || '|' || l_partkey as line_key, l_linenumber as line_number, l_quantity as quantity, l_extendedprice as revenue from {lineitem} where l_orderkey % 2 = "


@query("q63_order_lines", """
    select md5(concat_ws('-', case when l_orderkey % 2 = 0 then 'even' else 'odd' end, l_orderkey || '-' || l_linenumber)) as order_line_key, case when l_orderkey % 2 = 0 then 'even' else 'odd' end as source_system,
           l_orderkey as order_id, l_partkey as product_id, case when l_orderkey % 9 <> 0 then o_custkey end as customer_id, l_linenumber as line_number, l_quantity as quantity, l_extendedprice as revenue
    from lineitem left join orders on l_orderkey = o_orderkey where l_partkey % 10 <> 0""")
def q63(spark, d):
    link = derived(spark, d, "select distinct l_orderkey || '|' || l_partkey as line_key, l_orderkey as order_id, l_partkey as product_id from {lineitem} where l_partkey % 10 <> 0")
    buyers = derived(spark, d, "select o_orderkey as order_id, o_custkey as customer_id from {orders} where o_orderkey % 9 <> 0")
    out = facts.order_lines({"even": derived(spark, d, LINES + "0"), "odd": derived(spark, d, LINES + "1")}, link, buyers)
    return out.select("order_line_key", "source_system", "order_id", "product_id", "customer_id", "line_number", "quantity", "revenue")


CLASSES = """
    select c_custkey as fund_id, 'DEPT' as kind, 'D' || c_custkey % 4 as value, cast('1992-01-01' as date) as start from {customer} where c_custkey % 3 <> 0
    union all select c_custkey, 'DEPT', 'D9', cast('1996-01-01' as date) from {customer} where c_custkey % 2 = 0
    union all select c_custkey, 'SECTOR', c_mktsegment, cast('1995-06-01' as date) from {customer}"""


@query("q64_classification_two_kinds", f"""
    with c as (select *, coalesce(lead(start) over (partition by fund_id, kind order by start), date '9999-12-31') as stop from ({plain(CLASSES)}))
    select o_orderkey, coalesce(a.value, 'UNKNOWN') as department, coalesce(b.value, 'UNKNOWN') as sector from orders
    left join c a on a.kind = 'DEPT' and a.fund_id = o_custkey and cast(o_orderdate as date) >= a.start and cast(o_orderdate as date) < a.stop
    left join c b on b.kind = 'SECTOR' and b.fund_id = o_custkey and cast(o_orderdate as date) >= b.start and cast(o_orderdate as date) < b.stop""")
def q64(spark, d):
    versions = temporal.scd2(derived(spark, d, CLASSES), ["fund_id", "kind"], "start")
    fact = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("fund_id"), "o_orderdate")
    return facts.classified(fact, versions, {"DEPT": "department", "SECTOR": "sector"}, "fund_id", "o_orderdate").select("o_orderkey", "department", "sector")


# -- approvals

HISTORY = "select user_id as deal, case event_type when 'view' then 'SCREENING' when 'click' then 'DECISION' when 'purchase' then 'DECISION' else 'DECLINED' end as stage, cast(ts as date) as effective_from, ts as recorded_at from {events}"
DECIDED = """
    select distinct user_id as deal, case user_id % 4 when 0 then 'approve' when 1 then 'decline' when 2 then 'approve_with_conditions' else 'defer' end as decision, cast('2024-02-01 10:00:00' as timestamp) as decided_at from {events} where user_id % 5 <> 0
    union all select distinct user_id, 'defer', cast('2024-02-02 10:00:00' as timestamp) from {events} where user_id % 8 = 0"""
LAST = f"""
    l as (select deal, stage, effective_from, recorded_at from ({plain(HISTORY)}) qualify row_number() over (partition by deal order by effective_from desc, recorded_at desc, stage desc) = 1),
    n as (select * from ({plain(DECIDED)}) qualify row_number() over (partition by deal order by decided_at desc, decision desc) = 1)"""


@query("q65_stages_from_decisions", f"""
    with {LAST} select deal, case decision when 'decline' then 'DECLINED' else 'COMMITTED' end as stage, strftime(decided_at, '%Y-%m-%d') as effective_from from n join l using (deal) where stage = 'DECISION' and decision <> 'defer'""")
def q65(spark, d):
    return facts.stages_from_decisions(derived(spark, d, HISTORY), derived(spark, d, DECIDED)).select("deal", "stage", day("effective_from").alias("effective_from"))


@query("q66_approval_queue", f"""
    with {LAST} select deal, decision, strftime(effective_from, '%Y-%m-%d') as since, date '2024-03-01' - effective_from as days_waiting from l left join n using (deal) where stage = 'DECISION' and (decision is null or decision = 'defer')""")
def q66(spark, d):
    out = facts.approval_queue(derived(spark, d, HISTORY), derived(spark, d, DECIDED), F.lit("2024-03-01").cast("date"))
    return out.select("deal", "decision", day("effective_from").alias("since"), F.col("days_waiting").cast("long").alias("days_waiting"))


@query("q67_pending_set", f"""
    with {KEYED} select 'customer' as entity_type, source_system, source_record_id, name, normalised_name from e where not keep
    union all select 'supplier', 'erp', 'S' || s_suppkey, s_name, null from supplier where s_suppkey % 4 = 0""")
def q67(spark, d):
    suppliers = derived(spark, d, "select 'erp' as source_system, 'S' || s_suppkey as source_record_id, s_name as name, cast(null as string) as normalised_name, s_suppkey % 4 = 0 as is_pending_probabilistic from {supplier}")
    return resolution.pending_set({"customer": resolution.ranked_keys(feeds(spark, d), "customer", RANKED), "supplier": suppliers}, ["source_system", "source_record_id", "name", "normalised_name"])


# -- publication

INTENTS = """
    select user_id % 50 as stream, cast(event_id % 40 + 1 as bigint) as revision, 'd' || event_id % 40 as digest from {events} where not (user_id % 50 % 3 = 0 and event_id % 40 = 20) and not (user_id % 50 % 7 = 1 and event_id % 40 = 5)
    union all select distinct user_id % 50, cast(31 as bigint), 'other' from {events} where user_id % 50 % 4 = 2"""
CURSOR = "select distinct user_id % 50 as stream, cast(4 as bigint) as revision, case when user_id % 50 = 10 then 'x' else 'd3' end as digest from {events} where user_id % 50 % 5 = 0"
ORDERED = f"""
    i as (select stream, revision, min(digest) as digest, count(distinct digest) > 1 as two from ({plain(INTENTS)}) group by 1, 2),
    m as (select i.*, coalesce(c.revision, 0) as pos, c.digest as held from i left join ({plain(CURSOR)}) c using (stream)),
    g as (select stream, min(revision) as first_gap from (select a.stream, a.revision from m a where a.revision > a.pos and (a.two or (a.revision > a.pos + 1 and not exists (select 1 from i b where b.stream = a.stream and b.revision = a.revision - 1)))) group by 1),
    o as (select stream, revision, m.digest, case when two then 'conflict' when revision = pos and m.digest = held then 'replay' when revision = pos then 'conflict' when revision < pos then 'stale' when first_gap is not null and revision >= first_gap then 'gap' else 'applied' end as outcome
          from m left join g using (stream))"""


@query("q68_gap_ordered_projection", f"with {ORDERED} select stream, revision, outcome from o")
def q68(spark, d):
    return publication.gap_ordered(derived(spark, d, INTENTS), derived(spark, d, CURSOR)).select("stream", "revision", "outcome")


@query("q69_projection_cursor", f"""
    with {ORDERED}, u as (select stream, revision, digest from o where outcome = 'applied' union all select * from ({plain(CURSOR)}))
    select stream, max(revision) as revision, arg_max(digest, revision) as digest from u group by 1""")
def q69(spark, d):
    cursor = derived(spark, d, CURSOR)
    return publication.advanced(cursor, publication.gap_ordered(derived(spark, d, INTENTS), cursor))


CONFIRMED = "select distinct user_id % 50 as stream, cast(event_id % 40 + 1 as bigint) as revision, case when event_id % 40 = 9 and user_id % 50 < 5 then 'wrong' else 'd' || event_id % 40 end as digest from {events} where event_id % 40 < 30"


@query("q70_outbox_phases", f"""
    with i as (select stream, revision, min(digest) as digest, max(digest) as other from ({plain(INTENTS)}) group by 1, 2), c as (select stream, revision, min(digest) as low, max(digest) as high from ({plain(CONFIRMED)}) group by 1, 2)
    select stream, revision, case when digest <> other or coalesce(low <> digest or high <> digest, false) then 'conflict' when low is not null then 'confirmed' else 'prepared' end as phase from i left join c using (stream, revision)""")
def q70(spark, d):
    return publication.outbox(derived(spark, d, INTENTS), derived(spark, d, CONFIRMED)).select("stream", "revision", "phase")


BATCHES = "select s_nationkey as stream, s_suppkey as revision, 'b' || s_suppkey as batch, case when s_suppkey % 6 = 0 then true end as withdrawn from {supplier}"


@query("q71_published_ledger", f"""
    select stream, batch, lag(batch) over (partition by stream order by revision) as parent, lead(batch) over (partition by stream order by revision) is null as is_active from ({plain(BATCHES)}) where withdrawn is null""")
def q71(spark, d):
    return publication.ledger(derived(spark, d, BATCHES)).select("stream", "batch", "parent", "is_active")


CHANGES = "select event_id, user_id, case when event_id % 31 <> 0 then event_id - case when event_id % 9 = 0 then 5000 else 0 end end as sequence from {events}"


@query("q72_sequence_breaks", f"""
    with c as (select *, max(sequence) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from ({plain(CHANGES)})) select event_id, user_id, sequence from c where sequence is null or sequence <= before""")
def q72(spark, d):
    return publication.sequence_breaks(derived(spark, d, CHANGES), ["user_id"], "sequence", "event_id").select("event_id", "user_id", "sequence")


STRICTER = [bronze.FieldRule("type_known", "accepted_values", "event_type", values=["view", "click", "purchase", "error"]), bronze.FieldRule("value_small", "range", "value", low=0, high=250)]


@query("q73_revalidation", """
    with e as (select event_id, case when event_type not in ('view', 'click', 'purchase') or value > 400 then 'rejected' else 'accepted' end as was, case when event_type not in ('view', 'click', 'purchase', 'error') or value > 250 then 'rejected' else 'accepted' end as now from events)
    select * from e where was <> now""")
def q73(spark, d):
    events = t(spark, d, "events")
    was, now = (bronze.dispose(bronze.field_findings(events, rules)) for rules in (RULES, STRICTER))
    return publication.revalidated(was, now, "event_id")


CLAIMS = "select user_id as delivery_id, 'c' || event_id % 5 as digest from {events} where user_id % 3 <> 0"
OFFERED = "select distinct user_id as delivery_id, 'c' || user_id % 7 as digest from {events}"


@query("q74_claims", f"""
    with h as (select delivery_id, list(distinct digest) as held from ({plain(CLAIMS)}) group by 1)
    select delivery_id, case when held is null then 'new' when list_contains(held, digest) then 'replay' else 'conflict' end as outcome from ({plain(OFFERED)}) left join h using (delivery_id)""")
def q74(spark, d):
    return bronze.claim(derived(spark, d, CLAIMS), derived(spark, d, OFFERED)).select("delivery_id", "outcome")


@query("q75_quarantine_release", """
    select event_id from events where (event_type not in ('view', 'click', 'purchase') or value > 400) and event_type in ('view', 'click', 'purchase', 'error') and value <= 250 and event_id % 10 <> 0""")
def q75(spark, d):
    events = t(spark, d, "events")
    held = bronze.split(bronze.dispose(bronze.field_findings(events, RULES)))[1]
    released = events.where("event_id % 10 = 0").select("event_id")
    return bronze.release(held, STRICTER, released, "event_id").select("event_id")


@query("q76_freshness", """
    with s as (select s_suppkey as stream, case when s_suppkey % 3 = 0 then 'healthy' else 'missing' end as state from supplier)
    select stream, case when state = 'healthy' and stream % 2 = 0 then '2024-01-02 00:00:00' else '1970-01-01 00:00:00' end as committed_at from s""")
def q76(spark, d):
    states = derived(spark, d, "select s_suppkey as stream, case when s_suppkey % 3 = 0 then 'healthy' else 'missing' end as state from {supplier}")
    committed = derived(spark, d, "select s_suppkey as stream, cast('2024-01-02 00:00:00' as timestamp) as committed_at from {supplier} where s_suppkey % 2 = 0")
    return publication.freshness(states, committed).select("stream", F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at"))


@query("q77_cron_boundaries", """
    select strftime(b - case when b >= timestamp '2024-03-31 03:00:00' and b < timestamp '2024-10-27 03:00:00' then interval 2 hour else interval 1 hour end, '%Y-%m-%d %H:%M:%S') as boundary
    from (select unnest(generate_series(timestamp '2024-03-01 02:30:00', timestamp '2024-11-30 02:30:00', interval 1 day)) as b) where isodow(b) < 6 or day(b) = 31 except select '2024-03-31 01:30:00'""")
def q77(spark, d):
    """Half past two in a zone with summer time, on weekdays and the 31st: the skipped time doesn't occur."""
    out = publication.cron_boundaries(spark, "30 2 31 * 1-5", "Europe/Berlin", date(2024, 3, 1), date(2024, 11, 30))
    return out.select(F.date_format("boundary", "yyyy-MM-dd HH:mm:ss").alias("boundary"))


@query("q78_events_rollup_by_stream", """
    select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour_start, event_type, count(*) as n_events, cast(sum(cast(value as decimal(18,4))) as double) as total_value from events group by 1, 2""")
def q78(spark, d):
    """The rollup run as a stream, micro-batch by micro-batch, to a table in the shared folder."""
    schema = t(spark, d, "events").schema
    out = ingest.roll_up_files(spark, f"{d}/events.parque[t]", schema)  # a pattern, as a stream takes no single file
    return out.select(F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "event_type", "n_events", F.col("total_value").cast("double").alias("total_value"))
