"""Registered queries over the driver's tables, each with the DuckDB statement that defines the same rows.

Inputs that the tables lack (overlapping feeds, histories, decisions) are derived in the query by fixed rules, written
once as SQL text that both sides run; everything after the derivation goes through the operators here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import bronze, finance, graph, quality, relational, resolution, semantic, survivorship, temporal, vault

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
AS_OF = "2001-12-31"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def derived(spark: SparkSession, d: str, text: str) -> DataFrame:
    """A derivation in SQL over the tables it names in braces."""
    return spark.sql(text, **{n: t(spark, d, n) for n in TABLES if "{" + n + "}" in text})


def plain(text: str) -> str:
    """The same derivation for DuckDB, where the tables are views."""
    for n in TABLES:
        text = text.replace("{" + n + "}", n)
    return text


def query(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


def money(c: Column | str) -> Column:
    """Exact sums: floats become decimals before they are added."""
    return F.sum(F.expr(c).cast("decimal(18,4)") if isinstance(c, str) else c.cast("decimal(18,4)")).cast("double")


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# -- staging and scalars

NAME = "nullif(regexp_replace(upper(trim({0})), '[^A-Z0-9]', '', 'g'), '')"


@query("q01_stage_typed_orders", """
    select cast(o_orderkey as integer) as order_id, strftime(o_orderdate, '%Y-%m-%d') as order_date,
           nullif(trim(o_orderstatus), '') as status, cast(cast(o_totalprice as decimal(28,6)) as double) as total,
           cast(null as integer) as priority_number
    from orders""")
def q01(spark, d):
    raw = t(spark, d, "orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority")])
    return raw.select(
        S.safe_cast(F.col("o_orderkey"), "int").alias("order_id"), day(S.safe_cast(F.col("o_orderdate"), "date")).alias("order_date"),
        S.blank_to_null(F.concat(F.lit(" "), "o_orderstatus")).alias("status"), S.safe_cast(F.col("o_totalprice"), "numeric").cast("double").alias("total"),
        S.safe_cast(F.col("o_orderpriority"), "int").alias("priority_number"),
    )


@query("q02_normalise_names", f"""
    select c_custkey, {NAME.format("c_name")} as name_key, {NAME.format("c_mktsegment || ' -'")} as segment_key, {NAME.format("'--'")} as blank_key,
           md5('customer|' || c_custkey) as golden_key
    from customer""")
def q02(spark, d):
    return t(spark, d, "customer").select(
        "c_custkey", S.normalise_name(F.col("c_name")).alias("name_key"), S.normalise_name(F.concat("c_mktsegment", F.lit(" -"))).alias("segment_key"),
        S.normalise_name(F.lit("--")).alias("blank_key"), S.stable_golden_key("customer", F.col("c_custkey")).alias("golden_key"),
    )


PREFIXED = "case when p_partkey % 3 = 0 then 'PRT ' || p_partkey || ' x' when p_partkey % 3 = 1 then 'prt-' || p_partkey else p_name end"


@query("q03_prefixed_ids", f"""
    with s as (select p_partkey, {PREFIXED} as raw from part),
         b as (select *, upper(regexp_replace(trim(raw), '[^A-Z0-9]', '', 'g')) as bare from s)
    select p_partkey, case when regexp_matches(bare, '^PRT[0-9]+') then 'PRT-' || regexp_extract(bare, '^PRT([0-9]+)', 1) else upper(trim(raw)) end as part_id,
           case when regexp_matches(raw, '([0-9]+)') then regexp_extract(raw, '([0-9]+)', 1) end as digits
    from b""")
def q03(spark, d):
    raw = derived(spark, d, f"select p_partkey, {PREFIXED} as raw from {{part}}")
    return raw.select("p_partkey", S.normalise_prefixed_id(F.col("raw"), "PRT").alias("part_id"), S.regexp_first(F.col("raw"), "([0-9]+)").alias("digits"))


@query("q51_scalar_composites", """
    select s_suppkey, round(greatest(0.0, 1.0 - levenshtein(s_name, n_name) / greatest(length(s_name), length(n_name), 1)), 6) as name_similarity,
           round(case when s_acctbal = 0 and n_nationkey = 0 then 1.0 else greatest(0.0, 1.0 - abs(s_acctbal - n_nationkey * 400) / (greatest(abs(s_acctbal), abs(n_nationkey * 400.0), 1e-9) * 0.5)) end, 6) as value_near,
           cast(case when upper(trim(s_name)) = upper(trim(n_name)) then 1.0 else 0.0 end as double) as same_name,
           round(s_acctbal / nullif(n_nationkey, 0), 6) as ratio,
           md5(concat_ws('-', cast(s_suppkey as varchar), coalesce(cast(nullif(n_nationkey, 3) as varchar), '_null_'))) as surrogate,
           upper(md5(concat_ws('~', upper(trim(s_name)), '^^'))) as vault_key,
           '{"id":' || s_suppkey || ',"none":null}' as doc
    from supplier join nation on s_nationkey = n_nationkey""")
def q51(spark, d):
    met = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n = F.col("n_nationkey") * F.lit(400.0)
    return met.select(
        "s_suppkey", F.round(S.string_similarity(F.col("s_name"), F.col("n_name")), 6).alias("name_similarity"),
        F.round(S.value_proximity(F.col("s_acctbal"), n, 0.5), 6).alias("value_near"), S.categorical_match(F.col("s_name"), F.col("n_name")).alias("same_name"),
        F.round(S.safe_divide(F.col("s_acctbal"), F.col("n_nationkey")), 6).alias("ratio"),
        S.surrogate_key(F.col("s_suppkey"), F.expr("nullif(n_nationkey, 3)")).alias("surrogate"), S.vault_hash(F.col("s_name"), F.lit(" ")).alias("vault_key"),
        S.to_json_object(id=F.col("s_suppkey"), none=F.lit(None).cast("string")).alias("doc"),
    )


# -- history

SEGMENTS = """
    select c_custkey, c_mktsegment as segment, cast('1998-01-01' as date) as start from {customer}
    union all
    select c_custkey, case when c_custkey % 2 = 0 then 'BUILDING' else 'MACHINERY' end, cast('1990-01-01' as date) from {customer} where c_custkey % 5 <> 0"""
SCD = """
    h as ({0}),
    v as (select *, start as effective_from, coalesce(lead(start) over (partition by c_custkey order by start), cast('9999-12-31' as date)) as effective_to from h)"""


@query("q04_revenue_by_segment_pit", f"""
    with {SCD.format(plain(SEGMENTS))}
    select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month_start, coalesce(segment, 'UNKNOWN') as segment, count(*) as n_orders,
           cast(sum(cast(o_totalprice as decimal(18,4))) as double) as revenue,
           floor(cast(sum(cast(o_totalprice as decimal(18,4))) as double) / count(*) * 100) / 100 as average_order_value
    from orders left join v on o_custkey = c_custkey and cast(o_orderdate as date) >= effective_from and cast(o_orderdate as date) < effective_to
    group by 1, 2""")
def q04(spark, d):
    versions = temporal.scd2(derived(spark, d, SEGMENTS), ["c_custkey"], "start")
    met = temporal.point_in_time(t(spark, d, "orders"), versions, {"o_custkey": "c_custkey"}, "o_orderdate", columns=["segment"])
    out = met.groupBy(day(S.date_trunc("month", F.col("o_orderdate"))).alias("month_start"), F.coalesce("segment", F.lit("UNKNOWN")).alias("segment")).agg(
        F.count(F.lit(1)).alias("n_orders"), money("o_totalprice").alias("revenue")
    )
    return out.withColumn("average_order_value", F.floor(F.col("revenue") / F.col("n_orders") * 100) / 100)


# -- entity resolution

FEEDS = """
    select 'crm' as source_system, 'R' || c_custkey as source_record_id, c_custkey as true_id,
           case when c_custkey % 4 = 0 then 'L' || c_custkey end as loyalty, case when c_custkey % 2 = 0 then 'c' || c_custkey || '@x.io' end as email, c_name as name
    from {customer} where c_custkey % 3 <> 2
    union all
    select 'shop', 'C' || c_custkey, c_custkey, case when c_custkey % 8 = 0 then 'L' || c_custkey end,
           case when c_custkey % 6 <> 5 then 'c' || c_custkey || '@x.io' end, c_name
    from {customer} where c_custkey % 3 <> 0
    union all
    select 'market', 'M' || c_custkey, c_custkey, cast(null as string), cast(null as string), lower(c_name) from {customer} where c_custkey % 5 = 0"""
DUCK_FEEDS = plain(FEEDS).replace("as string", "as varchar")
RANKED = ["loyalty", "email", "normalised_name"]
KEYED = f"""
    f as (select *, {NAME.format("name")} as normalised_name from ({DUCK_FEEDS})),
    k as (select *, coalesce(loyalty, email, normalised_name) as exact_key,
                 case when loyalty is not null then 'loyalty' when email is not null then 'email' when normalised_name is not null then 'normalised_name' end as exact_key_type from f),
    r as (select *, count(*) over w as match_row_count,
                 (select count(distinct source_system) from k k2 where k2.exact_key = k.exact_key and k2.exact_key_type = k.exact_key_type) as match_source_count
          from k window w as (partition by exact_key_type, exact_key)),
    e as (select *, not (exact_key_type = 'normalised_name' and match_row_count = 1) as keep from r)"""


def feeds(spark, d):
    return derived(spark, d, FEEDS).withColumn("normalised_name", S.normalise_name(F.col("name")))


@query("q05_er_ranked_keys", f"""
    with {KEYED}
    select source_system, source_record_id, exact_key_type, exact_key, match_row_count, match_source_count,
           case when keep then md5('customer|' || exact_key_type || '|' || exact_key) end as golden_key,
           cast(case when not keep then 0.0 when exact_key_type = 'normalised_name' then 0.95 else 1.0 end as double) as confidence, not keep as is_pending_probabilistic
    from e""")
def q05(spark, d):
    out = resolution.ranked_keys(feeds(spark, d), "customer", RANKED)
    return out.select("source_system", "source_record_id", "exact_key_type", "exact_key", "match_row_count", "match_source_count", "golden_key", F.col("confidence").cast("double").alias("confidence"), "is_pending_probabilistic")


CHAIN = """
    select s_suppkey as record, 'sys' || s_suppkey % 3 as source_system,
           'A' || cast(floor(s_suppkey / 2) as bigint) as first_id, case when s_suppkey % 8 <> 0 then 'B' || cast(floor((s_suppkey + 1) / 2) as bigint) end as second_id
    from {supplier}"""


@query("q06_er_transitive_components", f"""
    with recursive r as ({plain(CHAIN)}),
    ids as (select record, 'first_id|' || first_id as identifier, 0 as rank, first_id as value from r union all
            select record, 'second_id|' || second_id, 1, second_id from r where second_id is not null),
    reach(record, other) as (select record, record from r union
            select reach.record, b.record from reach join ids a on a.record = reach.other join ids b on a.identifier = b.identifier),
    comp as (select record, min(other) as component from reach group by 1),
    best as (select component, min(row(rank, value)) as best from ids join comp using (record) group by 1),
    size as (select component, count(*) as match_row_count, count(distinct source_system) as match_source_count from r join comp using (record) group by 1)
    select record, component, match_row_count, match_source_count, best[2] as exact_key, md5('supplier|' || case best[1] when 0 then 'first_id' else 'second_id' end || '|' || best[2]) as golden_key
    from comp join best using (component) join size using (component)""")
def q06(spark, d):
    out = resolution.transitive(derived(spark, d, CHAIN), "supplier", ["first_id", "second_id"])
    return out.select("record", "component", "match_row_count", "match_source_count", "exact_key", "golden_key")


PENDING = """
    select 'part' as entity_type, 'sys' || p_partkey % 3 as source_system, p_partkey as source_id,
           case when p_partkey % 7 = 0 then upper(p_name) else p_name || ' ' || cast(p_partkey % 50 as string) end as name, p_type as sector,
           date_add(cast('2000-01-01' as date), cast(p_partkey % 400 as int)) as day, case when p_partkey % 11 <> 0 then p_retailprice end as value
    from {part}"""
DUCK_PENDING = plain(PENDING).replace("as string", "as varchar").replace("date_add(cast('2000-01-01' as date), cast(p_partkey % 400 as int))", "cast('2000-01-01' as date) + cast(p_partkey % 400 as integer)")
SCORED = f"""
    p as ({DUCK_PENDING}),
    m as (select l.*, r.source_system as matched_system, r.source_id as matched_id,
                 greatest(0.0, 1.0 - levenshtein(l.name, r.name) / cast(greatest(length(l.name), length(r.name), 1) as double)) as s1,
                 case when upper(trim(l.sector)) = upper(trim(r.sector)) then 1.0 else 0.0 end as s2,
                 greatest(0.0, 1.0 - abs(l.day - r.day) / 365.0) as s3,
                 case when l.value is null or r.value is null then null when l.value = 0 and r.value = 0 then 1.0
                      else greatest(0.0, 1.0 - abs(l.value - r.value) / (greatest(abs(l.value), abs(r.value), 1e-9) * 0.25)) end as s4
          from p l join p r on l.entity_type = r.entity_type and l.source_system <> r.source_system),
    c as (select *, round((cast(s1 as double) * 0.5 + cast(s2 as double) * 0.2 + cast(s3 as double) * 0.15 + coalesce(s4 * 0.15, 0.0)) / (0.85 + case when s4 is not null then 0.15 else 0.0 end), 9) as score from m),
    b as (select entity_type, source_system, source_id, matched_system, matched_id, score from c
          qualify row_number() over (partition by entity_type, source_system, source_id order by score desc, matched_system, matched_id) = 1)"""
SCORING = resolution.Scoring()


def pairs(spark, d):
    pending = derived(spark, d, PENDING)
    marked = resolution.candidate_pairs(pending, SCORING)
    return pending, marked.withColumn("raw_score", F.col("score")).withColumn("score", F.round("score", 6))


@query("q07_er_candidate_scores", f"""
    with {SCORED} select entity_type, source_system, source_id, floor(score * 10000 + 0.000001) / 10000 as score from b""")
def q07(spark, d):
    return pairs(spark, d)[1].select("entity_type", "source_system", "source_id", (F.floor(F.round("raw_score", 9) * 10000 + 0.000001) / 10000).alias("score"))


@query("q08_er_tier2_routing", f"""
    with {SCORED}, x as (select p.source_system, p.source_id, round(b.score, 6) as score from p left join b using (entity_type, source_system, source_id))
    select source_system, source_id, case when score > 0.85 then 'auto' when score >= 0.65 then 'review' else 'reject' end as route from x""")
def q08(spark, d):
    pending, scored = pairs(spark, d)
    return resolution.route(pending, scored, SCORING).select("source_system", "source_id", "route")


DECISIONS = """
    select 'sys' || s_suppkey % 3 || ':' || s_suppkey as low, 'sys' || (s_suppkey + 1) % 3 || ':' || (s_suppkey + 1) as high,
           case when s_suppkey % 2 = 0 then 'match' else 'distinct' end as decision, s_suppkey as reviewed_at from {supplier}
    union all
    select 'sys' || (s_suppkey + 1) % 3 || ':' || (s_suppkey + 1), 'sys' || s_suppkey % 3 || ':' || s_suppkey, 'defer', 1000000 - s_suppkey from {supplier} where s_suppkey % 3 = 0"""
QUEUE = """
    select 'part' as entity_type, 'sys' || s_suppkey % 3 as source_system, s_suppkey as source_id, 'sys' || (s_suppkey + 1) % 3 as matched_system, s_suppkey + 1 as matched_id,
           case when s_suppkey % 4 = 0 then 0.9 when s_suppkey % 4 = 1 then 0.7 else 0.66 end as score from {supplier}"""


@query("q09_er_review_queue", f"""
    with q as ({plain(QUEUE)}), l as ({plain(DECISIONS)}),
    n as (select least(low, high) as a, greatest(low, high) as b, decision from l
          qualify row_number() over (partition by least(low, high), greatest(low, high) order by reviewed_at desc) = 1)
    select source_system, source_id, matched_id, coalesce(decision, 'pending') as status
    from q left join n on a = least(source_system || ':' || source_id, matched_system || ':' || matched_id) and b = greatest(source_system || ':' || source_id, matched_system || ':' || matched_id)
    where score >= 0.65 and score <= 0.85""")
def q09(spark, d):
    queue = derived(spark, d, QUEUE)
    routed = resolution.route(queue.drop("matched_system", "matched_id", "score"), queue, SCORING)
    log = resolution.latest_decisions(derived(spark, d, DECISIONS), "low", "high", "reviewed_at", ["decision"])
    return resolution.review_queue(routed, log).select("source_system", "source_id", "matched_id", "status")


@query("q10_er_precision_recall", f"""
    with {KEYED}, g as (select *, case when keep then md5('customer|' || exact_key_type || '|' || exact_key) end as golden_key from e)
    select (select count(*) from (select golden_key from g where golden_key is not null group by 1 having count(distinct true_id) > 1)) as mixed_keys,
           (select count(*) from (select true_id from g where golden_key is not null group by 1 having count(distinct golden_key) > 1)) as split_ids,
           (select count(*) from g where golden_key is null) as gaps""")
def q10(spark, d):
    resolved = resolution.ranked_keys(feeds(spark, d), "customer", RANKED)
    labels = resolved.select("source_system", "source_record_id", "true_id")
    return resolution.precision_recall(resolved, labels, ["source_system", "source_record_id"], "true_id")


@query("q11_latest_decision_dedupe", """
    select least(user_id, event_id % 50) as pair_low, greatest(user_id, event_id % 50) as pair_high, event_id, event_type
    from events qualify row_number() over (partition by 1, least(user_id, event_id % 50), greatest(user_id, event_id % 50) order by ts desc, event_id desc) = 1""")
def q11(spark, d):
    log = t(spark, d, "events").withColumn("other", F.col("event_id") % 50)
    return resolution.latest_decisions(log, "user_id", "other", "ts", ["event_id"]).select("pair_low", "pair_high", "event_id", "event_type")


@query("q23_identity_union_alias_map", f"""
    with {KEYED}, g as (select *, md5('customer|' || exact_key_type || '|' || exact_key) as golden_key from e where keep),
    s as (select golden_key, source_system, min(source_record_id) as id from g group by 1, 2)
    select golden_key, (select array_to_string(list_sort(list(distinct name)), '|') from g g2 where g2.golden_key = g.golden_key) as aliases,
           (select '{{' || string_agg('"' || source_system || '":"' || id || '"', ',' order by source_system) || '}}' from s where s.golden_key = g.golden_key) as source_ids
    from (select distinct golden_key from g) g""")
def q23(spark, d):
    out = resolution.identity_union(resolution.ranked_keys(feeds(spark, d), "customer", RANKED), "name", "source_record_id")
    return out.select("golden_key", F.array_join("aliases", "|").alias("aliases"), "source_ids")


@query("q52_unresolved_and_external", f"""
    with {KEYED}
    select 'unresolved' as kind, source_record_id as id, cast(null as varchar) as golden_key from e where not keep
    union all
    select 'external', loyalty, min(md5('customer|' || exact_key_type || '|' || exact_key)) from e where keep and loyalty is not null group by 2""")
def q52(spark, d):
    resolved = resolution.ranked_keys(feeds(spark, d), "customer", RANKED)
    left = resolution.unresolved({"customer": resolved}).select(F.lit("unresolved").alias("kind"), F.col("source_record_id").alias("id"), F.lit(None).cast("string").alias("golden_key"))
    return left.unionByName(resolution.external_lookup(resolved, "loyalty").select(F.lit("external").alias("kind"), F.col("loyalty").alias("id"), "golden_key"))


# -- vault


def loaded() -> Column:
    return F.lit("2002-01-01 00:00:00").cast("timestamp")



def hashed(*columns: str) -> str:
    return "upper(md5(concat_ws('~', " + ", ".join(f"coalesce(nullif(upper(trim(cast({c} as varchar))), ''), '^^')" for c in columns) + ")))"


@query("q12_hub_load", f"""
    select {hashed("c_custkey")} as hub_customer_hk, c_custkey, case when c_custkey in (select o_custkey from orders) then 'a_orders' else 'b_customer' end as record_source from customer
    union select {hashed("o_custkey")}, o_custkey, 'a_orders' from orders where o_custkey not in (select c_custkey from customer)""")
def q12(spark, d):
    a = vault.stage(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), {"hub_customer_hk": ["c_custkey"]}, None, "a_orders", loaded())
    b = vault.stage(t(spark, d, "customer").select("c_custkey"), {"hub_customer_hk": ["c_custkey"]}, None, "b_customer", loaded())
    return vault.load_hub([a, b], "hub_customer_hk", ["c_custkey"]).select("hub_customer_hk", "c_custkey", "record_source")


@query("q13_link_load", f"""
    select distinct {hashed("l_orderkey", "l_partkey")} as link_hk, {hashed("l_orderkey")} as hub_order_hk, {hashed("l_partkey")} as hub_part_hk from lineitem""")
def q13(spark, d):
    rows = vault.stage(t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), {"link_hk": ["l_orderkey", "l_partkey"], "hub_order_hk": ["l_orderkey"], "hub_part_hk": ["l_partkey"]}, None, "lineitem", loaded())
    return vault.load_link([rows], "link_hk", ["hub_order_hk", "hub_part_hk"]).select("link_hk", "hub_order_hk", "hub_part_hk")


STATES = "select o_custkey, o_orderstatus as status, o_orderpriority as priority, o_orderkey as effective from {orders}"


def satellite_stage(spark, d, where="true"):
    rows = derived(spark, d, STATES + f" where {where}")
    return vault.stage(rows, {"hub_customer_hk": ["o_custkey"]}, vault.payload(["status", "priority"], ["priority"]), "orders", loaded())


VERSIONS = "v as (select *, lag(status) over (partition by o_custkey order by effective) as prior from ({0}))"


@query("q14_satellite_versions", f"""
    with {VERSIONS.format(plain(STATES))} select {hashed("o_custkey")} as hub_customer_hk, effective, status from v where prior is null or prior <> status""")
def q14(spark, d):
    return vault.load_satellite(satellite_stage(spark, d), "hub_customer_hk", ["status"], "effective").select("hub_customer_hk", "effective", "status")


def satellite_news(stage: str) -> str:
    """DuckDB: staged versions that differ from the one before them, held ones (w) and staged ones in one order."""
    return f"""(select count(*) from (select *, lag(status) over (partition by o_custkey order by effective, held desc, {hashed("status")}) as prior
        from (select *, 1 as held from w union all select s.*, 0 from ({stage}) s left join w using (o_custkey, status, effective) where w.status is null))
        where held = 0 and (prior is null or prior <> status))"""


LATE = "select o_custkey, case when effective % 3 = 0 then 'late' else status end as status, effective - 1 as effective from ({0}) where effective % 5 = 0"


@query("q15_satellite_replay_noop", f"""
    with {VERSIONS.format(plain(STATES))}, w as (select o_custkey, status, effective from v where prior is null or prior <> status)
    select (select count(*) from w) as held, {satellite_news(LATE.format(plain(STATES)))} as late_added,
           {satellite_news(f"select o_custkey, status, effective from ({plain(STATES)})")} as replayed""")
def q15(spark, d):
    """The whole stage loaded twice, with backdated versions between: the second time adds nothing."""
    rows = satellite_stage(spark, d)
    late = derived(spark, d, LATE.format(STATES))
    late = vault.stage(late, {"hub_customer_hk": ["o_custkey"]}, ["status"], "orders", loaded())
    held = vault.load_satellite(rows, "hub_customer_hk", ["status"], "effective")
    added = vault.load_satellite(late, "hub_customer_hk", ["status"], "effective", held)
    again = vault.load_satellite(rows, "hub_customer_hk", ["status"], "effective", held)
    counts = [x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((held, "held"), (added, "late_added"), (again, "replayed"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


SATS = {
    "crm": "select c_custkey as k, case when c_custkey % 3 = 0 then c_name end as name, c_mktsegment as segment, cast('2000-01-01' as date) as effective_from from {customer} where c_custkey % 2 = 0",
    "shop": "select c_custkey as k, upper(c_name) as name, case when c_custkey % 4 <> 0 then 'SHOP' end as segment, case when c_custkey % 5 = 0 then cast('2001-01-01' as date) else cast('1999-01-01' as date) end as effective_from from {customer} where c_custkey % 7 <> 0",
}


def golden(spark, d, strategy):
    sats = {n: derived(spark, d, s).withColumn("load_datetime", loaded()) for n, s in SATS.items()}
    hub = t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    rules = [survivorship.Rule("name", strategy, ["crm", "shop"]), survivorship.Rule("segment", strategy, ["crm", "shop"])]
    return survivorship.golden_record(hub, sats, rules, "k").select("k", "name", "name__source", "segment", "segment__source")


@query("q16_survivorship_first_non_null", f"""
    with a as ({plain(SATS["crm"])}), b as ({plain(SATS["shop"])})
    select c_custkey as k, coalesce(a.name, b.name) as name, case when a.name is not null then 'crm' when b.name is not null then 'shop' end as name__source,
           coalesce(a.segment, b.segment) as segment, case when a.segment is not null then 'crm' when b.segment is not null then 'shop' end as segment__source
    from customer left join a on a.k = c_custkey left join b on b.k = c_custkey""")
def q16(spark, d):
    return golden(spark, d, "first_non_null")


@query("q17_survivorship_most_recent", f"""
    with a as ({plain(SATS["crm"])}), b as ({plain(SATS["shop"])}),
    x as (select c_custkey as k, a.name as an, b.name as bn, a.segment as asg, b.segment as bsg, a.effective_from as af, b.effective_from as bf
          from customer left join a on a.k = c_custkey left join b on b.k = c_custkey),
    y as (select *, case when an is null and bn is null then null when bn is null or (an is not null and af >= bf) then 'crm' else 'shop' end as name__source,
                 case when asg is null and bsg is null then null when bsg is null or (asg is not null and af >= bf) then 'crm' else 'shop' end as segment__source from x)
    select k, case name__source when 'crm' then an when 'shop' then bn end as name, name__source, case segment__source when 'crm' then asg when 'shop' then bsg end as segment, segment__source from y""")
def q17(spark, d):
    return golden(spark, d, "most_recent")


HUB_AS_OF = "select distinct user_id, cast('2024-01-15 00:00:00' as timestamp) as as_of from {events}"


@query("q18_pit_load_pointers", f"""
    with h as ({plain(HUB_AS_OF)})
    select h.user_id, strftime(max(case when event_type = 'click' then ts end), '%Y-%m-%d %H:%M:%S') as click_load, strftime(max(case when event_type = 'view' then ts end), '%Y-%m-%d %H:%M:%S') as view_load
    from h left join events e on e.user_id = h.user_id and e.ts <= h.as_of group by 1""")
def q18(spark, d):
    events = t(spark, d, "events")
    sats = {k: events.where(F.col("event_type") == k) for k in ("click", "view")}
    out = temporal.load_pointers(derived(spark, d, HUB_AS_OF), sats, "user_id", "as_of", "ts")
    return out.select("user_id", *[F.date_format(f"{k}_load", "yyyy-MM-dd HH:mm:ss").alias(f"{k}_load") for k in sats])


STAGES = "select user_id, event_type as stage, cast(ts as date) as start, event_id from {events}"
STAGED = """
    h as ({0}),
    v as (select *, lead(start) over (partition by user_id order by start, event_id) as following from h)"""


@query("q19_scd2_unknown_member", f"""
    with {STAGED.format(plain(STAGES))}
    select user_id, stage, strftime(start, '%Y-%m-%d') as effective_from, strftime(coalesce(following, date '9999-12-31'), '%Y-%m-%d') as effective_to, following is null as is_current from v
    union all select -1, 'UNKNOWN', '1900-01-01', '9999-12-31', true""")
def q19(spark, d):
    dim = temporal.scd2(derived(spark, d, STAGES), ["user_id"], "start", ["event_id"]).select("user_id", "stage", "effective_from", "effective_to", "is_current")
    whole = temporal.with_unknown(dim, {"user_id": F.lit(-1), "stage": F.lit("UNKNOWN"), "effective_from": F.lit("1900-01-01"), "effective_to": F.lit("9999-12-31"), "is_current": F.lit(True)})
    return whole.withColumns({"effective_from": day("effective_from"), "effective_to": day("effective_to")})


@query("q20_stage_same_day_ties", f"""
    with {STAGED.format(plain(STAGES))}
    select strftime(start, '%Y-%m-%d') as day, count(*) as n_versions, count(*) filter (where following = start) as n_empty,
           cast(sum(least(coalesce(following, date '9999-12-31'), date '2024-02-01') - start) as bigint) as days_in_state
    from v group by 1""")
def q20(spark, d):
    v = temporal.scd2(derived(spark, d, STAGES), ["user_id"], "start", ["event_id"])
    return v.groupBy(day("effective_from").alias("day")).agg(
        F.count(F.lit(1)).alias("n_versions"), F.count(F.when(F.col("effective_to") == F.col("effective_from"), 1)).alias("n_empty"),
        F.sum(temporal.days_in_state(F.lit("2024-02-01").cast("date"))).alias("days_in_state"),
    )


SUCCESSION = "select n_nationkey as predecessor, n_nationkey + 100 as successor, cast('1999-06-01' as date) as effective_date from {nation} where n_nationkey % 4 = 0"


@query("q21_succession_overlay", f"""
    with e as ({plain(SUCCESSION)}), s as (select s_suppkey, s_nationkey as owner, date '1900-01-01' as start, 0 as p from supplier
         union all select s_suppkey, successor, effective_date, 1 from supplier join e on s_nationkey = predecessor)
    select s_suppkey, owner, strftime(start, '%Y-%m-%d') as effective_from, strftime(coalesce(lead(start) over (partition by s_suppkey order by start, p), date '9999-12-31'), '%Y-%m-%d') as effective_to from s""")
def q21(spark, d):
    out = temporal.succession_overlay(t(spark, d, "supplier"), derived(spark, d, SUCCESSION), "s_suppkey", "s_nationkey")
    return out.select("s_suppkey", "owner", day("effective_from").alias("effective_from"), day("effective_to").alias("effective_to"))


@query("q22_date_spine_dim", """
    with b as (select cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as z from orders), s as (select cast(unnest(generate_series(a, z, interval 1 day)) as date) as day from b)
    select cast(year(day) * 10000 + month(day) * 100 + day(day) as integer) as date_key, strftime(day, '%Y-%m-%d') as day, cast(year(day) as integer) as year, cast(quarter(day) as integer) as quarter,
           cast(month(day) as integer) as month, strftime(date_trunc('month', day), '%Y-%m-%d') as month_start, strftime(date_trunc('quarter', day), '%Y-%m-%d') as quarter_start from s""")
def q22(spark, d):
    return temporal.date_spine(t(spark, d, "orders"), "o_orderdate").withColumns({c: day(c) for c in ("day", "month_start", "quarter_start")})


@query("q53_crosswalk_history", f"""
    with {KEYED}, g as (select *, md5('customer|' || exact_key_type || '|' || exact_key) as golden_key from e where keep),
    w as (select true_id, min(golden_key) as golden_key from g group by 1),
    s as (select c_custkey as true_id, case when c_custkey % 9 = 0 then 'LEGACY' else c_mktsegment end as segment from customer)
    select w.golden_key, case when segment in ('BUILDING', 'MACHINERY', 'FURNITURE') then segment else 'UNKNOWN' end as segment from s join w using (true_id)""")
def q53(spark, d):
    resolved = resolution.ranked_keys(feeds(spark, d), "customer", RANKED)
    labels = resolved.select("source_system", "source_record_id", "true_id")
    seed = derived(spark, d, "select c_custkey as true_id, case when c_custkey % 9 = 0 then 'LEGACY' else c_mktsegment end as segment from {customer}")
    known = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("FURNITURE",)], "segment string")
    return vault.crosswalk_history(seed, labels, resolved, "true_id", known, "segment").select("golden_key", "segment")


# -- finance

RAW_FLOWS = """
    select 'alpha' as source_system, 'a' || o_orderkey as flow_id, o_custkey as fund, cast(o_orderdate as date) as flow_date, 'Call' as raw_type, cast(o_totalprice as decimal(18,4)) as amount, 'USD' as currency from {orders} where o_orderkey % 2 = 0
    union all
    select 'beta', 'b' || o_orderkey, o_custkey, cast(o_orderdate as date), 'CAPITAL_CALL', cast(-o_totalprice as decimal(18,4)), 'USD' from {orders} where o_orderkey % 4 = 0
    union all
    select 'beta', 'd' || o_orderkey, o_custkey, cast(o_orderdate as date), case when o_orderkey % 3 = 0 then 'Dist' else 'income' end, cast(o_totalprice as decimal(18,4)), 'USD' from {orders} where o_orderkey % 2 = 1"""
FLOW_TYPES = {"call": "contribution", "capital_call": "contribution", "dist": "distribution", "income": "distribution"}
FLOWS = f"""
    f as ({plain(RAW_FLOWS)}),
    n as (select *, case when lower(raw_type) in ('call', 'capital_call') then 'contribution' else 'distribution' end as flow_type from f),
    g as (select *, case when flow_type = 'contribution' then -abs(amount) else abs(amount) end as signed_amount from n),
    c as (select * from g qualify row_number() over (partition by fund, flow_date, flow_type, signed_amount, currency order by case source_system when 'alpha' then 1 when 'beta' then 2 else 3 end, source_system, flow_id) = 1)"""


def flows(spark, d):
    return finance.conform_flows(derived(spark, d, RAW_FLOWS), FLOW_TYPES, ["contribution"], ["fund"], {"alpha": 1, "beta": 2})


@query("q24_cash_flow_conform_dedupe", f"""
    with {FLOWS} select flow_id, fund, source_system, strftime(flow_date, '%Y-%m-%d') as flow_date, flow_type, cast(signed_amount as double) as signed_amount from c""")
def q24(spark, d):
    return flows(spark, d).select("flow_id", "fund", "source_system", day("flow_date").alias("flow_date"), "flow_type", F.col("signed_amount").cast("double").alias("signed_amount"))


BASE = f"""
    {FLOWS},
    b as (select fund, cast(sum(case when flow_type = 'contribution' then -signed_amount else 0 end) as double) as paid_in, cast(sum(case when flow_type = 'distribution' then signed_amount else 0 end) as double) as distributed from c group by 1),
    p as (select fund, paid_in, distributed, round(c_acctbal * 1000, 2) as nav, 5000000.0 as committed, c_mktsegment as strategy from b join customer on fund = c_custkey)"""


def performance(spark, d):
    f = flows(spark, d)
    base = f.groupBy("fund").agg(
        F.sum(F.when(F.col("flow_type") == "contribution", -F.col("signed_amount")).otherwise(0)).cast("double").alias("paid_in"),
        F.sum(F.when(F.col("flow_type") == "distribution", F.col("signed_amount")).otherwise(0)).cast("double").alias("distributed"),
    )
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("fund"), F.round(F.col("c_acctbal") * 1000, 2).alias("nav"), F.lit(5000000.0).alias("committed"), F.col("c_mktsegment").alias("strategy"))
    return base.join(c, "fund")


@query("q25_fund_multiples", f"""
    with {BASE} select fund, round((distributed + nav) / nullif(paid_in, 0), 6) as tvpi, round(distributed / nullif(paid_in, 0), 6) as dpi, round(nav / nullif(paid_in, 0), 6) as rvpi,
           round(paid_in / committed, 6) as called_pct, round(committed - paid_in, 2) as unfunded from p""")
def q25(spark, d):
    out = finance.multiples(performance(spark, d))
    return out.select("fund", *[F.round(c, 6).alias(c) for c in ("tvpi", "dpi", "rvpi", "called_pct")], F.round("unfunded", 2).alias("unfunded"))


HURDLES = """
    select 'fund' as config_scope, c_custkey as fund_id, cast(null as string) as strategy, 0.1 as hurdle_rate from {customer} where c_custkey % 10 = 0
    union all select distinct 'strategy', cast(null as bigint), c_mktsegment, 0.08 from {customer} where c_mktsegment <> 'FURNITURE'"""


@query("q26_hurdle_override", """
    select c_custkey as fund_id, c_mktsegment as strategy, cast(case when c_custkey % 10 = 0 then 0.1 when c_mktsegment <> 'FURNITURE' then 0.08 end as double) as hurdle_rate,
           case when c_custkey % 10 = 0 then 'fund' when c_mktsegment <> 'FURNITURE' then 'strategy' end as hurdle_scope from customer""")
def q26(spark, d):
    funds = t(spark, d, "customer").select(F.col("c_custkey").alias("fund_id"), F.col("c_mktsegment").alias("strategy"))
    return finance.hurdle_for(funds, derived(spark, d, HURDLES)).select("fund_id", "strategy", F.col("hurdle_rate").cast("double").alias("hurdle_rate"), "hurdle_scope")


@query("q27_identity_residuals", f"""
    with {BASE} select fund, strategy, cast(cast(round((distributed + nav) / nullif(paid_in, 0) - distributed / nullif(paid_in, 0) - nav / nullif(paid_in, 0), 6) as decimal(28,6)) as double) as residual,
           distributed > paid_in as returned from p where paid_in > 0""")
def q27(spark, d):
    spec = finance.CalculatedField(
        "identity_residuals", ["fund"], {"residual": ("round(tvpi - dpi - rvpi, 6) + 0.0", "numeric"), "returned": ("distributed > paid_in", "boolean")},
        inputs=["tvpi", "dpi", "rvpi"], pass_through=["strategy"], where="paid_in > 0",
    )
    return finance.calculated_field(spec, finance.multiples(performance(spark, d))).withColumn("residual", F.col("residual").cast("double"))


XIRR_FLOWS = "select o_custkey as fund, cast(o_orderdate as date) as flow_date, cast(case when o_orderkey % 3 = 0 then -3 * o_totalprice else o_totalprice end as double) as amount from {orders}"


@query("q28_xirr_by_customer", f"""
    with recursive f as ({plain(XIRR_FLOWS)}), o as (select fund, min(flow_date) as d0 from f group by 1),
    l as (select fund, list((flow_date - d0) / 365.0 order by flow_date, amount) as ts, list(amount order by flow_date, amount) as am from f join o using (fund) group by 1),
    e as (select *, list_sum(list_transform(range(1, len(am) + 1), lambda i: am[i] * pow(1 - 0.9999, -ts[i]))) as a0, list_sum(list_transform(range(1, len(am) + 1), lambda i: am[i] * pow(101.0, -ts[i]))) as a1 from l),
    b(fund, ts, am, s, lo, hi, k) as (
        select fund, ts, am, case when a0 >= 0 then 1 else -1 end, cast(-0.9999 as double), cast(100 as double), 0 from e where (a0 >= 0) <> (a1 >= 0)
        union all
        select fund, ts, am, s, case when g = s then m else lo end, case when g = s then hi else m end, k + 1
        from (select *, (lo + hi) / 2 as m, case when list_sum(list_transform(range(1, len(am) + 1), lambda i: am[i] * pow(1 + (lo + hi) / 2, -ts[i]))) >= 0 then 1 else -1 end as g from b where k < 20)),
    r as (select fund, (lo + hi) / 2 as rate from b where k = 20)
    select o.fund, round(case when rate + 0.9999 > 0.005 and 100 - rate > 0.005 then rate end, 5) as xirr from o left join r using (fund)""")
def q28(spark, d):
    return finance.xirr(derived(spark, d, XIRR_FLOWS), "fund", "flow_date", "amount").select("fund", F.round("xirr", 5).alias("xirr"))


INDEX = "select cast(date_trunc('month', o_orderdate) as date) as month, 100.0 + cast(count(*) as double) / 10 + (year(min(o_orderdate)) - 1995) * 12 + month(min(o_orderdate)) as level from {orders} where o_orderdate < '2001-07-01' group by 1"


@query("q29_pme_ratio", f"""
    with f as ({plain(XIRR_FLOWS)}), i as ({plain(INDEX)}), e as (select cast(arg_max(level, month) as double) as z from i),
    j as (select fund, amount, level, amount * z / level as fv from f cross join e left join i on date_trunc('month', flow_date) = i.month)
    select fund, case when count(*) filter (where level is null) = 0 then round(sum(case when amount > 0 then fv end) / nullif(sum(case when amount < 0 then -fv end), 0), 6) end as pme from j group by 1""")
def q29(spark, d):
    index = derived(spark, d, INDEX).withColumn("level", F.col("level").cast("double"))
    return finance.public_market_equivalent(derived(spark, d, XIRR_FLOWS), index, "fund", "flow_date", "amount").select("fund", F.round("pme", 6).alias("pme"))


@query("q30_alpha_bps", """
    select s_suppkey, round((s_acctbal / 50000 - (pow((200.0 + s_suppkey) / (100.0 + s_suppkey), 365.0 / (400 + s_suppkey)) - 1)) * 10000) as alpha_bps from supplier""")
def q30(spark, d):
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").select("s_suppkey", finance.alpha_bps(F.col("s_acctbal") / 50000, k + F.lit(100.0), k + F.lit(200.0), k + 400).alias("alpha_bps"))


@query("q31_peer_quartile", """
    select c_custkey, c_mktsegment, cast(ntile(4) over (partition by c_mktsegment order by c_acctbal desc nulls last, c_custkey) as integer) as quartile from customer""")
def q31(spark, d):
    return finance.peer_quartile(t(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", ["c_custkey"]).select("c_custkey", "c_mktsegment", "quartile")


CAPITAL = """
    select s_suppkey, 'a' as source_system, round(abs(s_acctbal) + 1, 2) as amount from {supplier}
    union all select s_suppkey, 'b', case when s_suppkey % 3 = 0 then round(abs(s_acctbal) + 1, 2) * 1000 when s_suppkey % 3 = 1 then round(abs(s_acctbal) + 1, 2) else round(abs(s_acctbal) + 1, 2) + 7 end from {supplier}
    union all select s_suppkey, 'c', round(abs(s_acctbal) + 1, 2) * 1000000 from {supplier} where s_suppkey % 5 = 0"""


@query("q32_capital_decomposition", f"""
    with v as ({plain(CAPITAL)}), m as (select a.s_suppkey, a.source_system as source_a, b.source_system as source_b, a.amount as x, b.amount as y from v a join v b on a.s_suppkey = b.s_suppkey and a.source_system < b.source_system and a.amount <> b.amount),
    r as (select *, abs(greatest(x, y) / least(x, y) / 1000 - 1) <= 0.005 or abs(greatest(x, y) / least(x, y) / 1000000 - 1) <= 0.005 as slip from m)
    select s_suppkey, source_a, source_b, round(x - y, 2) as delta, slip as is_unit_scale, round(case when slip then 0 else x - y end, 2) as residual,
           abs(case when slip then 0 else x - y end) <= 0.01 * greatest(abs(x), abs(y)) as within_tolerance from r""")
def q32(spark, d):
    out = finance.capital_decomposition(derived(spark, d, CAPITAL), "s_suppkey")
    return out.select("s_suppkey", "source_a", "source_b", F.round("delta", 2).alias("delta"), "is_unit_scale", F.round("residual", 2).alias("residual"), "within_tolerance")


@query("q33_order_line_conservation", """
    with s as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,4))) as line_total from lineitem group by 1)
    select o_orderkey, cast(coalesce(line_total, 0) as double) as line_total from orders left join s on l_orderkey = o_orderkey where abs(coalesce(line_total, 0) - cast(o_totalprice as decimal(18,4))) > 100000""")
def q33(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("decimal(18,4)").alias("part"))
    heads = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,4)").alias("whole"))
    out = quality.conservation(lines, heads, "o_orderkey", "part", "whole", 100000)
    return out.select("o_orderkey", F.coalesce("line_total", F.lit(0)).cast("double").alias("line_total"))


@query("q34_bridge_rollup_delta", """
    with a as (select o_custkey as k, sum(cast(o_totalprice as decimal(18,4))) as x, count(*) as n from orders group by 1),
         b as (select o_custkey as k, sum(cast(l_extendedprice as decimal(18,4))) as y from lineitem join orders on l_orderkey = o_orderkey group by 1)
    select k as o_custkey, n as n_orders, cast(x as double) as header_total, cast(coalesce(y, 0) as double) as line_total, cast(x - coalesce(y, 0) as double) as delta from a left join b using (k)""")
def q34(spark, d):
    orders = t(spark, d, "orders")
    a = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("x"))
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("p"))
    b = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("p").alias("y"))
    y = F.coalesce("y", F.lit(0))
    return a.join(b, "o_custkey", "left").select("o_custkey", "n_orders", F.col("x").cast("double").alias("header_total"), y.cast("double").alias("line_total"), (F.col("x") - y).cast("double").alias("delta"))


@query("q35_exposure_lookthrough", """
    with e as (select s_nationkey, p_type, sum(cast(l_extendedprice as decimal(18,4))) as x, string_agg(distinct p_brand, ', ' order by p_brand) as brands, count(distinct p_brand) as n_brands
               from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1, 2)
    select s_nationkey, p_type, cast(x as double) as exposure, round(cast(x as double) / cast(sum(x) over (partition by s_nationkey) as double), 6) as share, brands, n_brands from e""")
def q35(spark, d):
    lines = t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("x"))
    met = lines.join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = met.groupBy("s_nationkey", "p_type").agg(F.sum("x").alias("x"), S.joined_distinct("p_brand").alias("brands"), F.countDistinct("p_brand").alias("n_brands"))
    whole = e.groupBy("s_nationkey").agg(F.sum("x").alias("total"))
    return e.join(whole, "s_nationkey").select("s_nationkey", "p_type", F.col("x").cast("double").alias("exposure"), F.round(F.col("x").cast("double") / F.col("total").cast("double"), 6).alias("share"), "brands", "n_brands")


# -- facts

@query("q36_classification_fact_unknown_fallback", f"""
    with {SCD.format(plain(SEGMENTS))}
    select o_orderkey, coalesce(segment, 'UNKNOWN') as segment, case when segment is null then -1 else o_custkey end as member_key
    from orders left join v on o_custkey = c_custkey and c_custkey % 3 <> 0 and cast(o_orderdate as date) >= effective_from and cast(o_orderdate as date) < effective_to""")
def q36(spark, d):
    versions = temporal.scd2(derived(spark, d, SEGMENTS), ["c_custkey"], "start").where("c_custkey % 3 <> 0")
    met = temporal.point_in_time(t(spark, d, "orders"), versions, {"o_custkey": "c_custkey"}, "o_orderdate", columns=["segment"])
    unknown = met.sparkSession.range(1).select(F.lit("UNKNOWN").alias("unknown_segment"), F.lit(-1).cast("long").alias("unknown_key"))
    out = met.crossJoin(F.broadcast(unknown))  # one row
    return out.select("o_orderkey", F.coalesce("segment", "unknown_segment").alias("segment"), F.when(F.col("segment").isNull(), F.col("unknown_key")).otherwise(F.col("o_custkey")).alias("member_key"))


@query("q37_pipeline_funnel_cycle_time", f"""
    with {STAGED.format(plain(STAGES))}, s as (select user_id, min(start) as first_day, max(case when stage = 'purchase' then start end) as closed from v group by 1),
    c as (select user_id, stage from v where start <= date '2024-01-20' and coalesce(following, date '9999-12-31') > date '2024-01-20')
    select c.stage, count(*) as n_users, count(closed) as n_closed, cast(sum(coalesce(closed, date '2024-01-20') - first_day) as bigint) as cycle_days from c join s using (user_id) group by 1""")
def q37(spark, d):
    as_of = F.lit("2024-01-20").cast("date")
    v = temporal.scd2(derived(spark, d, STAGES), ["user_id"], "start", ["event_id"])
    s = v.groupBy("user_id").agg(F.min("effective_from").alias("first_day"), F.max(F.when(F.col("stage") == "purchase", F.col("effective_from"))).alias("closed"))
    met = temporal.in_force(v, as_of).select("user_id", "stage").join(s, "user_id")
    cycle = F.datediff(F.coalesce("closed", as_of), F.col("first_day"))
    return met.groupBy("stage").agg(F.count(F.lit(1)).alias("n_users"), F.count("closed").alias("n_closed"), F.sum(cycle).alias("cycle_days"))


@query("q54_decision_to_stage", """
    with x as (select user_id, event_type, ts, event_id from events where event_type in ('click', 'error')), l as (select * from x qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select user_id, case event_type when 'click' then 'COMMITTED' when 'error' then 'DECLINED' end as stage from l""")
def q54(spark, d):
    log = t(spark, d, "events").where(F.col("event_type").isin("click", "error")).select("user_id", "event_type", "ts", "event_id")
    last = relational.newest(log, ["user_id"], ["ts", "event_id"])
    return last.select("user_id", F.when(F.col("event_type") == "click", "COMMITTED").when(F.col("event_type") == "error", "DECLINED").alias("stage"))


# -- deliveries

RULES = [
    bronze.FieldRule("type_known", "accepted_values", "event_type", values=["view", "click", "purchase"]),
    bronze.FieldRule("value_small", "range", "value", low=0, high=400),
    bronze.FieldRule("value_low", "range", "value", severity="warn", high=300),
]
BAD = "(event_type not in ('view', 'click', 'purchase') or value > 400)"


@query("q38_bronze_field_rules", """
    select event_id, concat_ws(',', case when event_type not in ('view', 'click', 'purchase') then 'type_known:VALUE_NOT_ACCEPTED' end,
           case when value > 300 then 'value_low:OUT_OF_RANGE' end, case when value > 400 then 'value_small:OUT_OF_RANGE' end) as codes from events""")
def q38(spark, d):
    out = bronze.field_findings(t(spark, d, "events"), RULES)
    return out.select("event_id", F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["rule"], x["code"])), ",").alias("codes"))


@query("q39_bronze_unique_groups", """
    with k as (select *, case when event_id % 97 <> 0 then user_id end as u, cast(ts as date) as day from events), n as (select u, day, event_type, count(*) as n from k where u is not null group by 1, 2, 3)
    select event_id, coalesce(n, 0) as group_size, case when k.u is null then 'NULL_NOT_ALLOWED' when n > 1 then 'DUPLICATE_KEY' end as code
    from k left join n on k.u = n.u and k.day = n.day and k.event_type = n.event_type""")
def q39(spark, d):
    rows = t(spark, d, "events").withColumn("u", F.expr("case when event_id % 97 <> 0 then user_id end")).withColumn("day", F.col("ts").cast("date"))
    out = bronze.unique_findings(rows, "one_a_day", ["u", "day", "event_type"])
    return out.select("event_id", "group_size", F.get("findings", F.lit(0))["code"].alias("code"))


@query("q40_bronze_publication_decision", f"""
    with b as (select user_id % 20 as batch, count(*) as framed, count(*) filter (where {BAD}) as failed from events group by 1)
    select batch, framed, failed, framed - failed as passed, case when framed < 100 then 'reject' when failed = 0 then 'publish_all' when failed < framed and failed / framed <= 0.5 then 'publish_partial' else 'reject' end as decision from b""")
def q40(spark, d):
    rows = bronze.dispose(bronze.field_findings(t(spark, d, "events"), RULES)).withColumn("batch", F.col("user_id") % 20)
    return bronze.decide(rows, bronze.Policy(max_error_share=0.5, min_rows=100), ["batch"]).select("batch", "framed", "failed", "passed", "decision")


@query("q41_bronze_quarantine_split", f"""
    select event_type, case when {BAD} then 'rejected' else 'accepted' end as disposition, count(*) as n_rows from events group by 1, 2""")
def q41(spark, d):
    good, bad = bronze.split(bronze.dispose(bronze.field_findings(t(spark, d, "events"), RULES)))
    return good.unionByName(bad).groupBy("event_type", "disposition").agg(F.count(F.lit(1)).alias("n_rows"))


@query("q42_snapshot_diff", """
    select c_custkey, case when c_custkey % 5 = 0 then 'deleted' else 'inserted' end as change from customer where (c_custkey % 5 = 0) <> (c_custkey % 7 = 0)""")
def q42(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    return bronze.snapshot_diff(c.where("c_custkey % 7 <> 0"), c.where("c_custkey % 5 <> 0"), ["c_custkey"])


@query("q43_tombstone_latest", """
    select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1 and event_type <> 'error'""")
def q43(spark, d):
    changes = t(spark, d, "events").withColumn("gone", F.col("event_type") == "error")
    return bronze.latest_state(changes, ["user_id"], "event_id", "gone").select("user_id", "event_id", "event_type")


DUE = "select event_id, ts as due, case when event_id % 4 <> 0 then ts + interval '1' second * (event_id % 7000) end as arrived from {events}"


@query("q44_timeliness_states", f"""
    with x as ({plain(DUE)}), y as (select *, cast(floor(epoch(coalesce(arrived, timestamp '2024-01-20 00:00:00'))) as bigint) - cast(floor(epoch(due)) as bigint) as delay from x)
    select event_id, case when arrived is not null and delay < 1800 then 'on_time' when delay >= 5400 then 'missing' when delay >= 1800 then 'late' else 'awaiting' end as state from y""")
def q44(spark, d):
    rows = t(spark, d, "events").select("event_id", F.col("ts").alias("due"), F.when(F.col("event_id") % 4 != 0, F.expr("timestampadd(second, event_id % 7000, ts)")).alias("arrived"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return bronze.timeliness(rows, "due", "arrived", now, 1800, 5400).select("event_id", "state")


@query("q45_schedule_boundaries", """
    select strftime(b, '%Y-%m-%d %H:%M:%S') as boundary, count(event_id) as n_events
    from (select unnest(generate_series(timestamp '2024-01-01 00:00:00', timestamp '2024-01-30 18:00:00', interval 6 hour)) as b) left join events on ts >= b and ts < b + interval 6 hour group by 1""")
def q45(spark, d):
    b = bronze.boundaries(spark, "2024-01-01 00:00:00", "2024-01-30 18:00:00", 6 * 3600)
    counted = t(spark, d, "events").groupBy(F.window("ts", "6 hours").start.alias("boundary")).agg(F.count(F.lit(1)).alias("n"))
    return b.join(counted, "boundary", "left").select(F.date_format("boundary", "yyyy-MM-dd HH:mm:ss").alias("boundary"), F.coalesce("n", F.lit(0)).alias("n_events"))


APPLIED = """
    select s_suppkey as stream, case when s_suppkey % 5 = 1 then 'other' else 'd' || s_suppkey end as digest, case when s_suppkey % 5 <> 2 then cast('2024-01-01 00:00:00' as timestamp) end as committed_at,
           case when s_suppkey % 5 = 3 then cast('2024-01-01 00:00:00' as timestamp) else cast('2024-01-01 11:59:00' as timestamp) end as heartbeat_at from {supplier} where s_suppkey % 6 <> 0
    union all select s_suppkey, 'd' || s_suppkey, cast('2024-01-01 00:00:00' as timestamp), cast('2024-01-01 11:59:00' as timestamp) from {supplier} where s_suppkey % 11 = 1"""


@query("q46_projection_fault_classifier", f"""
    with a as (select stream, count(*) as n, min(digest) as shown, min(committed_at) as c, max(heartbeat_at) as h from ({plain(APPLIED)}) group by 1)
    select s_suppkey as stream, case when coalesce(n, 0) = 0 then 'missing' when n > 1 then 'duplicate' when shown <> 'd' || s_suppkey then 'wrong_digest' when c is null then 'null_committed'
           when h < timestamp '2024-01-01 11:00:00' then 'stale_heartbeat' else 'healthy' end as state from supplier left join a on stream = s_suppkey""")
def q46(spark, d):
    expected = t(spark, d, "supplier").select(F.col("s_suppkey").alias("stream"), F.concat(F.lit("d"), "s_suppkey").alias("digest"))
    return bronze.projection_faults(expected, derived(spark, d, APPLIED), F.lit("2024-01-01 12:00:00").cast("timestamp"), 3600)


ORDER_MODEL = semantic.SemanticModel(
    "orders", "o_orderkey", "o_orderdate", {"status": "o_orderstatus", "priority": "o_orderpriority"},
    [
        semantic.Measure("revenue", "sum", "cast(o_totalprice as decimal(18,4))"), semantic.Measure("urgent_revenue", "sum", "cast(o_totalprice as decimal(18,4))", "o_orderpriority = '1-URGENT'"),
        semantic.Measure("n_customers", "count_distinct", "o_custkey"), semantic.Measure("n_large", "sum_boolean", "o_totalprice > 200000"), semantic.Measure("n_orders", "count", "o_orderkey"),
    ],
)


@query("q47_semantic_metrics", """
    select o_orderstatus as status, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') as quarter_start, cast(sum(cast(o_totalprice as decimal(18,4))) as double) as revenue,
           cast(sum(case when o_orderpriority = '1-URGENT' then cast(o_totalprice as decimal(18,4)) end) as double) as urgent_revenue, count(distinct o_custkey) as n_customers,
           cast(sum(cast(o_totalprice > 200000 as integer)) as bigint) as n_large, count(o_orderkey) as n_orders
    from orders where o_orderdate >= timestamp '1996-01-01' group by 1, 2""")
def q47(spark, d):
    out = ORDER_MODEL.query(t(spark, d, "orders"), ["revenue", "urgent_revenue", "n_customers", "n_large", "n_orders"], ["status"], "quarter", "o_orderdate >= timestamp '1996-01-01'")
    return out.withColumns({"quarter_start": day("quarter_start"), "revenue": F.col("revenue").cast("double"), "urgent_revenue": F.col("urgent_revenue").cast("double")})


def order_graph(spark, d):
    orders, lines = t(spark, d, "orders"), t(spark, d, "lineitem")
    node = graph.nodes([graph.NodeSpec("customer", t(spark, d, "customer"), "c_custkey"), graph.NodeSpec("order", orders, "o_orderkey"), graph.NodeSpec("part", t(spark, d, "part"), "p_partkey")])
    specs = [
        graph.EdgeSpec("placed", "placed_by", "customer", "order", orders, "o_custkey", "o_orderkey"),
        graph.EdgeSpec("contains", "contained_in", "order", "part", lines, "l_orderkey", "l_partkey"),
    ]
    return node, graph.edges(specs, {"customer", "order", "part"})


@query("q48_graph_nodes_edges_degree", """
    with e as (select 'placed' as verb, 'customer' as source_label, cast(o_custkey as varchar) as s, cast(o_orderkey as varchar) as x from orders union select 'contains', 'order', cast(l_orderkey as varchar), cast(l_partkey as varchar) from lineitem),
         g as (select verb, source_label, s, count(*) as d from e group by 1, 2, 3)
    select verb, source_label, count(*) as n_sources, cast(sum(d) as bigint) as n_edges, max(d) as max_degree from g group by 1, 2""")
def q48(spark, d):
    return graph.degrees(order_graph(spark, d)[1])


@query("q55_graph_paths", """
    select cast(o_custkey as varchar) as start_id, count(distinct l_partkey) as n_parts from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def q55(spark, d):
    return graph.path(order_graph(spark, d)[1], ["placed", "contains"]).groupBy("start_id").agg(F.count(F.lit(1)).alias("n_parts"))


@query("q49_generic_tests_summary", """
    select * from (values ('customer_key_unique', (select count(*) from (select c_custkey from customer group by 1 having count(*) > 1))),
      ('order_customer_exists', (select count(*) from orders where o_custkey not in (select c_custkey from customer))),
      ('order_status_known', (select count(*) from orders where o_orderstatus not in ('P', 'F'))),
      ('discount_in_range', (select count(*) from lineitem where l_discount < 0 or l_discount > 0.05)),
      ('ship_date_known', (select count(*) from lineitem where l_shipdate is null)),
      ('price_positive', (select count(*) from lineitem where not l_extendedprice > 1000)),
      ('line_key_unique', (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)))) as v(check_name, n_faults)""")
def q49(spark, d):
    c, o, li = t(spark, d, "customer"), t(spark, d, "orders"), t(spark, d, "lineitem")
    groups = quality.summary({
        "customer_key_unique": quality.unique(c, "c_custkey"), "order_customer_exists": quality.relationships(o, "o_custkey", c, "c_custkey"),
        "order_status_known": quality.accepted_values(o, "o_orderstatus", ["P", "F"]), "line_key_unique": quality.unique(li, "l_orderkey", "l_linenumber"),
    })
    lines = quality.row_checks(li, {
        "discount_in_range": ~F.col("l_discount").between(0, 0.05), "ship_date_known": F.col("l_shipdate").isNull(),
        "price_positive": ~F.coalesce(F.col("l_extendedprice") > 1000, F.lit(False)),
    })
    return groups.unionByName(lines)


@query("q50_events_stream_rollup", """
    select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour_start, event_type, count(*) as n_events, cast(sum(cast(value as decimal(18,4))) as double) as total_value from events group by 1, 2""")
def q50(spark, d):
    from tessera.streaming.ingest import hourly_rollup

    out = hourly_rollup(t(spark, d, "events"))
    return out.select(F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "event_type", "n_events", F.col("total_value").cast("double").alias("total_value"))


@query("q56_insert_only_and_claims", """
    select event_type, count(*) as n_new from (select distinct user_id, event_type from events where event_id % 2 = 1 except select user_id, event_type from events where event_id % 2 = 0) group by 1""")
def q56(spark, d):
    e = t(spark, d, "events")
    new = relational.insert_only(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])
    return new.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_new"))


from tessera.plans import products  # noqa: E402, F401  registers its queries here
