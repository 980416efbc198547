"""Claims-shaped views over the order tables, as DataFrames and as the same SQL.

Persons are customers. A medical claim line is a line item with its part codes, a pharmacy claim is
an order whose priority stands for the drug.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = ["code_1", "code_2", "code_3"]
ORDER = ["event_date", "claim_id", "line", "part"]


def medical(t) -> DataFrame:
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("person"),
            F.col("l_orderkey").alias("claim_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part"),
            F.to_date("l_shipdate").alias("event_date"),
            F.year("l_shipdate").alias("event_year"),
            F.col("p_brand").alias("code_1"),
            F.col("p_type").alias("code_2"),
            F.col("l_returnflag").alias("code_3"),
            F.col("p_name").alias("drug_name"),
            F.col("p_size").alias("age"),
            F.col("l_linestatus").alias("line_status"),
            F.col("l_extendedprice").alias("price"),
            F.col("o_totalprice").alias("total"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
        )
    )


MEDICAL = """medical as (
  select o_custkey as person, l_orderkey as claim_id, l_linenumber as line, l_partkey as part,
    cast(l_shipdate as date) as event_date, cast(year(l_shipdate) as integer) as event_year,
    p_brand as code_1, p_type as code_2, l_returnflag as code_3, p_name as drug_name,
    p_size as age, l_linestatus as line_status, l_extendedprice as price,
    o_totalprice as total, o_orderstatus as status, o_orderpriority as priority
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""


def pharmacy(t) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("person"),
        F.col("o_orderkey").alias("claim_id"),
        F.to_date("o_orderdate").alias("event_date"),
        F.year("o_orderdate").alias("event_year"),
        F.col("o_orderpriority").alias("drug_name"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


PHARMACY = """pharmacy as (
  select o_custkey as person, o_orderkey as claim_id, cast(o_orderdate as date) as event_date,
    cast(year(o_orderdate) as integer) as event_year, o_orderpriority as drug_name,
    o_totalprice as total, o_orderstatus as status, o_orderpriority as priority
  from orders)"""


def claims_a(t) -> DataFrame:
    """Raw-looking medical claims: text dates, demographics with gaps."""
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("key"),
            F.translate(F.to_date("l_shipdate").cast("string"), "-", "").alias("day"),
            F.when(F.col("l_returnflag") == "R", " ").otherwise(
                (F.col("p_size") * 3).cast("string")).alias("age"),
            F.when(F.col("l_linestatus") == "F", F.col("p_type")).alias("gender"),
            F.when(F.col("l_returnflag") == "A", F.col("p_brand")).alias("race"),
            F.nullif(F.col("p_type"), F.lit("PROMO")).alias("zip"),
            F.col("l_linestatus").alias("county"),
            F.when(F.col("p_size") > 25, F.col("l_returnflag")).alias("payer"),
            F.col("l_orderkey").alias("claim_id"),
        )
    )


def claims_b(t) -> DataFrame:
    """Raw-looking pharmacy claims: one per order."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("key"),
        F.translate(F.to_date("o_orderdate").cast("string"), "-", "").alias("day"),
        F.when(F.col("o_orderstatus") == "F", "NULL").otherwise(
            (F.col("c_nationkey") * 5).cast("string")).alias("age"),
        F.when(F.col("o_orderstatus") == "O", F.col("c_mktsegment")).alias("gender"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("race"),
        F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment")).alias("zip"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("county"),
        F.col("o_orderpriority").alias("payer"),
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_orderpriority").alias("drug_name"),
    )


CLAIMS = """claims_a as (
  select o_custkey as key, strftime(l_shipdate, '%Y%m%d') as day,
    case when l_returnflag = 'R' then ' ' else cast(p_size * 3 as varchar) end as age,
    case when l_linestatus = 'F' then p_type end as gender,
    case when l_returnflag = 'A' then p_brand end as race,
    nullif(p_type, 'PROMO') as zip, l_linestatus as county,
    case when p_size > 25 then l_returnflag end as payer, l_orderkey as claim_id
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
claims_b as (
  select o_custkey as key, strftime(o_orderdate, '%Y%m%d') as day,
    case when o_orderstatus = 'F' then 'NULL' else cast(c_nationkey * 5 as varchar) end as age,
    case when o_orderstatus = 'O' then c_mktsegment end as gender,
    case when o_orderpriority = '1-URGENT' then o_orderstatus end as race,
    case when c_nationkey > 12 then c_mktsegment end as zip,
    nullif(o_orderstatus, 'P') as county, o_orderpriority as payer, o_orderkey as claim_id,
    o_orderpriority as drug_name
  from orders join customer on o_custkey = c_custkey)"""

DEMOGRAPHIC_COLUMNS = {
    d: d for d in ("age", "gender", "race", "zip", "county", "payer")
}

_NORMAL = """
  select cast(key as varchar) as person, cast(substr(day, 1, 4) as integer) as event_year,
    case when trim(age) = '' or upper(trim(age)) = 'NULL' then null
         else try_cast(trim(age) as integer) end as age,
    nullif(trim(gender), '') as gender, nullif(trim(race), '') as race,
    nullif(trim(zip), '') as zip, nullif(trim(county), '') as county,
    nullif(trim(payer), '') as payer, day as date_text, claim_id{extra}
  from {table} where key is not null and day is not null
    and regexp_matches(day, '^[0-9]{{8}}$') and try_strptime(day, '%Y%m%d') is not null
    and cast(substr(day, 1, 4) as integer) between 1996 and 2000"""
NORMAL = (
    CLAIMS
    + ",\nnorm_a as (" + _NORMAL.format(table="claims_a", extra="") + ")"
    + ",\nnorm_b as (" + _NORMAL.format(table="claims_b", extra=", drug_name") + ")"
)


def event_log(t) -> DataFrame:
    """Interaction events as an event log: one case per user."""
    return t.events.select(
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").alias("ts"),
        F.col("event_id").alias("event_id"),
        F.col("value").alias("value"),
    )


LOG = """log as (select user_id as case_id, event_type as activity, ts, event_id, value
  from events)"""


def prefixed_log(t) -> DataFrame:
    """The same log with typed activities, as claims event logs carry them."""
    kind = (
        F.when(F.col("activity").isin("view", "click"), "DRUG:")
        .when(F.col("activity").isin("purchase", "signup"), "ICD:")
        .otherwise("CPT:")
    )
    return event_log(t).withColumn("activity", F.concat(kind, F.col("activity")))


PREFIXED_LOG = """log as (select user_id as case_id,
  (case when event_type in ('view', 'click') then 'DRUG:'
        when event_type in ('purchase', 'signup') then 'ICD:' else 'CPT:' end) || event_type
    as activity, ts, event_id, value from events)"""
