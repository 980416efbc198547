"""Data-quality queries on the claims views and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from careloom.constants import AGE_BAND_LABELS
from careloom.functions.columns import age_band
from careloom.operators import impute as I
from careloom.operators import quality as Z
from careloom.plans import claims_queries as C
from careloom.plans import standin as S
from careloom.plans.registry import query

_BANDS = ", ".join(f"'{b}'" for b in AGE_BAND_LABELS)
_B = C._BAND.replace("age_imputed", "{c}")


def _silver(t):
    a = C.normal_a(t)
    return a.withColumn("age_band", age_band("age"))


_SILVER = f"{S.NORMAL}, silver as (select *, {_B.format(c='age')} as age_band from norm_a)"


_EXPECTED = ["l_orderkey", "drug_name", "l_quantity", "l_shipdate"]
_EXTRA = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax",
          "l_returnflag", "l_linestatus"]


@query("select * from (" + " union all ".join(
    f"""select '{c}' as "column", '{'missing' if c == 'drug_name' else 'ok' if c in _EXPECTED else 'extra'}'
    as status, count({'null' if c == 'drug_name' else c}) as filled, count(*) as rows from lineitem"""
    for c in _EXPECTED + _EXTRA) + ")")
def schema_check(t):
    return Z.schema_check(t.lineitem, _EXPECTED)


@query(f"""with {_SILVER} select count(*) as rows, count(distinct person) as persons,
  count(distinct age_band) as bands, count(distinct event_year) as years, min(date_text) as min_date,
  max(date_text) as max_date from silver""")
def structure_stats(t):
    return Z.structure_stats(_silver(t), "person", "age_band", "event_year", "date_text")


_FIELDS = ["age", "gender", "race", "zip", "county", "payer"]


@query(f"with {_SILVER} " + " union all ".join(
    f"""select event_year, '{c}' as "column", count(*) filter ({c} is null or trim(cast({c} as varchar)) = '') as n
    from silver group by 1""" for c in _FIELDS))
def null_check(t):
    return Z.null_check(_silver(t), _FIELDS, ["event_year"])


@query("""
with d as (select case when o_orderstatus = 'F' then null when o_orderpriority = '5-LOW'
    then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y%m%d') end as day,
    cast(case when o_totalprice > 400000 then year(o_orderdate) + 1 else year(o_orderdate) end as integer) as y
  from orders),
p as (select day, y, case when regexp_matches(day, '^[0-9]{8}$') then year(try_strptime(day, '%Y%m%d')) end as py from d)
select 'null_dates' as "check", count(*) filter (day is null) as n from p
union all select 'year_out_of_range', count(*) filter (y < 1996 or y > 2000) from p
union all select 'year_mismatch', count(*) filter (py <> y) from p""")
def date_check(t):
    day = (
        F.when(F.col("o_orderstatus") == "F", None)
        .when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    )
    year = F.year("o_orderdate") + (F.col("o_totalprice") > 400000).cast("int")
    return Z.date_check(t.orders.select(day.alias("day"), year.alias("y")), "day", "y", 1996, 2000)


@query(f"""with {_SILVER} select age_band as value, count(*) as n from silver
  where age_band not in ({_BANDS}) group by 1""")
def invalid_bands(t):
    return Z.domain_check(_silver(t), "age_band")


@query(f"""with {S.MEDICAL}, f as (select drug_name as value, count(*) as frequency from medical group by 1),
  r as (select *, row_number() over (order by frequency desc, value) as k, count(*) over () as n from f)
select * from (select 'high' as slice, value, frequency from f order by frequency desc, value limit 10)
union all select * from (select 'low', value, frequency from f order by frequency, value limit 10)
union all select 'middle', value, frequency from r where abs(k - floor(n / 2)) <= 5""")
def frequency_inspection(t):
    return Z.frequency_inspection(S.medical(t), "drug_name", 10)


_STAGE = f"""{_SILVER}, checks as (select 'schema' as "check", false as passed
  union all select 'missing_data', count(*) = 0 from silver where person is null or trim(person) = ''
    or county is null or trim(county) = ''
  union all select 'date_quality', count(*) = 0 from silver where date_text is null or event_year < 1996
    or event_year > 2000 or year(strptime(date_text, '%Y%m%d')) <> event_year
  union all select 'age_bands', count(*) = 0 from silver where age_band not in ({_BANDS}))"""


def _stage(t):
    return Z.stage_checks(
        _silver(t), ["person", "drug_name"], ["person", "county"], "date_text", "event_year",
        "age_band", lo=1996, hi=2000,
    )


@query(f"with {_STAGE} select * from checks")
def stage_checks(t):
    return _stage(t)


@query(f"""with {_STAGE} select case when bool_and(passed) then 'PASS' else 'FAIL' end as overall_status,
  count(*) as total_validations, count(*) filter (passed) as passing_validations,
  string_agg("check", '; ' order by "check") filter (not passed) as critical_issues from checks""")
def stage_summary(t):
    return Z.roll_up(_stage(t))


@query(f"""with {S.CLAIMS} """ + " union all ".join(
    f"""select '{c}' as field, count(*) as total_rows, count(*) filter ({c} = ' ') as blank_strings,
    count(*) filter ({c} = '') as empty_strings, count(*) filter (try_cast({c} as integer) is null) as non_castable
    from claims_a""" for c in ("age", "gender")))
def blank_check(t):
    return Z.blank_check(S.claims_a(t), {"age": "int", "gender": "int"})


@query(f"""with {C._FILLED}, m as (select f.event_year, n.age, n.gender, f.payer_imputed,
    case when age_imputed is not null and gender_imputed is not null and race_imputed is not null
      and payer_imputed is not null then 1 else 0 end as whole
  from norm_a n join fill_a f on n.person = f.person and n.event_year = f.event_year)
select event_year, count(*) as rows, round(count(age) * 100.0 / count(*), 6) as age,
  round(count(gender) * 100.0 / count(*), 6) as gender,
  round(count(payer_imputed) * 100.0 / count(*), 6) as payer_imputed,
  round(sum(whole) * 100.0 / count(*), 6) as complete_pct from m group by 1""")
def completeness(t):
    a, _ = I.impute_demographics(C.normal_a(t), C.normal_b(t), "medical", "pharmacy", years=2)
    clean = I.clean_medical(a, first=1996, last=2000)
    return Z.completeness(clean, ["age", "gender", "payer_imputed"], ["event_year"])


_QA = f"""{C._WINDOWED}, q as (select cohort.*, p_size as age, {_B.format(c='p_size')} as age_band,
    'ed_non_opioid' as cohort_name from cohort left join (select p_partkey, p_size from part) on part = p_partkey)"""


def _cohort(t):
    cohort = C._windowed(t).withColumn("age", F.col("age"))
    return cohort.withColumn("age_band", age_band("age"))


_RULES = {
    "invalid_cohort_name": "cohort_name not in ('opioid_ed', 'ed_non_opioid')",
    "invalid_label": "is_target_case not in (0, 1)",
    "outside_window": "event_type <> 'medical' and not coalesce(days_to_target_event between 0 and 30, true)",
    "year_mismatch": "year(event_date) <> event_year",
    "null_dates": "event_date is null",
    "case_without_first_date": "is_target_case = 1 and first_target_date is null",
    "control_with_first_date": "is_target_case = 0 and first_target_date is not null",
    "null_person": "person is null",
    "null_event_type": "event_type is null",
    "null_drug_name": "drug_name is null",
    "age_out_of_range": "not coalesce(age between 1 and 114, false)",
    "age_outside_band": f"{_B.format(c='age')} <> age_band",
}
_ZERO = " union all ".join(
    f"""select event_year, event_kind, '{n}' as "check", cast(count(*) filter ({r}) as double) as value,
    case when count(*) filter ({r}) = 0 then 'PASS' else 'FAIL' end as status from qq group by 1, 2"""
    for n, r in _RULES.items())
_INFO = " union all ".join(
    f"""select event_year, event_kind, '{n}' as "check", cast({e} as double) as value, 'INFO' as status from qq group by 1, 2"""
    for n, e in {
        "target_code_code_1": "count(*) filter (code_1 in ('Brand#3', 'Brand#4'))",
        "target_code_code_2": "count(*) filter (code_2 in ('Brand#3', 'Brand#4'))",
        "medical_events": "count(*) filter (event_type = 'medical')",
        "pharmacy_events": "count(*) filter (event_type <> 'medical')",
        "rows": "count(*)",
        "cases": "count(distinct case when is_target_case = 1 then person end)",
        "controls": "count(distinct case when is_target_case = 0 then person end)",
    }.items())
_CHECKS = f"""{_QA}, qq as (select *, status as event_kind from q),
  checks as ({_ZERO} union all {_INFO}
  union all select event_year, event_kind, 'mixed_labels', 0.0, 'PASS' from qq group by 1, 2
  union all select event_year, event_kind, 'missing_metadata_columns', 0.0, 'PASS' from qq group by 1, 2
  union all select event_year, event_kind, 'control_case_ratio', round(r, 6),
    case when r between 4.5 and 5.5 then 'PASS' when r is null then 'FAIL' else 'WARN' end
    from (select event_year, event_kind, count(distinct case when is_target_case = 0 then person end)
      / nullif(count(distinct case when is_target_case = 1 then person end), 0) as r from qq group by 1, 2))"""
_QA_BY = ["event_year", "event_kind"]


def _checks(t):
    rows = _cohort(t).withColumn("event_kind", F.col("status"))
    return Z.cohort_qa(
        rows, _QA_BY, slots=["code_1", "code_2"], target_codes=["Brand#3", "Brand#4"],
        critical=["event_type", "drug_name"],
    )


@query(f"with {_CHECKS} select * from checks")
def cohort_checks(t):
    return _checks(t)


@query(f"""with {_CHECKS} select event_year, event_kind,
  case when bool_or(status = 'FAIL') then 'FAIL' when bool_or(status = 'WARN') then 'WARN' else 'PASS' end as status,
  count(*) filter (status = 'FAIL') as failed_checks, count(*) filter (status = 'WARN') as warnings
from checks group by 1, 2""")
def cohort_status(t):
    return Z.partition_status(_checks(t), _QA_BY)


@query(f"""with {C._WINDOWED} select event_type, count(*) as rows,
  round(count(code_1) * 100.0 / count(*), 6) as code_1, round(count(drug_name) * 100.0 / count(*), 6) as drug_name,
  round(count(first_target_date) * 100.0 / count(*), 6) as first_target_date from cohort group by 1""")
def event_completeness(t):
    return Z.event_completeness(C._windowed(t), ["code_1", "drug_name", "first_target_date"])


@query("""select o_orderstatus, count(*) as total_rows, count(*) filter (year(l_shipdate) = year(o_orderdate)) as matched_rows,
  count(*) filter (year(l_shipdate) <> year(o_orderdate)) as mismatched_rows,
  round(count(*) filter (year(l_shipdate) = year(o_orderdate)) / count(*), 6) as consistency_rate
from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def year_consistency(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("y", F.year("o_orderdate"))
    return Z.year_consistency(rows, "l_shipdate", "y", ["o_orderstatus"])


@query(f"""with {S.MEDICAL}, grid as (select y as event_year, k as line_status from
    (select unnest([1994, 1995, 1999, 2001, 2002]) as y), (select unnest(['F', 'O', 'X']) as k)),
  c as (select event_year, line_status, count(*) as rows from medical group by 1, 2)
select grid.event_year, grid.line_status, coalesce(rows, 0) as rows, coalesce(rows, 0) > 0 as present
from grid left join c using (event_year, line_status)""")
def partition_presence(t):
    grid = {"event_year": [1994, 1995, 1999, 2001, 2002], "line_status": ["F", "O", "X"]}
    return Z.partition_presence(S.medical(t), grid)


@query(f"""with {C._WINDOWED}, p as (select person, max(is_target_case) as c from cohort group by 1)
select 'totals' as section, 'total_rows' as metric, count(*) as n from cohort
union all select 'totals', 'drug_events', count(*) filter (event_type = 'pharmacy') from cohort
union all select 'totals', 'distinct_drugs', count(distinct drug_name) from cohort
union all select 'totals', 'non_null_drugs', count(drug_name) from cohort
union all select 'totals', 'null_person_keys', 0 union all select 'totals', 'null_event_dates', 0
union all select 'totals', 'null_events', 0 union all select 'totals', 'null_targets', 0
union all select 'persons', 'distinct_persons', count(*) from p
union all select 'persons', 'target_persons', count(*) filter (c = 1) from p
union all select 'persons', 'control_persons', count(*) filter (c = 0) from p
union all select 'events', event_type, count(*) from cohort group by 2""")
def cohort_report(t):
    return Z.qa_report(C._windowed(t))


@query(f"""with {C._WINDOWED}, stages as (
    select 'medical' as stage, person, unnest([code_1, code_2]) as code from medical
    union all select 'fact', person, unnest([code_1, code_2]) from fact
    union all select 'cohort', person, unnest([code_1, code_2]) from cohort)
select stage, count(*) as code_rows, count(distinct person) as persons from stages
where regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') = 'BRAND3' group by 1""")
def traced_code(t):
    stages = {"medical": S.medical(t), "fact": C.facts(t), "cohort": C._windowed(t)}
    return Z.trace_code(stages, "brand 3", ["code_1", "code_2"])
