"""Imputation, mapping, event-fact and cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from careloom.operators import cohort as K
from careloom.operators import impute as I
from careloom.operators import mapping as M
from careloom.plans import standin as S
from careloom.plans.registry import query

_DEMO = ["age", "gender", "race", "zip", "county", "payer"]


def normal_a(t):
    return I.normalize_claims(
        S.claims_a(t), "key", "day", S.DEMOGRAPHIC_COLUMNS, ["claim_id"], 1996, 2000
    )


def normal_b(t):
    return I.normalize_claims(
        S.claims_b(t), "key", "day", S.DEMOGRAPHIC_COLUMNS,
        {"claim_id": ["claim_id"], "drug_name": ["Drug Name", "drug_name"]}, 1996, 2000,
    )


@query(f"""with {S.NORMAL} select event_year, age, gender, race, zip, county, payer, count(*) as n,
  count(distinct person) as persons from norm_a group by all""")
def normalized_claims(t):
    return normal_a(t).groupBy("event_year", *_DEMO).agg(
        F.count("*").alias("n"), F.countDistinct("person").alias("persons")
    )


_PROFILES = S.NORMAL + "".join(
    f""",
prof_{x} as (select person, event_year, min(age) as age, min(gender) as gender, min(race) as race,
  min(zip) as zip, min(county) as county, min(payer) as payer, count(*) as claim_count
  from norm_{x} group by 1, 2)""" for x in "ab"
)


@query(f"with {_PROFILES} select * from prof_b")
def person_year_profile(t):
    return I.period_profile(normal_b(t), "person", "event_year", _DEMO)


@query(f"""with {S.NORMAL} select distinct person, event_year,
  cast(case when age is null or age > 114 then 1 else 0 end as integer) as missing_age,
  cast(gender is null as integer) as missing_gender, cast(race is null as integer) as missing_race,
  cast(zip is null as integer) as missing_zip, cast(county is null as integer) as missing_county,
  cast(payer is null as integer) as missing_payer from norm_b""")
def missing_flags(t):
    return I.missing_flags(normal_b(t), "person", "event_year", _DEMO)


def _filled(own: str, other: str, source: str) -> str:
    fields = "".join(
        f""", coalesce(o.{d}, dc.{d}) as {d}_imputed,
    case when o.{d} is null and dc.{d} is not null then 'imputed_from_{source}' else 'original' end
      as {d}_source""" for d in _DEMO[1:]
    )
    return f""",
ages_{own} as (select o.person, o.event_year, x.age, row_number() over (
    partition by o.person, o.event_year order by abs(o.event_year - x.event_year),
    x.claim_count desc, x.event_year) as r
  from prof_{own} o join prof_{other} x on o.person = x.person
    and abs(o.event_year - x.event_year) <= 2
  where (o.age is null or o.age > 114) and x.age is not null and x.age <= 114),
rest_{own} as (select o.person, o.event_year, x.gender, x.race, x.zip, x.county, x.payer,
    row_number() over (partition by o.person, o.event_year
      order by abs(o.event_year - x.event_year), x.claim_count desc, x.event_year) as r
  from prof_{own} o join prof_{other} x on o.person = x.person
    and abs(o.event_year - x.event_year) <= 2
  where (o.gender is null or o.race is null or o.zip is null or o.county is null or o.payer is null)
    and (x.gender is not null or x.race is not null or x.zip is not null or x.county is not null
      or x.payer is not null)),
fill_{own} as (select o.person, o.event_year,
    case when o.age > 114 then ac.age else coalesce(o.age, ac.age) end as age_imputed,
    case when (o.age is null or o.age > 114) and ac.age is not null
      then 'imputed_from_{source}' else 'original' end as age_source{fields}
  from prof_{own} o
  left join ages_{own} ac on o.person = ac.person and o.event_year = ac.event_year and ac.r = 1
  left join rest_{own} dc on o.person = dc.person and o.event_year = dc.event_year and dc.r = 1)"""


_FILLED = _PROFILES + _filled("a", "b", "pharmacy") + _filled("b", "a", "medical")
_OUT = ["person", "event_year", *[f"{d}_{s}" for d in _DEMO for s in ("imputed", "source")]]


@query(f"""with {_FILLED} select claim_id, date_text, {', '.join('f.' + c for c in _OUT)}
  from norm_a n join fill_a f on n.person = f.person and n.event_year = f.event_year""")
def imputed_medical(t):
    a, _ = I.impute_demographics(normal_a(t), normal_b(t), "medical", "pharmacy", years=2)
    return a.select("claim_id", "date_text", *_OUT)


@query(f"""with {_FILLED} select claim_id, date_text, {', '.join('f.' + c for c in _OUT)}
  from norm_b n join fill_b f on n.person = f.person and n.event_year = f.event_year""")
def imputed_pharmacy(t):
    _, b = I.impute_demographics(normal_a(t), normal_b(t), "medical", "pharmacy", years=2)
    return b.select("claim_id", "date_text", *_OUT)


_ANY_MISSING = """(age is null or age > 114 or gender is null or race is null or zip is null
  or county is null or payer is null)"""
_LOOKUP = f"""with {_FILLED}, lookup as (
  select fill_a.* from fill_a semi join (select person, event_year from norm_a where {_ANY_MISSING}) m
    on fill_a.person = m.person and fill_a.event_year = m.event_year
  union select fill_b.* from fill_b semi join (select person, event_year from norm_b where {_ANY_MISSING}) m
    on fill_b.person = m.person and fill_b.event_year = m.event_year)"""


def _lookup(t):
    return I.demographics_lookup(normal_a(t), normal_b(t), "medical", "pharmacy", years=2)


@query(f"{_LOOKUP} select {', '.join(_OUT)} from lookup")
def demographics_lookup(t):
    return _lookup(t).select(*_OUT)


@query(f"""with {_PROFILES}, pick as (select o.person, o.event_year, x.payer, x.zip, row_number()
    over (partition by o.person, o.event_year order by abs(o.event_year - x.event_year),
    x.claim_count desc, x.event_year) as r from prof_a o join prof_b x
    on o.person = x.person and abs(o.event_year - x.event_year) <= 1)
select o.person, o.event_year, p.payer as nearest_payer, p.zip as nearest_zip
from prof_a o left join pick p on o.person = p.person and o.event_year = p.event_year and p.r = 1""")
def nearest_year_profile(t):
    left, right = (
        I.period_profile(x, "person", "event_year", _DEMO) for x in (normal_a(t), normal_b(t))
    )
    near = I.nearest_period_join(
        left, right, "person", "event_year", 1, "claim_count", ["payer", "zip"]
    )
    return near.select("person", "event_year", "nearest_payer", "nearest_zip")


@query(f"""{_LOOKUP}, one as (select person, event_year, min(age_imputed) as age_imputed,
    min(gender_imputed) as gender_imputed from lookup group by 1, 2)
select claim_id, n.person, coalesce(age, age_imputed) as age, coalesce(gender, gender_imputed) as gender
from norm_b n left join one on n.person = one.person and n.event_year = one.event_year""")
def backfilled_claims(t):
    one = _lookup(t).groupBy("person", "event_year").agg(
        F.min("age_imputed").alias("age_imputed"), F.min("gender_imputed").alias("gender_imputed")
    )
    filled = I.backfill(
        normal_b(t), one, ["person", "event_year"],
        {"age": "age_imputed", "gender": "gender_imputed"},
    )
    return filled.select("claim_id", "person", "age", "gender")


@query(f"""with {S.NORMAL}, x as (select (select count(*) from claims_a) as rb,
  (select count(*) from norm_a) as ra, (select count(distinct key) from claims_a) as pb,
  (select count(distinct person) from norm_a) as pa)
select 'normalize' as stage, rb as rows_before, ra as rows_after, rb - ra as rows_lost,
  round((rb - ra) * 100.0 / rb, 6) as rows_lost_pct, pb - pa as persons_lost,
  round((pb - pa) * 100.0 / pb, 6) as persons_lost_pct from x""")
def data_loss(t):
    before = S.claims_a(t).withColumnRenamed("key", "person")
    return I.data_loss(before, normal_a(t), "person", "normalize")


_BAND = "case " + " ".join(
    f"when age_imputed between {lo} and {hi} then '{lo}-{hi}'"
    for lo, hi in [(0, 12), (13, 24), (25, 44), (45, 54), (55, 64), (65, 74), (75, 84), (85, 94),
                   (95, 114)]
) + " else 'Other' end"


@query(f"""with {_FILLED}, m as (select age_imputed, f.event_year,
  cast(age_imputed is null as integer) + cast(gender_imputed is null as integer)
  + cast(race_imputed is null as integer) + cast(zip_imputed is null as integer)
  + cast(county_imputed is null as integer) + cast(payer_imputed is null as integer) as missing,
  age_imputed is not null and gender_imputed is not null and race_imputed is not null
    and payer_imputed is not null as full_row
  from norm_a n join fill_a f on n.person = f.person and n.event_year = f.event_year)
select {_BAND} as age_band, event_year, missing as total_missing_fields,
  case when full_row then 'complete' else 'partial' end as data_quality_level, count(*) as n
from m group by all""")
def clean_medical_quality(t):
    a, _ = I.impute_demographics(normal_a(t), normal_b(t), "medical", "pharmacy", years=2)
    clean = I.clean_medical(a, first=1996, last=2000)
    return clean.groupBy(
        "age_band", "event_year", "total_missing_fields", "data_quality_level"
    ).agg(F.count("*").alias("n"))


_MAP = """map as (select lower(p_name) as key, lower(min(p_name) over (partition by
  split_part(p_name, ' ', 2))) as value from (select distinct p_name from part))"""


def _drug_map(t):
    names = t.part.select("p_name").distinct()
    noun = F.split("p_name", " ")[1]
    heads = names.groupBy(noun.alias("noun")).agg(F.lower(F.min("p_name")).alias("value"))
    return names.select(F.lower("p_name").alias("key"), noun.alias("noun")).join(
        heads, "noun"
    ).select("key", "value")


@query(f"""with {S.MEDICAL}, {_MAP}, raw as (select claim_id, line, part,
    case when code_3 = 'R' then ' ' when code_3 = 'A' then ' ' || upper(drug_name) || ' '
      else 'new ' || drug_name end as drug from medical)
select claim_id, line, part, nullif(trim(coalesce(value, lower(trim(drug)))), '') as drug_name
from raw left join map on lower(trim(drug)) = key""")
def mapped_drugs(t):
    return M.apply_drug_map(_raw_drugs(t), _drug_map(t))


def _raw_drugs(t):
    raw = (
        F.when(F.col("code_3") == "R", " ")
        .when(F.col("code_3") == "A", F.concat(F.lit(" "), F.upper("drug_name"), F.lit(" ")))
        .otherwise(F.concat(F.lit("new "), F.col("drug_name")))
    )
    return S.medical(t).select("claim_id", "line", "part", raw.alias("drug_name"))


@query(f"""with {S.MEDICAL}, {_MAP}, raw as (select claim_id, line, part,
    case when code_3 = 'R' then ' ' when code_3 = 'A' then ' ' || upper(drug_name) || ' '
      else 'new ' || drug_name end as drug_name from medical)
select raw.*, coalesce(value, lower(drug_name)) as standardized_drug_name
from raw left join map on lower(drug_name) = key""")
def standardized_drugs(t):
    return M.standardize_drug(_raw_drugs(t), _drug_map(t))


@query(f"""with {_FILLED}, {_MAP} select {_BAND} as age_band, f.event_year, drug_name,
  coalesce(value, lower(drug_name)) as standardized_drug_name, count(*) as n
from norm_b n join fill_b f on n.person = f.person and n.event_year = f.event_year
left join map on lower(drug_name) = key group by all""")
def clean_pharmacy_drugs(t):
    _, b = I.impute_demographics(normal_a(t), normal_b(t), "medical", "pharmacy", years=2)
    clean = I.clean_pharmacy(b, _drug_map(t), first=1996, last=2000)
    return clean.groupBy("age_band", "event_year", "drug_name", "standardized_drug_name").agg(
        F.count("*").alias("n")
    )


_CODED = """coded as (select l_orderkey as claim_id, l_linenumber as line, l_partkey as part,
    case when l_returnflag = 'R' then '' else 'f' || (10 + p_size) || '.' || l_linenumber end as dx1,
    case when p_type = 'LARGE' then cast(p_size as varchar) else upper(p_brand) end as dx2,
    ' ' || lower(substr(p_type, 1, 2)) || '.' || l_linenumber as px
  from lineitem join part on l_partkey = p_partkey)"""
_ICD = "'([A-Z][0-9]{2}(\\.?[A-Z0-9]{1,4})?)'"
_NORM = "case when trim({c}) = '' then null else replace(regexp_extract(upper(trim({c})), " + _ICD + ", 1), '.', '') end"


def _coded(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("claim_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(
            F.concat(F.lit("f"), F.col("p_size") + 10, F.lit("."), "l_linenumber")).alias("dx1"),
        F.when(F.col("p_type") == "LARGE", F.col("p_size").cast("string")).otherwise(
            F.upper("p_brand")).alias("dx2"),
        F.concat(F.lit(" "), F.lower(F.substring("p_type", 1, 2)), F.lit("."), "l_linenumber")
        .alias("px"),
    )


@query(f"""with {_CODED},
icd as (select distinct 'F' || (10 + p_size) || '1' as key, 'Z' || p_size as value from part
  where p_size between 5 and 20),
tgt as (select distinct 'BRAND' || substr(p_brand, 7) as key, 'T' || p_brand as value from part
  where p_brand in ('Brand#3', 'Brand#4')),
cpt as (select distinct upper(substr(p_type, 1, 2)) || '1' as key, p_type as value from part),
n as (select *, {_NORM.replace("{c}", "dx1")} as n1, {_NORM.replace("{c}", "dx2")} as n2,
  replace(replace(upper(px), '.', ''), ' ', '') as np,
  regexp_replace(upper(dx1), '[^A-Z0-9]', '', 'g') as f1,
  regexp_replace(upper(dx2), '[^A-Z0-9]', '', 'g') as f2 from coded)
select claim_id, line, part, nullif(trim(coalesce(t1.value, i1.value, n1, dx1)), '') as dx1,
  nullif(trim(coalesce(t2.value, i2.value, n2, dx2)), '') as dx2,
  nullif(trim(coalesce(c.value, np)), '') as px
from n left join tgt t1 on f1 = t1.key left join icd i1 on n1 = i1.key
  left join tgt t2 on f2 = t2.key left join icd i2 on n2 = i2.key left join cpt c on np = c.key""")
def mapped_codes(t):
    part = t.part
    icd = part.filter(F.col("p_size").between(5, 20)).select(
        F.concat(F.lit("F"), F.col("p_size") + 10, F.lit("1")).alias("key"),
        F.concat(F.lit("Z"), "p_size").alias("value"),
    ).distinct()
    target = part.filter(F.col("p_brand").isin("Brand#3", "Brand#4")).select(
        F.concat(F.lit("BRAND"), F.substring("p_brand", 7, 9)).alias("key"),
        F.concat(F.lit("T"), "p_brand").alias("value"),
    ).distinct()
    cpt = part.select(
        F.concat(F.upper(F.substring("p_type", 1, 2)), F.lit("1")).alias("key"),
        F.col("p_type").alias("value"),
    ).distinct()
    return M.apply_code_maps(_coded(t), ["dx1", "dx2"], icd, target, ["px"], cpt)


@query(f"""with {_CODED} select count(*) > 0 as needs_update from coded
  where dx1 is distinct from {_NORM.replace("{c}", "dx1")}""")
def needs_update(t):
    from careloom.functions.columns import normalize_icd

    return M.needs_update(_coded(t), "dx1", normalize_icd("dx1"))


@query("""
with main as (select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P'),
part as (select o_orderkey, 'new' as o_orderstatus from orders where o_orderpriority = '1-URGENT')
select * from main union all
select * from part where not exists (select 1 from main where main.o_orderkey = part.o_orderkey)""")
def appended_claims(t):
    main = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus")
    part = t.orders.filter("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", F.lit("new").alias("o_orderstatus")
    )
    return I.append_new(main, part, "o_orderkey")


@query("""
select o_orderstatus, count(*) as n from orders where o_orderpriority = '1-URGENT' and exists
  (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45) group by 1""")
def already_loaded_claims(t):
    part = t.orders.filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "id")
    main = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return I.already_loaded(main, part, "id").groupBy("o_orderstatus").agg(
        F.count("*").alias("n")
    )


# --- event fact and cohorts ---------------------------------------------------------------

_ORDER = [*S.ORDER]


def facts(t, sequence: bool = False):
    return K.event_fact(
        S.medical(t), S.pharmacy(t), "code_1", "drug_name", order=_ORDER, sequence=sequence
    )


_FACT = f"""{S.MEDICAL}, {S.PHARMACY}, fact as (
  select person, event_date, event_year, 'medical' as event_type, claim_id, line, part, code_1,
    code_2, code_3, drug_name, total, status, priority from medical
    where code_1 is not null and code_1 <> ''
  union all select person, event_date, event_year, 'pharmacy', claim_id, null, null, null, null,
    null, drug_name, total, status, priority from pharmacy
    where drug_name is not null and drug_name <> '')"""


@query(f"""with {_FACT} select person, event_type, claim_id, line, part, event_date,
  row_number() over (partition by event_type, person order by event_date, claim_id, line, part)
    as event_sequence from fact""")
def event_fact(t):
    return facts(t, sequence=True).select(
        "person", "event_type", "claim_id", "line", "part", "event_date", "event_sequence"
    )


@query(f"""with {_FACT} select event_type, case when code_1 in ('Brand#3', 'Brand#9')
    or coalesce(code_1 like 'BRAND#1%', false) or coalesce(upper(code_1) like 'BRAND#1%', false)
    or code_2 in ('PROMO') or coalesce(code_3 like 'A%', false) then 'target'
  when priority in ('1-URGENT') then 'ed_non_opioid' else 'non_target' end as event_classification,
  count(*) as n from fact group by all""")
def classified_events(t):
    labelled = K.classify_event(
        facts(t), slots=S.SLOTS, codes=["Brand#3", "Brand#9"], prefixes=["brand#1"],
        cpt_slots=["code_2"], cpt_codes=["PROMO"], line="priority", ed_lines=["1-URGENT"],
    )
    labelled = K.classify_event(
        labelled, slots=["code_3"], prefixes=["a"], line=None, out="__second"
    )
    merged = F.when(F.col("__second") == "target", "target").otherwise(
        F.col("event_classification")
    )
    return labelled.groupBy("event_type", merged.alias("event_classification")).agg(
        F.count("*").alias("n")
    )


@query(f"""with {S.PHARMACY} select person, claim_id, drug_name, event_date,
  cast(null as integer) as days_to_target_event from pharmacy where trim(drug_name) <> ''""")
def drug_exposure(t):
    return K.drug_exposure(
        S.pharmacy(t), "drug_name", ["person", "claim_id", "drug_name", "event_date"]
    )


_TARGET = "total > 495000"
_EXCLUDED = "priority = '1-URGENT' and status = 'P' and total > 400000"

_COHORT = f"""{_FACT}, people as (select person, bool_or({_TARGET}) as is_case,
    min(case when {_TARGET} then event_date end) as first_target_date from fact group by 1),
ranked as (select *, row_number() over (partition by is_case
    order by md5(concat('42', ':', person)), person) as r,
  count(*) filter (is_case) over () as cases from people),
members as (select * from ranked where is_case or r <= 5 * cases),
cohort as (select fact.*, is_case, first_target_date, cast(is_case as integer) as is_target_case
  from fact join members using (person))"""


def _cohort(t):
    return K.case_control_cohort(facts(t), F.expr(_TARGET))


@query(f"""with {_COHORT} select person, event_type, claim_id, line, part, event_date,
  first_target_date, 1 as target, is_target_case, 'opioid_ed' as cohort_name,
  case when is_case then 'OPIOID_ED' else 'NON_ED' end as cohort from cohort""")
def case_control_cohort(t):
    return _cohort(t).select(
        "person", "event_type", "claim_id", "line", "part", "event_date", "first_target_date",
        "target", "is_target_case", "cohort_name", "cohort",
    )


@query(f"""with {_COHORT}, p as (select person, max(is_target_case) as c, count(*) as n,
    sum(date_diff('day', event_date, first_target_date)) as d,
    count(first_target_date) as nd,
    count(*) filter (date_diff('day', event_date, first_target_date) between 0 and 30) as w
  from cohort group by 1)
select count(*) filter (c = 1) as cases, count(*) filter (c = 0) as controls,
  round(count(*) filter (c = 0) / count(*) filter (c = 1), 6) as control_case_ratio,
  cast(sum(n) as bigint) as events, cast(sum(w) as bigint) as events_in_window,
  round(sum(d) / sum(nd), 6) as avg_days_to_target from p""")
def case_control_ratio(t):
    cohort = _cohort(t).withColumn(
        "days_to_target_event", F.datediff("first_target_date", "event_date")
    )
    return K.cohort_ratio(cohort)


_WINDOWED = f"""{_FACT}, people as (select person, bool_or({_EXCLUDED}) as out,
    bool_or({_TARGET}) as is_case, min(case when {_TARGET} then event_date end) as first_target_date,
    min(case when event_type = 'medical' and not ({_TARGET}) then event_date end) as m1,
    min(case when event_type = 'medical' then event_date end) as m2, min(event_date) as m3
  from fact group by 1),
ranked as (select *, case when is_case then first_target_date else coalesce(m1, m2, m3) end as ref,
    row_number() over (partition by is_case order by md5(concat('42', ':', person)), person) as r,
    count(*) filter (is_case) over () as cases from people where not out),
members as (select * from ranked where is_case or r <= 5 * cases),
cohort as (select fact.*, first_target_date, cast(is_case as integer) as is_target_case,
    cast(date_diff('day', event_date, ref) as integer) as days_to_target_event
  from fact join members using (person)
  where event_type = 'medical' or date_diff('day', event_date, ref) between 0 and 30)"""


def _windowed(t):
    return K.windowed_cohort(facts(t), F.expr(_TARGET), F.expr(_EXCLUDED))


@query(f"""with {_WINDOWED} select person, event_type, claim_id, line, part, is_target_case,
  first_target_date, days_to_target_event from cohort""")
def windowed_cohort(t):
    return _windowed(t).select(
        "person", "event_type", "claim_id", "line", "part", "is_target_case",
        "first_target_date", "days_to_target_event",
    )


@query(f"""with {_FACT}, people as (select person, bool_or({_TARGET}) as c from fact group by 1
    having not bool_or({_TARGET})),
members as (select person from people order by md5(concat('7', ':', person)), person limit 300)
select person, event_type, count(*) as n, 0 as target, 0 as is_target_case
from fact join members using (person) group by 1, 2""")
def control_only_cohort(t):
    cohort = K.control_only_cohort(
        facts(t), F.expr(_TARGET), ratio=5, average_targets=60, seed=7
    )
    return cohort.groupBy("person", "event_type", "target", "is_target_case").agg(
        F.count("*").alias("n")
    )


@query(f"""with {_WINDOWED}, flagged as (select distinct person from fact where {_EXCLUDED})
select count(distinct person) as overlapping_persons, count(distinct person) = 0 as passed
from cohort where person in (select person from flagged)""")
def cohort_exclusivity(t):
    return K.cohort_exclusivity(_windowed(t), facts(t), F.expr(_EXCLUDED))


@query(f"""with {_COHORT}, p as (select event_year, person, max(is_target_case) as c from cohort
    group by all),
s as (select event_year, count(*) filter (c = 1) as cases, count(*) filter (c = 0) as controls
  from p group by 1)
select event_year, cases, controls, round(controls / nullif(cases, 0), 6) as ratio from s
where cases = 0 or controls / nullif(cases, 0) > 5""")
def cohort_rebuild_list(t):
    return K.cohort_checks(_cohort(t), ["event_year"])


@query(f"""with {_FACT}, flagged as (select distinct person from fact where {_EXCLUDED}),
cases as (select distinct person from fact where {_TARGET}),
ctl as (select distinct person from fact where code_1 = 'Brand#5'),
lab as (select person, max(l) as is_target_case from (select person, 1 as l from cases
  union all select person, 0 from ctl) group by 1)
select is_target_case, event_type, count(*) as n, count(distinct person) as persons
from fact join lab using (person) where person not in (select person from flagged) group by 1, 2""")
def labelled_members(t):
    fact = facts(t)
    flagged = fact.filter(_EXCLUDED)
    cases = fact.filter(_TARGET).select("person").distinct()
    controls = fact.filter("code_1 = 'Brand#5'").select("person").distinct()
    rows = K.label_members(K.exclude_keys(fact, flagged, "person"), cases, controls, "person")
    return rows.groupBy("is_target_case", "event_type").agg(
        F.count("*").alias("n"), F.countDistinct("person").alias("persons")
    )


@query(f"""with {_COHORT}, kept as (select * from cohort where code_1 in
    (select distinct p_brand from part where p_size > 48)
  or drug_name in (select distinct p_brand from part where p_size > 48)),
kp as (select person, max(is_target_case) = 1 as c from kept group by 1),
kr as (select *, row_number() over (partition by c order by md5(concat('42', ':', person)), person) as r,
  count(*) filter (c) over () as n from kp)
select k.person, k.event_type, k.claim_id, k.line, k.part, k.is_target_case from kept k
join kr on k.person = kr.person where kr.c or kr.r <= 3 * kr.n""")
def model_events(t):
    items = t.part.filter("p_size > 48").select(F.col("p_brand").alias("item")).distinct()
    out = ["person", "event_type", "claim_id", "line", "part", "is_target_case"]
    kept = K.model_events(_cohort(t).select(*out, "code_1", "drug_name"), items, ["code_1", "drug_name"], ratio=3)
    return kept.select(*out)
