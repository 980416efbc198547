"""Frequency, trend, co-occurrence, ranking and chart-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from careloom.constants import AGE_EDGES, DRUG_COUNT_EDGES
from careloom.functions.columns import matches_variant
from careloom.operators import compare as X
from careloom.operators import frequency as Q
from careloom.operators import mapping as M
from careloom.operators import ordering as O
from careloom.operators import projection as P
from careloom.plans import standin as S
from careloom.plans.registry import query

_SLOTTED = """slotted as (
  select event_year, line_status, 1 as position, code_1 as code from medical
  union all select event_year, line_status, 2, code_2 from medical
  union all select event_year, line_status, 3, code_3 from medical)"""


@query(f"""
with {S.MEDICAL}, {_SLOTTED}
select 'period' as grain, event_year, cast(null as integer) as position,
  cast(null as varchar) as line_status, code, count(*) as frequency
from slotted where code <> '' group by event_year, code
union all
select 'period_position', event_year, position, null, code, count(*)
from slotted where code <> '' group by event_year, position, code
union all
select 'period_band', event_year, null, line_status, code, count(*)
from slotted where code <> '' group by event_year, line_status, code""")
def code_frequencies(t):
    return Q.code_frequency(S.medical(t), S.SLOTS, "event_year", "line_status")


_FREQ = f"""with {S.MEDICAL}, freq as (
  select event_year, drug_name, count(*) as frequency from medical
  where drug_name is not null and drug_name <> '' group by all)"""


def _freq(t):
    return Q.item_frequency(S.medical(t), "drug_name", "event_year")


@query(_FREQ + " select event_year, drug_name, frequency from freq")
def drug_frequency(t):
    return _freq(t)


@query(_FREQ + " select drug_name, cast(sum(frequency) as bigint) as frequency from freq group by 1")
def combined_counts(t):
    return Q.combine_counts(_freq(t), ["drug_name"])


@query(_FREQ + """ select drug_name, cast(sum(frequency) as bigint) as total_frequency,
  count(distinct event_year) as years_present from freq group by 1
  having sum(frequency) > 850 order by 2 desc, 1 limit 20""")
def high_frequency_drugs(t):
    return Q.frequent(_freq(t), "drug_name", "event_year", 850, 20, "above")


@query(_FREQ + """ select drug_name, cast(sum(frequency) as bigint) as total_frequency,
  count(distinct event_year) as years_present from freq group by 1
  having sum(frequency) < 1000 order by 2 desc, 1 limit 20""")
def low_frequency_drugs(t):
    return Q.frequent(_freq(t), "drug_name", "event_year", 1000, 20, "below")


@query(_FREQ + """ select count(distinct drug_name) as unique_items,
  count(distinct event_year) as periods_covered, count(*) as total_combinations,
  min(frequency) as min_frequency, max(frequency) as max_frequency,
  round(avg(frequency), 2) as avg_frequency,
  round(percentile_cont(0.5) within group (order by frequency), 2) as median_frequency
  from freq""")
def drug_frequency_summary(t):
    return Q.frequency_summary(_freq(t), "drug_name", "event_year")


@query(_FREQ + """, best as (select drug_name from freq group by 1
    order by sum(frequency) desc, 1 limit 10),
  lagged as (select event_year, drug_name, frequency,
    lag(frequency) over (partition by drug_name order by event_year) as prev_frequency
    from freq where drug_name in (select drug_name from best))
  select *, round((frequency - prev_frequency) * 100.0 / prev_frequency, 2) as pct_change
  from lagged""")
def drug_trends(t):
    return Q.yearly_trend(_freq(t), "drug_name", "event_year", 10)


@query(f"""
with {S.MEDICAL}, freq as (select drug_name, count(*) as frequency from medical group by 1),
ranked as (select drug_name, frequency,
  row_number() over (order by frequency desc, drug_name) as frequency_rank,
  count(*) over () as n from freq)
select drug_name, frequency, frequency_rank from ranked
where abs(frequency_rank - floor(n / 2)) <= 12""")
def mid_frequency_drugs(t):
    freq = S.medical(t).groupBy("drug_name").agg(F.count("*").alias("frequency"))
    return Q.mid_frequency(freq, "drug_name", 12)


@query(f"""
with {S.MEDICAL}
select event_year, line_status, count(distinct case when code_1 = 'Brand#3' then person end) as brand,
  count(distinct case when code_2 in ('PROMO', 'LARGE') then person end) as kind
from medical group by all""")
def target_persons(t):
    return Q.conditional_distinct(
        S.medical(t), "person",
        {"brand": F.col("code_1") == "Brand#3", "kind": F.col("code_2").isin("PROMO", "LARGE")},
        ["event_year", "line_status"],
    )


@query(f"""
with {S.MEDICAL}, counts as (
  select event_year, code_2, count(distinct case when code_1 = 'Brand#3' and status = 'P'
    and total > 480000 then person end) as n from medical group by all),
grid as (select y.event_year, k.code_2 from
  (select unnest([1994, 1995, 1996, 1997, 1998, 1999, 2000, 2001, 2002]) as event_year) y
  cross join (select unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']) as code_2) k),
cells as (select coalesce(n, 0) as n from grid left join counts using (event_year, code_2))
select count(*) as total_partitions, count(*) filter (n > 0) as partitions_with_targets,
  count(*) filter (n = 0) as partitions_with_zero,
  round(coalesce(avg(case when n > 0 then n end), 0), 6) as average,
  coalesce(list_sort(list(n) filter (n > 0))[cast(floor(count(*) filter (n > 0) / 2) as integer) + 1], 0) as median,
  coalesce(min(case when n > 0 then n end), 0) as min,
  coalesce(max(case when n > 0 then n end), 0) as max from cells""")
def target_averages(t):
    hit = (F.col("code_1") == "Brand#3") & (F.col("status") == "P") & (F.col("total") > 480000)
    counts = Q.conditional_distinct(S.medical(t), "person", {"n": hit}, ["event_year", "code_2"])
    grid = {
        "event_year": list(range(1994, 2003)),
        "code_2": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    }
    return Q.target_average_stats(counts, "n", ["event_year", "code_2"], grid)


_REPORTS = """reports as (
  select o_orderkey as primaryid, o_custkey as caseid, o_orderstatus as outc_cod,
    list_sort(list(distinct p_type)) as drugs,
    strftime(o_orderdate, '%Y%m%d') as start_dt, strftime(min(l_shipdate), '%Y%m%d') as event_dt,
    date_diff('day', o_orderdate, min(l_shipdate)) as duration, max(p_size) as age
  from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey
  group by o_orderkey, o_custkey, o_orderstatus, o_orderdate)"""


def _reports(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    # One order holds at most the six part types, so the set is bounded.
    return lines.groupBy(
        F.col("o_orderkey").alias("primaryid"), F.col("o_custkey").alias("caseid"),
        F.col("o_orderstatus").alias("outc_cod"), "o_orderdate",
    ).agg(
        F.sort_array(F.collect_set("p_type")).alias("drugs"),
        F.min("l_shipdate").alias("__ship"),
        F.max("p_size").alias("age"),
    ).select(
        "primaryid", "caseid", "outc_cod", "drugs", "age",
        F.date_format("o_orderdate", "yyyyMMdd").alias("start_dt"),
        F.date_format("__ship", "yyyyMMdd").alias("event_dt"),
    )


@query(f"""
with {_REPORTS}
select array_to_string(drugs, '+') as drugs, count(*) as occurrences,
  cast(len(drugs) as integer) as polypharmacy from reports group by reports.drugs
having count(*) > 1""")
def polypharmacy_reports(t):
    return Q.polypharmacy(_reports(t), "drugs").withColumn("drugs", F.array_join("drugs", "+"))


_VALID = f"""with {_REPORTS}, valid as (
  select primaryid, caseid, outc_cod, cast(duration as integer) as duration, drugs, age
  from reports where outc_cod in ('F', 'P') and duration > 0 and duration < 30)"""


def _valid(t):
    return P.valid_reports(_reports(t), "start_dt", "event_dt", "outc_cod", 30, ("F", "P"))


@query(_VALID + """ select primaryid, caseid, outc_cod, duration from valid""")
def valid_reports(t):
    return _valid(t).select("primaryid", "caseid", "outc_cod", "duration")


@query(_VALID + """, stats as (select 'all' as outc_cod, * from valid)
select outc_cod, count(*) as n, round(avg(duration), 6) as avg_duration,
  min(duration) as min_duration, max(duration) as max_duration,
  percentile_cont(0.5) within group (order by duration) as median_duration
from valid group by 1""")
def report_durations(t):
    return Q.duration_stats(_valid(t), "duration", ["outc_cod"])


@query(_VALID + """ select caseid, primaryid, duration from valid
qualify row_number() over (partition by caseid order by duration, primaryid) = 1""")
def shortest_report_per_case(t):
    rows = _valid(t).select("caseid", "primaryid", "duration")
    return O.first_per_key(rows, ["caseid"], ["duration", "primaryid"])


@query(f"""
with {_REPORTS}, buckets as (
  select unnest([0, 1, 2, 5, 15, 25, 80, 120]) as lo, unnest([1, 2, 5, 15, 25, 80, 120, 999]) as hi)
select outc_cod, lo || '-' || hi as bucket, count(*) as n from reports, buckets
where len(drugs) >= lo and len(drugs) < hi group by all""")
def drug_count_buckets(t):
    sized = _reports(t).withColumn("size", F.size("drugs"))
    return Q.bucket_counts(sized, "size", DRUG_COUNT_EDGES, ["outc_cod"])


@query(f"""
with {S.MEDICAL}, buckets as (
  select unnest([0, 5, 15, 25, 35, 45, 65, 85, 100]) as lo,
         unnest([5, 15, 25, 35, 45, 65, 85, 100, 999]) as hi)
select event_year, lo || '-' || hi as bucket, count(*) as n from medical, buckets
where age * 2 >= lo and age * 2 < hi group by all""")
def age_buckets_by_year(t):
    rows = S.medical(t).withColumn("age", F.col("age") * 2)
    return Q.bucket_counts(rows, "age", AGE_EDGES, ["event_year"])


@query("""
select * from (select p_partkey as id,
    coalesce(age, cast(try_cast(g as integer) as double)) as age,
    case when age = try_cast(g as integer) then w else g end as gndr_cod,
    case when age < 100 then 'YR' else 'DY' end as age_cod, w as wt_cod
  from (select p_partkey, case when p_type = 'PROMO' then null else cast(p_size * 3 as double) end as age,
          case when p_type = 'LARGE' then cast(p_size * 3 as varchar)
               when p_type = 'PROMO' then cast(p_size as varchar) else 'F' end as g,
          p_brand as w from part))""")
def repaired_report_fields(t):
    kind = F.col("p_type")
    rows = t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(kind != "PROMO", (F.col("p_size") * 3).cast("double")).alias("age"),
        F.when(kind == "LARGE", (F.col("p_size") * 3).cast("string"))
        .when(kind == "PROMO", F.col("p_size").cast("string"))
        .otherwise("F").alias("gndr_cod"),
        F.lit("DY").alias("age_cod"),
        F.col("p_brand").alias("wt_cod"),
    )
    return P.repair_shifted_fields(rows)


@query("""
select name, count(*) as n from (
  select case when p_type = 'PROMO' then 'x20160101y' when p_type = 'LARGE'
    then p_name || ' extended release' else p_name end as name from part)
where length(name) < 20 and not regexp_matches(name, '[^0-9]([0-9]{8})[^0-9]') group by 1""")
def usable_report_drugs(t):
    name = (
        F.when(F.col("p_type") == "PROMO", "x20160101y")
        .when(F.col("p_type") == "LARGE", F.concat("p_name", F.lit(" extended release")))
        .otherwise(F.col("p_name"))
    )
    rows = P.usable_report_drugs(t.part.select(name.alias("name")), "name")
    return rows.groupBy("name").agg(F.count("*").alias("n"))


@query(f"""
with {S.MEDICAL} select person, count(*) as n from medical group by 1 having count(*) > 50""")
def heavy_users(t):
    return Q.heavy_users(S.medical(t), "person", 50)


@query(f"""
with {S.MEDICAL}, counts as (select code_1, drug_name, count(*) as n from medical group by all)
select * from (select code_1, drug_name, n,
  row_number() over (partition by code_1 order by n desc, drug_name) as item_rank from counts)
where item_rank <= 5""")
def top_items_per_group(t):
    return Q.cluster_profile(S.medical(t), "code_1", "drug_name", 5)


@query(f"""
with {S.MEDICAL} select code_2, status, count(*) as n, count(distinct person) as persons
from medical group by all""")
def group_counts(t):
    return Q.group_counts(S.medical(t), ["code_2", "status"], "person")


@query(f"""
with {S.CLAIMS} select county, gender is null as no_gender, count(*) as n,
  count(*) filter (age is null or trim(age) = '') as n_empty,
  round(count(*) filter (age is null or trim(age) = '') / count(*), 6) as empty_share
from claims_a group by all""")
def empty_values_by_group(t):
    rows = S.claims_a(t).withColumn("no_gender", F.col("gender").isNull())
    return Q.null_share(rows, "age", ["county", "no_gender"])


@query(f"""
with {S.MEDICAL}
select event_year, c as column, v as value, count(*) as frequency from (
  select event_year, 'code_1' as c, code_1 as v from medical
  union all select event_year, 'code_2', code_2 from medical
  union all select event_year, 'age', cast(age as varchar) from medical
  union all select event_year, 'priority', priority from medical) group by all""")
def column_profiles(t):
    return Q.column_profile(S.medical(t), ["code_1", "code_2", "age", "priority"], ["event_year"])


_CO = f"""with {S.MEDICAL}, a as (select claim_id, event_year, code_1 from medical where code_1 <> ''),
b as (select claim_id, event_year, drug_name from medical where drug_name <> ''),
ta as (select code_1 from a group by 1 order by count(*) desc, 1 limit 10),
tb as (select drug_name from b group by 1 order by count(*) desc, 1 limit 12),
pairs as (select a.event_year, a.code_1, b.drug_name, count(*) as frequency
  from a join b on a.claim_id = b.claim_id and a.event_year = b.event_year
  where a.code_1 in (select code_1 from ta) and b.drug_name in (select drug_name from tb)
  group by all)"""


def _pairs(t):
    rows = S.medical(t)
    return Q.co_occurrence(
        rows, rows, ["claim_id", "event_year"], "code_1", "drug_name", 10, 12, "event_year"
    )


@query(_CO + " select * from pairs")
def code_drug_cooccurrence(t):
    return _pairs(t)


@query(f"""with {S.MEDICAL}, ta as (select code_1 from medical group by 1 order by count(*) desc, 1 limit 6),
tb as (select code_2 from medical group by 1 order by count(*) desc, 1 limit 6),
a as (select event_year, code_1, count(*) as l from medical where code_1 in (select code_1 from ta) group by all),
b as (select event_year, code_2, count(*) as r from medical where code_2 in (select code_2 from tb) group by all)
select code_1, code_2, cast(sum(l * r) as bigint) as frequency
from a join b using (event_year) group by all""")
def cooccurrence_by_year(t):
    """Same year instead of same claim: the products are taken on the counts."""
    rows = S.medical(t)
    return Q.co_occurrence(rows, rows, ["event_year"], "code_1", "code_2", 6, 6)


@query(_CO + """ select code_1, coalesce(sum(frequency) filter (event_year = 1997), 0) as "1997",
  coalesce(sum(frequency) filter (event_year = 1998), 0) as "1998",
  coalesce(sum(frequency) filter (event_year = 1999), 0) as "1999" from pairs group by 1""")
def pair_heatmap(t):
    return Q.pivot_counts(_pairs(t), "code_1", "event_year", "frequency", [1997, 1998, 1999])


@query(f"""
with {S.MEDICAL}, best as (select drug_name from medical group by 1 order by count(*) desc, 1 limit 15),
items as (select distinct claim_id, event_year, drug_name from medical
  where drug_name in (select drug_name from best))
select a.event_year, a.drug_name as item_a, b.drug_name as item_b, count(*) as frequency
from items a join items b on a.claim_id = b.claim_id and a.event_year = b.event_year
  and a.drug_name < b.drug_name group by all""")
def drug_pairs(t):
    rows = S.medical(t)
    totals = rows.groupBy("drug_name").agg(F.count("*").alias("frequency"))
    best = Q.top_bars(totals, "drug_name", 15)
    return Q.self_pairs(rows, ["claim_id", "event_year"], "drug_name", best, "event_year")


@query(_FREQ + """ select drug_name, cast(sum(frequency) as bigint) as frequency from freq
  group by 1 order by 2 desc, 1 limit 20""")
def top_drugs(t):
    return Q.top_bars(_freq(t), "drug_name", 20)


@query(_FREQ + """, v as (select event_year, drug_name, sum(frequency) as frequency from freq
    where starts_with(regexp_replace(upper(drug_name), '[^A-Z0-9]', '', 'g'), 'OLD') group by all)
  select event_year, drug_name, cast(frequency as bigint) as frequency,
    round(frequency / sum(frequency) over (partition by event_year), 6) as share from v""")
def variant_trends(t):
    return Q.variant_trend(_freq(t), "drug_name", "event_year", "old", "startswith")


@query(_FREQ + """ select drug_name, sum(frequency) filter (event_year = 1999) as y1999,
  sum(frequency) filter (event_year = 2000) as y2000 from freq
  where regexp_replace(upper(drug_name), '[^A-Z0-9]', '', 'g') = 'HOTROD'
     or contains(regexp_replace(upper(drug_name), '[^A-Z0-9]', '', 'g'), 'GEAR') group by 1""")
def variant_heatmap(t):
    hit = matches_variant("drug_name", "hot rod", "equals") | matches_variant("drug_name", "gear")
    rows = _freq(t).filter(hit)
    table = Q.pivot_counts(rows, "drug_name", "event_year", "frequency", [1999, 2000])
    return table.withColumnsRenamed({"1999": "y1999", "2000": "y2000"})


@query("""
with freq as (select p_type as g, raw as variant, count(*) as frequency from (
    select p_type, case when p_size < 15 then 'F' || (10 + p_size) || '.' || p_size
      when p_size < 30 then ' f' || (10 + p_size) || p_size else lower(p_brand) end as raw from part)
  group by all),
totals as (select variant, sum(frequency) as frequency from freq group by 1)
select variant, canonical, cast(frequency as bigint) as frequency from (
  select *, case when regexp_extract(replace(upper(variant), ' ', ''), '([A-Z][0-9]{2}(\\.?[A-Z0-9]{1,4})?)', 1) = ''
    then replace(replace(upper(variant), ' ', ''), '.', '')
    else replace(regexp_extract(replace(upper(variant), ' ', ''), '([A-Z][0-9]{2}(\\.?[A-Z0-9]{1,4})?)', 1), '.', '')
    end as canonical from totals) where variant <> canonical""")
def suggested_code_mapping(t):
    raw = (
        F.when(F.col("p_size") < 15, F.concat(F.lit("F"), F.col("p_size") + 10, F.lit("."), "p_size"))
        .when(F.col("p_size") < 30, F.concat(F.lit(" f"), F.col("p_size") + 10, "p_size"))
        .otherwise(F.lower("p_brand"))
    )
    freq = t.part.groupBy("p_type", raw.alias("variant")).agg(F.count("*").alias("frequency"))
    return M.suggest_mapping(freq, "variant", "frequency", "icd")


@query("""
with freq as (select raw as variant, count(*) as frequency from (
    select case when p_type = 'PROMO' then cast(p_size + 10000 as varchar)
      when p_type = 'LARGE' then (p_size + 10000) || '.' when p_type = 'SMALL' then lower(p_brand)
      else p_brand || '.' end as raw from part) group by all),
g as (select *, replace(replace(upper(variant), ' ', ''), '.', '') as grp from freq)
select variant, canonical, frequency from (select *, first_value(variant) over (partition by grp
  order by regexp_full_match(variant, '[0-9]{5}') desc, frequency desc, variant) as canonical from g)
where variant <> canonical""")
def suggested_procedure_mapping(t):
    raw = (
        F.when(F.col("p_type") == "PROMO", (F.col("p_size") + 10000).cast("string"))
        .when(F.col("p_type") == "LARGE", F.concat(F.col("p_size") + 10000, F.lit(".")))
        .when(F.col("p_type") == "SMALL", F.lower("p_brand"))
        .otherwise(F.concat("p_brand", F.lit(".")))
    )
    freq = t.part.groupBy(raw.alias("variant")).agg(F.count("*").alias("frequency"))
    return M.suggest_mapping(freq, "variant", "frequency", "cpt")


_TWO = """a as (select o_orderpriority as k, count(*) as n from orders where o_orderstatus <> 'F'
    and o_orderpriority <> '1-URGENT' group by 1),
  b as (select o_orderpriority as k, count(*) as n from orders where o_orderpriority <> '5-LOW'
    group by 1)"""


@query(f"""with {_TWO} select coalesce(a.k, b.k) as k, coalesce(a.n, 0) as original,
  coalesce(b.n, 0) as updated, coalesce(b.n, 0) - coalesce(a.n, 0) as delta
  from a full join b on a.k = b.k""")
def compared_totals(t):
    k = F.col("o_orderpriority").alias("k")
    a = t.orders.filter("o_orderstatus <> 'F' and o_orderpriority <> '1-URGENT'").groupBy(k)
    b = t.orders.filter("o_orderpriority <> '5-LOW'").groupBy(k)
    n = F.count("*").alias("n")
    return X.compare_totals(a.agg(n), b.agg(n), "k", "n")


@query("""
with a as (select o_orderkey as id, o_orderstatus as s, o_orderpriority as p from orders
    where o_orderpriority <> '1-URGENT'),
b as (select o_orderkey as id, case when o_totalprice > 400000 then null else o_orderstatus end as s,
    case when o_orderstatus = 'F' then 'x' else o_orderpriority end as p from orders
    where o_orderpriority <> '5-LOW')
select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null
    then 'removed' else 'changed' end as status,
  case when a.id is not null and b.id is not null then array_to_string(list_filter([
    case when a.s is distinct from b.s then 's' end,
    case when a.p is distinct from b.p then 'p' end], lambda c: c is not null), ',') end
    as changed_columns
from a full join b on a.id = b.id
where a.id is null or b.id is null or a.s is distinct from b.s or a.p is distinct from b.p""")
def snapshot_changes(t):
    a = t.orders.filter("o_orderpriority <> '1-URGENT'").selectExpr(
        "o_orderkey as id", "o_orderstatus as s", "o_orderpriority as p"
    )
    b = t.orders.filter("o_orderpriority <> '5-LOW'").selectExpr(
        "o_orderkey as id", "case when o_totalprice > 400000 then null else o_orderstatus end as s",
        "case when o_orderstatus = 'F' then 'x' else o_orderpriority end as p",
    )
    return X.snapshot_diff(a, b, "id", ["s", "p"])


@query(f"""
with {S.LOG} select event_id, case_id, round(epoch(ts - lag(ts) over (partition by case_id
  order by ts, event_id)) / 86400.0, 6) as gap_days from log""")
def days_since_previous(t):
    gaps = Q.day_gaps(S.event_log(t), "case_id", "ts", ["ts", "event_id"])
    return gaps.select("event_id", "case_id", F.round("gap_days", 6).alias("gap_days"))


@query("""
select o_custkey, row_number() over (order by md5(concat('42', ':', o_custkey)), o_custkey)
  as sample_rank from (select distinct o_custkey from orders)
qualify sample_rank <= 200""")
def sampled_persons(t):
    return O.sample_keys(t.orders, "o_custkey", 200, 42)
