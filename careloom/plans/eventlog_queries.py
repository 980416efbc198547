"""Event-log queries on the interaction events (case = user) and on the claims events."""

from __future__ import annotations

from pyspark.sql import functions as F

from careloom.operators import eventlog as E
from careloom.plans import standin as S
from careloom.plans.registry import query

TIE = ["event_id"]

_DAYLOG = """daylog as (select user_id || '|' || strftime(ts, '%Y-%m-%d') as case_id,
  event_type as activity, ts, event_id from events)"""


def _daylog(t):
    return t.events.select(
        F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("case_id"),
        F.col("event_type").alias("activity"), "ts", "event_id",
    )


def _hour():
    return F.date_trunc("hour", F.col("ts"))


@query(f"""with {S.MEDICAL}, slots as (
  select person, event_date, 'DRUG:' || drug_name as activity, drug_name as code, status, concat_ws('#', claim_id, line, part, 'drug_name') as activity_instance_id from medical
  union all select person, event_date, 'ICD:' || code_1, code_1, status, concat_ws('#', claim_id, line, part, 'code_1') from medical
  union all select person, event_date, 'ICD:' || code_2, code_2, status, concat_ws('#', claim_id, line, part, 'code_2') from medical
  union all select person, event_date, 'CPT:' || code_3, code_3, status, concat_ws('#', claim_id, line, part, 'code_3') from medical)
select cast(person as varchar) as case_id, activity, event_date as ts,
  case when status = 'P' then 'target' else 'control' end as "group", count(*) as n,
  count(distinct activity_instance_id) as instances
from slots where code is not null and code <> '' and upper(code) <> 'NA'
  and code in (select p_name from part union select p_type from part union select 'A')
group by all""")
def claims_event_log(t):
    rows = S.medical(t).withColumn("is_p", (F.col("status") == "P").cast("int"))
    part = t.part
    sets = part.select(F.array("p_name", "p_type").alias("items")).distinct()
    log = E.event_log(
        rows, "person", "event_date", ["claim_id", "line", "part"], "drug_name",
        ["code_1", "code_2"], ["code_3"],
        allowed=E.allowed_codes(sets, "items", ["A"]), group="is_p", keep=["claim_id", "part"],
    )
    return E.instance_counts(log, ["case_id", "activity", "ts", "group"], ["claim_id", "part"])


_SPLIT = f"""with {S.PREFIXED_LOG}, numbered as (select *, row_number() over (partition by case_id
    order by ts, event_id) as event_index, regexp_matches(activity, 'signup') as is_target from log),
  firsts as (select case_id, min(event_index) filter (is_target) as first_target_index,
    min(ts) filter (is_target) as target_time, min(ts) as first_time from numbered group by 1),
  pre as (select numbered.*, target_time, first_time, epoch_us(target_time) / 86400000000.0
      - epoch_us(ts) / 86400000000.0 as dt_days_raw,
      (epoch_us(target_time) - epoch_us(ts)) / 86400000000.0 as dt_days
    from numbered join firsts using (case_id) where event_index <= first_target_index),
  post as (select numbered.* from numbered join firsts using (case_id)
    where event_index > first_target_index)"""


def _pre(t):
    return E.split_at_first_target(S.prefixed_log(t), ["signup"], TIE, "pre")


@query(_SPLIT + """ select case_id, event_id, round(dt_days, 6) as dt_days from pre""")
def events_before_target(t):
    return _pre(t).select("case_id", "event_id", F.round("dt_days", 6).alias("dt_days"))


@query(_SPLIT + " select case_id, event_id from post")
def events_after_target(t):
    post = E.split_at_first_target(S.prefixed_log(t), ["signup"], TIE, "post")
    return post.select("case_id", "event_id")


@query(_SPLIT + """ select case_id, event_id, event_index, is_target, first_target_index,
  first_target_index is not null as has_target from numbered join firsts using (case_id)""")
def first_target_index(t):
    rows = E.first_target_index(S.prefixed_log(t), ["signup"], TIE)
    return rows.select(
        "case_id", "event_id", "event_index", "is_target", "first_target_index", "has_target"
    )


_COUNTS = """ select case_id, count(*) as {p}n_events,
  count(*) filter (activity like 'DRUG:%') as {p}n_drug_events,
  count(*) filter (activity like 'ICD:%') as {p}n_icd_events,
  count(*) filter (activity like 'CPT:%') as {p}n_cpt_events,
  count(distinct activity) as {p}n_unique_activities from {t} group by 1"""


@query(_SPLIT + _COUNTS.format(p="pre_", t="pre"))
def pre_target_counts(t):
    return E.case_counts(_pre(t), "pre_")


@query(_SPLIT + _COUNTS.format(p="post_", t="post"))
def post_target_counts(t):
    post = E.split_at_first_target(S.prefixed_log(t), ["signup"], TIE, "post")
    return E.case_counts(post, "post_")


@query(_SPLIT + " select case_id, target_time, first_time, round(max(dt_days), 6) as time_to_target_days, "
       + ", ".join(
           f"count(*) filter (dt_days <= {w} and activity like '{tag}%') as n_{kind}events_{w}d"
           for kind, tag in [("", ""), ("drug_", "DRUG:"), ("icd_", "ICD:"), ("cpt_", "CPT:")]
           for w in (1, 3, 10))
       + " from pre group by 1, 2, 3")
def time_to_event(t):
    out = E.time_to_event(_pre(t), (1, 3, 10))
    return out.withColumn("time_to_target_days", F.round("time_to_target_days", 6))


@query(_SPLIT + """ select case_id, replace(max_by(activity, (ts, event_id)), 'DRUG:', '') as last_code,
  round(min(dt_days), 6) as days_from_last,
  count(distinct activity) filter (dt_days <= 1) as n_unique_1d,
  count(distinct activity) filter (dt_days <= 3) as n_unique_3d
  from pre where activity like 'DRUG:%' group by 1""")
def last_drug_before_target(t):
    out = E.last_item_before_target(_pre(t), "DRUG:", TIE, (1, 3))
    return out.withColumn("days_from_last", F.round("days_from_last", 6))


@query(_SPLIT + """, l as (select case_id, replace(max_by(activity, (ts, event_id)), 'DRUG:', '')
    as last_code from pre where activity like 'DRUG:%' group by 1)
  select last_code, count(*) as n from l group by 1 order by 2 desc, 1 limit 20""")
def top_last_drugs(t):
    last = E.last_item_before_target(_pre(t), "DRUG:", TIE)
    counts = last.groupBy("last_code").agg(F.count("*").alias("n"))
    return E.top_n(counts, [F.col("n").desc(), F.col("last_code")], 20)


@query(_SPLIT + """ select activity, count(*) as n, split_part(activity, ':', 1) as code_type
  from pre where activity like 'ICD:%' or activity like 'CPT:%' group by 1
  order by 2 desc, 1 limit 30""")
def top_activities_before_target(t):
    return E.top_activities(_pre(t), ["ICD:", "CPT:"], 30)


_TRACES = f"""with {_DAYLOG}, seqs as (select case_id, count(*) as length,
    string_agg(activity, ',' order by ts, event_id) as seq from daylog group by 1),
  found as (select seq, min(case_id) as trace_id, length, count(*) as absolute_frequency,
    count(*) / (select count(*) from seqs) as rel from seqs group by seq, length)"""


@query(_TRACES + """ select trace_id, length, absolute_frequency, round(rel, 6) as relative_frequency
  from found""")
def traces(t):
    found = E.traces(_daylog(t), TIE, _hour())
    return found.withColumn("relative_frequency", F.round("relative_frequency", 6))


@query(_TRACES + """ select trace_id, row_number() over (partition by case_id order by ts, event_id)
  as event_index, activity from found join daylog on trace_id = case_id""")
def trace_steps(t):
    log = _daylog(t)
    return E.trace_steps(log, E.traces(log, TIE, _hour()), TIE, _hour())


@query(_TRACES + """, run as (select *, sum(absolute_frequency) over (order by absolute_frequency desc,
    trace_id) as c, sum(absolute_frequency) over () as n from found)
  select trace_id, length, absolute_frequency, round(rel, 6) as relative_frequency,
    round(c / n, 6) as cumulative_share from run where (c - absolute_frequency) / n < 0.8""")
def trace_coverage(t):
    shown = E.trace_explorer(E.traces(_daylog(t), TIE, _hour()), 0.8)
    return shown.withColumns(
        {c: F.round(c, 6) for c in ("relative_frequency", "cumulative_share")}
    )


@query(_SPLIT + """, w as (select *, unnest([1, 2, 5]) as window_days from pre),
  seqs as (select window_days, case_id, count(*) as length,
    string_agg(activity, ',' order by ts, event_id) as seq from w
    where dt_days <= window_days group by 1, 2)
  select window_days, min(case_id) as trace_id, length, count(*) as absolute_frequency,
    round(count(*) / any_value(n), 6) as relative_frequency
  from seqs join (select window_days, count(*) as n from seqs group by 1) using (window_days)
  group by window_days, seq, length""")
def windowed_traces(t):
    found = E.windowed_traces(_pre(t), TIE, (1, 2, 5))
    return found.withColumn("relative_frequency", F.round("relative_frequency", 6))


@query(_SPLIT + """ select case_id, row_number() over (partition by case_id order by ts, event_id)
  as event_index, activity from pre where activity like 'DRUG:%'""")
def drug_sequences(t):
    return E.drug_sequences(_pre(t), TIE)


_NEXT = f"""with {S.LOG}, n as (select *, lead(activity) over (partition by case_id
    order by ts, event_id) as next_activity, row_number() over (partition by case_id
    order by ts, event_id) as r from log)"""


@query(_NEXT + """ select activity, next_activity, count(*) as n from n
  where next_activity is not null group by all""")
def directly_follows(t):
    return E.directly_follows(S.event_log(t), TIE)


@query(_NEXT + """ select 'Start' as antecedent, activity as consequent, count(*) as n from n
  where r = 1 group by 2
  union all select activity, coalesce(next_activity, 'End'), count(*) from n group by 1, 2""")
def process_matrix(t):
    return E.process_matrix(S.event_log(t), TIE)


@query(f"with {S.LOG} select activity, count(*) as n from log group by 1")
def process_map_nodes(t):
    return E.process_map(S.event_log(t), TIE)[0]


@query(f"""with {S.PREFIXED_LOG}, g as (select *, lag(ts) over w as pts, lag(activity) over w as pa
    from log window w as (partition by case_id order by ts, event_id)),
  times as (select case_id, count(*) as path_length,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 as span,
    sum((epoch_us(ts) - epoch_us(pts)) / 86400000000.0) as gap,
    max((epoch_us(ts) - epoch_us(pts)) / 86400000000.0) as max_gap, count(pts) as gaps,
    count(*) filter (activity like 'DRUG:%' and pa like 'DRUG:%' and activity <> pa) as sw,
    count(*) filter (activity = pa) as loops from g group by 1),
  acts as (select case_id, activity, count(*) as c from log group by 1, 2),
  mix as (select case_id, count(*) as u, max_by(activity, (c, activity)) as top, max(c) as topc,
    count(*) filter (c > 1) as rep, -sum(c / path_length * ln(c / path_length)) as ent
    from acts join times using (case_id) group by 1),
  conc as (select case_id, max(d) as d from (select case_id, ts, count(distinct activity) as d
    from log where activity like 'DRUG:%' group by 1, 2) group by 1)
select case_id, path_length, u as unique_activities, round(u / path_length, 6) as activity_diversity,
  top as top_activity, topc as top_activity_count, round(span, 6) as throughput_days,
  round(coalesce(gap, 0), 6) as waiting_days, round(gap / nullif(gaps, 0), 6) as mean_gap_days,
  round(max_gap, 6) as max_waiting_days, rep as repeated_activities, rep > 0 as has_repetition,
  loops as self_loops, round(ent, 6) as entropy, sw as drug_switches,
  coalesce(d, 0) as max_concurrent_drugs
from times join mix using (case_id) left join conc using (case_id)""")
def process_features(t):
    out = E.process_features(S.prefixed_log(t), TIE)
    rounded = ["activity_diversity", "throughput_days", "waiting_days", "mean_gap_days",
               "max_waiting_days", "entropy"]
    return out.withColumns({c: F.round(c, 6) for c in rounded})
