"""Trajectory, distance and cluster queries on the interaction events."""

from __future__ import annotations

from pyspark.sql import functions as F

from careloom.operators import frequency as Q
from careloom.operators import trajectory as J
from careloom.plans import claims_queries as C
from careloom.plans.registry import query
from careloom.session import cut_lineage


def _traj(t):
    rows = t.events.withColumn("noisy", (F.col("event_type") == "error").cast("int"))
    return J.trajectories(rows, "user_id", "event_type", "ts", ["event_id"], keep=["noisy"])


_TRAJ = """traj as (select user_id as person, row_number() over (partition by user_id
    order by ts, event_id) as position, event_type as item, ts from events)"""


@query(f"with {_TRAJ} select person, position, item, ts, 0.0 as temporal_position from traj")
def trajectories(t):
    return _traj(t).drop("noisy")


@query(f"""with {C._WINDOWED}, ph as (select person, event_date, claim_id, drug_name, days_to_target_event as d
    from cohort where event_type = 'pharmacy')
  select person, claim_id, row_number() over (partition by person order by d desc nulls last,
    event_date, claim_id) as position, drug_name as item, cast(coalesce(d, 0) as double) as temporal_position
  from ph""")
def trajectories_by_days(t):
    rows = C._windowed(t).filter("event_type = 'pharmacy'")
    out = J.trajectories(rows, "person", "drug_name", "event_date", ["claim_id"], "days",
                         keep=["claim_id"])
    return out.drop("ts")


@query(f"""with {_TRAJ}, v as (select item, cast(row_number() over (order by item) - 1 as integer)
    as item_id from (select distinct item from traj))
  select person, position, item_id from traj join v using (item)""")
def encoded_trajectories(t):
    return J.sequence_encode(_traj(t)).select("person", "position", "item_id")


def _protos(t, traj):
    return J.pick_prototypes(traj, 5)


_COST = "list_transform(range(1, len(p) + 1), lambda j: list_sum(list_transform(p[1:j], " \
    "lambda x: case when x = s[{i}] then 0 else 1 end)))"


def _dtw(tag: str, item: str = "event_type") -> str:
    """CTEs seqs, protos, dist (person, prototype, prototype_id, distance), one element a step."""
    return f"""{tag}seqs as (select user_id as person, list({item} order by ts, event_id) as s
    from events group by 1),
  {tag}protos as (select person as pid, s as p, row_number() over (order by person) as k
    from {tag}seqs qualify k <= 5),
  {_recursion(tag, f"select person, pid, k, s, p from {tag}seqs, {tag}protos")}"""


def _recursion(tag: str, pairs: str) -> str:
    return f"""{tag}rec as (
    select person, pid, k, s, p, 1 as i, {_COST.format(i="1")} as d from ({pairs})
    union all
    select person, pid, k, s, p, i + 1, list_transform(range(1, len(p) + 1), lambda j: c[j]
      + list_min(list_transform(range(1, j + 1), lambda l: least(d[l], coalesce(d[l - 1], 1e9))
        - coalesce(c[l - 1], 0))))
    from (select *, {_COST.format(i="i + 1")} as c from {tag}rec where i < len(s))),
  {tag}dist as (select person, k as prototype, pid as prototype_id, cast(d[len(p)] as double) as distance
    from {tag}rec where i = len(s))"""


_WIDE = ", ".join(
    f"max(distance) filter (prototype = {i}) as dtw_dist_proto_{i}" for i in range(1, 6))


@query(f"with recursive {_dtw('')} select person, {_WIDE} from dist group by 1")
def dtw_features(t):
    traj = cut_lineage(_traj(t))
    return J.distances_wide(J.dtw_to_prototypes(traj, _protos(t, traj)), 5)


@query(f"""with recursive seqs as (select user_id as person, list(event_type order by ts, event_id) as s
    from events group by 1),
  following as (select person, lead(person) over (order by person) as pid from seqs),
  {_recursion('', """select f.person, f.pid, 1 as k, a.s, b.s as p from following f
    join seqs a on a.person = f.person join seqs b on b.person = f.pid""")}
select person as id_a, prototype_id as id_b, distance from dist""")
def dtw_neighbour_pairs(t):
    traj = cut_lineage(J.sequence_encode(_traj(t)))
    users = traj.select("person").distinct()
    following = J.with_position(users, [], [F.col("person")], None, "r")
    pairs = following.select(F.col("person").alias("id_a"), "r").join(
        following.select(F.col("person").alias("id_b"), (F.col("r") - 1).alias("r")), "r"
    ).drop("r")
    return J.dtw_pairs(traj, pairs)


def _clusters(t, traj):
    return J.assign_clusters(J.dtw_to_prototypes(traj, _protos(t, traj)))


def _near(tag: str) -> str:
    return f"""{tag}near as (select person, prototype as cluster, distance, lead(distance) over w as second
    from {tag}dist window w as (partition by person order by distance, prototype)
    qualify row_number() over w = 1),
  {tag}clusters as (select person, cluster, distance, case when second > 0
    then (second - distance) / second else 0 end as silhouette from {tag}near)"""


_CLUSTERS = f"{_dtw('')}, {_near('')}"


@query(f"""with recursive {_CLUSTERS} select person, cluster, distance,
  round(silhouette, 6) as silhouette from clusters""")
def trajectory_clusters(t):
    out = _clusters(t, cut_lineage(_traj(t)))
    return out.withColumn("silhouette", F.round("silhouette", 6))


_TYPES = f"""{_CLUSTERS}, sized as (select cluster, person, silhouette, len(s) as length
    from clusters join seqs using (person)),
  medians as (select cluster, floor(median(length)) as median_length from sized group by 1),
  types as (select cluster, median_length, min_by(person, (abs(length - median_length), person)) as archetype
    from sized join medians using (cluster) group by 1, 2)"""


@query(f"""with recursive {_TYPES}, labels as (select user_id as person,
    case when avg(case when event_type = 'error' then 1.0 else 0 end) > 0.2 then 1 else 0 end as l
    from events group by 1)
select cluster, cast(median_length as bigint) as median_length, archetype, count(*) as cluster_size,
  round(avg(length), 6) as cluster_avg_length, round(avg(silhouette), 6) as cluster_silhouette,
  round(avg(l), 6) as cluster_target_rate
from sized join types using (cluster) join labels using (person) group by 1, 2, 3""")
def cluster_archetypes(t):
    traj = cut_lineage(_traj(t))
    lengths = J.trajectory_lengths(traj)
    clusters = _clusters(t, traj)
    labels = traj.groupBy("person").agg((F.avg("noisy") > 0.2).cast("int").alias("is_target_case"))
    summary = J.cluster_summary(clusters, lengths, labels)
    out = J.archetypes(clusters, lengths).join(summary, "cluster")
    rounded = ["cluster_avg_length", "cluster_silhouette", "cluster_target_rate"]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query(f"""with recursive {_TYPES}, {_recursion('m', """select c.person, archetype as pid, c.cluster as k,
    a.s, b.s as p from clusters c join types using (cluster) join seqs a on a.person = c.person
    join seqs b on b.person = archetype""")}
select person, prototype_id as archetype, prototype as cluster, distance,
  round(1 / (1 + distance), 6) as match_score,
  row_number() over (partition by prototype order by distance, person) as match_rank from mdist""")
def archetype_matches(t):
    traj = cut_lineage(_traj(t))
    clusters = _clusters(t, traj)
    types = J.archetypes(clusters, J.trajectory_lengths(traj))
    out = J.archetype_match(traj, clusters, types)
    return out.withColumn("match_score", F.round("match_score", 6))


@query(f"""with recursive {_dtw('')}, targets as (select user_id as person from events group by 1
    having avg(case when event_type = 'error' then 1.0 else 0 end) > 0.15)
select person, round(avg(distance), 6) as avg_distance_to_targets, min(distance) as min_distance_to_targets,
  min_by(prototype_id, (distance, prototype_id)) as closest_target
from dist where prototype_id in (select person from targets) group by 1""")
def distances_to_targets(t):
    traj = cut_lineage(_traj(t))
    targets = traj.groupBy("person").agg(F.avg("noisy").alias("r")).filter("r > 0.15")
    out = J.target_distances(J.dtw_to_prototypes(traj, _protos(t, traj)), targets)
    return out.withColumn(
        "avg_distance_to_targets", F.round("avg_distance_to_targets", 6)
    )


@query(f"""with recursive {_CLUSTERS}, counts as (select cluster, event_type as item, count(*) as n
    from events join clusters on user_id = person group by 1, 2)
select cluster, item, n, row_number() over (partition by cluster order by n desc, item) as item_rank
from counts qualify item_rank <= 3""")
def cluster_top_items(t):
    traj = cut_lineage(_traj(t))
    rows = traj.join(_clusters(t, traj).select("person", "cluster"), "person")
    return Q.cluster_profile(rows, "cluster", "item", 3)


@query(f"""with {_TRAJ}, f as (select person, count(*) as length, count(distinct item) as diversity,
    cast(date_diff('day', min(ts), max(ts)) as integer) as span_days from traj group by 1)
  select *, round(length / nullif(span_days / 30, 0), 6) as density from f""")
def trajectory_features(t):
    out = J.trajectory_features(_traj(t))
    return out.withColumn("density", F.round("density", 6))


@query(f"""with {C._WINDOWED}, ph as (select * from cohort where event_type = 'pharmacy')
  select person, max(days_to_target_event) as first_event_days_before_target,
    min(days_to_target_event) as last_event_days_before_target,
    round(avg(days_to_target_event), 6) as temporal_mean,
    round(stddev_samp(days_to_target_event), 6) as temporal_std,
    count(*) as length, count(distinct drug_name) as diversity
  from ph group by 1""")
def timing_features(t):
    rows = C._windowed(t).filter("event_type = 'pharmacy'")
    traj = J.trajectories(rows, "person", "drug_name", "event_date", ["claim_id"], "days",
                          keep=["days_to_target_event"])
    out = J.trajectory_features(traj, "days_to_target_event")
    return out.select(
        "person", "first_event_days_before_target", "last_event_days_before_target",
        F.round("temporal_mean", 6).alias("temporal_mean"),
        F.round("temporal_std", 6).alias("temporal_std"), "length", "diversity",
    )


@query(f"""with recursive {_CLUSTERS},
  {_dtw('o', "case when value > 100 then 'big' else 'small' end")}, {_near('o')},
  joint as (select a.person, a.cluster as cluster_a, b.cluster as cluster_b from clusters a
    join oclusters b on a.person = b.person),
  usual as (select cluster_a, cluster_b as u from (select cluster_a, cluster_b, count(*) as n from joint group by 1, 2)
    qualify row_number() over (partition by cluster_a order by n desc, cluster_b) = 1)
select person, cluster_a, cluster_b, cast(cluster_b = u as integer) as cluster_match
from joint join usual using (cluster_a)""")
def cluster_agreement(t):
    rows = t.events.withColumn("big", F.when(F.col("value") > 100, "big").otherwise("small"))
    other = cut_lineage(J.trajectories(rows, "user_id", "big", "ts", ["event_id"]))
    return J.cluster_agreement(_clusters(t, cut_lineage(_traj(t))), _clusters(t, other))
