"""Event logs: building, splitting at a target, traces, directly-follows and process features.

A log has ``case_id``, ``activity`` and ``ts``; ``tie`` columns make the order total. No operator
collects a case: positions and neighbours come from :mod:`careloom.operators.ordering`, and traces
are compared by digests that combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careloom.operators.frequency import explode_slots
from careloom.operators.ordering import (
    range_bucket,
    ranged,
    top_n,
    with_neighbour,
    with_position,
    with_running_total,
)

MICROS_PER_DAY = 86_400_000_000
START, END = "Start", "End"


def event_log(
    events: DataFrame, key: str, ts: str, row_id: Sequence[str], drug: str,
    icd_slots: Sequence[str], cpt_slots: Sequence[str], allowed: DataFrame | None = None, group: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Long event log of wide events: prefixed activities with instance and resource ids.

    The instance id is made of the event's own id columns and the slot, so a recomputed task
    gives the same ids.
    ``allowed`` (column ``code``) limits the activities to listed codes; ``group`` is a 0/1 column
    that becomes 'target' or 'control'.
    """
    prefix = {drug: "DRUG:", **{s: "ICD:" for s in icd_slots}, **{s: "CPT:" for s in cpt_slots}}
    kept = list(dict.fromkeys([key, ts, *row_id, *([group] if group else []), *keep]))
    rows = explode_slots(events, list(prefix), kept).filter(F.upper("code") != "NA")
    if allowed is not None:
        rows = rows.join(allowed.select("code").distinct(), "code", "left_semi")
    label = F.create_map(*[F.lit(x) for pair in prefix.items() for x in pair])
    out = rows.select(
        F.col(key).cast("string").alias("case_id"),
        F.concat(label[F.col("slot")], F.col("code")).alias("activity"),
        F.col(ts).alias("ts"),
        F.concat_ws("#", *row_id, "slot").alias("activity_instance_id"),
        F.lit("complete").alias("lifecycle_id"),
        F.lit("system").alias("resource_id"),
        *([F.when(F.col(group) == 1, "target").otherwise("control").alias("group")]
          if group else []),
        *keep,
    )
    return out


def instance_counts(log: DataFrame, by: Sequence[str], source: Sequence[str]) -> DataFrame:
    """Rows ``n`` and distinct ``instances`` of each group of a log.

    ``source`` are columns that an instance id holds, so that they split no instance. Rows that a
    join has dealt by one of them are counted per instance where they are; only sums are shuffled.
    """
    each = log.groupBy(*by, *source, "activity_instance_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.count("activity_instance_id").alias("instances"))


def allowed_codes(itemsets: DataFrame, items: str, target_codes: Sequence[str] = ()) -> DataFrame:
    """Codes of all itemsets plus the target codes."""
    codes = itemsets.select(F.explode(items).alias("code"))
    if target_codes:
        spark = itemsets.sparkSession
        codes = codes.unionByName(
            spark.range(1).select(F.explode(F.array(*map(F.lit, target_codes))).alias("code"))
        )
    return codes.distinct()


def _order(tie: Sequence[str]) -> list[str]:
    return ["ts", *tie]


def first_targets(log: DataFrame, is_target: Column, tie: Sequence[str]) -> DataFrame:
    """First target event (its place in the order and its time) and first time of each case."""
    place = F.struct(*_order(tie))
    return log.groupBy("case_id").agg(
        F.min(F.when(is_target, place)).alias("target_place"),
        F.min(F.when(is_target, F.col("ts"))).alias("target_time"),
        F.min("ts").alias("first_time"),
    ).filter(F.col("target_place").isNotNull())


def matches(patterns: Sequence[str]) -> Column:
    """Activity contains one of the regular expressions."""
    return F.col("activity").rlike("|".join(f"(?:{p})" for p in patterns))


def split_at_first_target(
    log: DataFrame, patterns: Sequence[str], tie: Sequence[str], part: str = "pre",
    include_target: bool = True,
) -> DataFrame:
    """Events up to the first target (which belongs to 'pre'), or the events after it.

    Cases without a target drop out. Adds the target time, first time and ``dt_days``, the days
    left until the target. The comparison is on the sort key itself, so nothing is numbered.
    """
    targets = first_targets(log, matches(patterns), tie)
    place = F.struct(*_order(tie))
    joined = log.join(targets, "case_id")
    if part == "post":
        kept = joined.filter(place > F.col("target_place"))
    elif include_target:
        kept = joined.filter(place <= F.col("target_place"))
    else:
        kept = joined.filter(place < F.col("target_place"))
    micros = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("target_time"))
    return kept.withColumn("dt_days", micros / MICROS_PER_DAY).drop("target_place")


def first_target_index(
    log: DataFrame, patterns: Sequence[str], tie: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """Every event with its index, whether the case has a target, and the first target's index."""
    order = [F.col(c) for c in _order(tie)]
    numbered = with_position(log, ["case_id"], order, bucket, "event_index")
    is_target = matches(patterns)
    firsts = numbered.groupBy("case_id").agg(
        F.min(F.when(is_target, F.col("event_index"))).alias("first_target_index")
    )
    return numbered.withColumn("is_target", is_target).join(firsts, "case_id").withColumn(
        "has_target", F.col("first_target_index").isNotNull()
    )


def case_counts(log: DataFrame, prefix: str = "") -> DataFrame:
    """Events, events per kind and distinct activities of each case."""
    per_activity = log.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("__n"))

    def kind(tag: str) -> Column:
        hit = F.when(F.col("activity").startswith(tag), F.col("__n"))
        return F.coalesce(F.sum(hit), F.lit(0))

    return per_activity.groupBy("case_id").agg(
        F.sum("__n").alias(f"{prefix}n_events"),
        kind("DRUG:").alias(f"{prefix}n_drug_events"),
        kind("ICD:").alias(f"{prefix}n_icd_events"),
        kind("CPT:").alias(f"{prefix}n_cpt_events"),
        F.count(F.lit(1)).alias(f"{prefix}n_unique_activities"),
    )


def time_to_event(pre: DataFrame, windows: Sequence[int] = (30, 90, 180)) -> DataFrame:
    """Days from the first event to the target, and event counts in windows before it."""
    kinds = {"": F.lit(True), "drug_": F.col("activity").startswith("DRUG:"),
             "icd_": F.col("activity").startswith("ICD:"),
             "cpt_": F.col("activity").startswith("CPT:")}
    counts = [
        F.count_if((F.col("dt_days") <= w) & hit).alias(f"n_{kind}events_{w}d")
        for kind, hit in kinds.items()
        for w in windows
    ]
    return pre.groupBy("case_id", "target_time", "first_time").agg(
        F.max("dt_days").alias("time_to_target_days"), *counts
    )


def last_item_before_target(
    pre: DataFrame, prefix: str, tie: Sequence[str], windows: Sequence[int] = (30, 90, 180)
) -> DataFrame:
    """Last item of a kind before the target, its distance, and distinct items in windows."""
    rows = pre.filter(F.col("activity").startswith(prefix))
    place = F.struct(*_order(tie))
    items = rows.groupBy("case_id", "activity").agg(
        F.max(place).alias("__last"), F.min("dt_days").alias("__dt")
    )
    return items.groupBy("case_id").agg(
        F.replace(F.max_by("activity", "__last"), F.lit(prefix), F.lit("")).alias("last_code"),
        F.min("__dt").alias("days_from_last"),
        *[F.count_if(F.col("__dt") <= w).alias(f"n_unique_{w}d") for w in windows],
    )


def top_activities(log: DataFrame, prefixes: Sequence[str], n: int | None = 30) -> DataFrame:
    """Most frequent activities of the given kinds, with the kind."""
    kinds = F.split("activity", ":")[0]
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("activity").startswith(p)
    counts = log.filter(hit).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("code_type", kinds)
    return top_n(counts, [F.col("n").desc(), F.col("activity")], n) if n else counts


# --- traces -------------------------------------------------------------------------------


def with_event_index(
    log: DataFrame, tie: Sequence[str], bucket: Column | None = None,
    case: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Position of each event in its case. A hot case, or a hot day of one, is spread over range
    partitions; ``bucket`` names another cut that follows the order."""
    return with_position(log, list(case), [F.col(c) for c in _order(tie)], bucket, "event_index")


def case_digests(numbered: DataFrame, case: Sequence[str] = ("case_id",)) -> DataFrame:
    """Length and a 128-bit digest of the activity sequence of each case.

    Two independent hashes of (index, activity) are combined by XOR, which does not depend on the
    order in which rows arrive, so a case of any size is digested by partial aggregates. Equal
    sequences always agree; different ones agree with a chance of 2^-128 per pair.
    """
    return numbered.groupBy(*case).agg(
        F.count(F.lit(1)).alias("length"),
        F.bit_xor(F.xxhash64("event_index", "activity")).alias("__d1"),
        F.bit_xor(F.xxhash64("activity", F.lit("trace"), "event_index")).alias("__d2"),
    )


def traces(
    log: DataFrame, tie: Sequence[str], bucket: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Distinct activity sequences: a case that shows the sequence, length, cases and share."""
    case = [*by, "case_id"]
    digests = case_digests(with_event_index(log, tie, bucket, case), case)
    found = digests.groupBy(*by, "length", "__d1", "__d2").agg(
        F.min("case_id").alias("trace_id"), F.count(F.lit(1)).alias("absolute_frequency")
    )
    if by:
        totals = digests.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"))
        found = found.join(totals, list(by))
    else:
        found = found.withColumn("__all", digests.agg(F.count(F.lit(1)).alias("n")).scalar())
    share = F.col("absolute_frequency") / F.col("__all")
    return found.select(
        *by, "trace_id", "length", "absolute_frequency", share.alias("relative_frequency")
    )


def trace_steps(
    log: DataFrame, found: DataFrame, tie: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """Steps of the traces: one row per (trace, index, activity)."""
    shown = log.join(found.select(F.col("trace_id").alias("case_id")), "case_id", "left_semi")
    return with_event_index(shown, tie, bucket).select(
        F.col("case_id").alias("trace_id"), "event_index", "activity"
    )


def trace_explorer(found: DataFrame, coverage: float = 0.8) -> DataFrame:
    """Most frequent traces until their shares reach the coverage."""
    desc = found.withColumn("__desc", -F.col("absolute_frequency"))
    running = with_running_total(
        desc, [], [F.col("__desc"), F.col("trace_id")], F.col("__desc"),
        {"__cases": "absolute_frequency"},
    )
    total = found.agg(F.sum("absolute_frequency").alias("n")).scalar()
    cumulative = F.col("__cases") / total
    before = (F.col("__cases") - F.col("absolute_frequency")) / total
    return (
        running.withColumn("cumulative_share", cumulative)
        .filter(before < coverage)
        .drop("__desc", "__cases")
    )


def windowed_traces(
    pre: DataFrame, tie: Sequence[str], days: Sequence[int] = (15, 30, 60, 90),
    bucket: Column | None = None,
) -> DataFrame:
    """Traces of the events in each window before the target; one scan for all windows."""
    windows = F.filter(F.array(*[F.lit(d) for d in days]), lambda d: F.col("dt_days") <= d)
    spread = pre.withColumn("window_days", F.explode(windows))
    return traces(spread, tie, bucket, by=["window_days"])


def drug_sequences(
    log: DataFrame, tie: Sequence[str], prefix: str = "DRUG:", bucket: Column | None = None
) -> DataFrame:
    """Drug sequence of each case in long form: one row per step."""
    drugs = log.filter(F.col("activity").startswith(prefix))
    return with_event_index(drugs, tie, bucket).select("case_id", "event_index", "activity")


# --- directly follows ---------------------------------------------------------------------


def _laid_out(
    log: DataFrame, tie: Sequence[str], bucket: Column | None
) -> tuple[DataFrame, Column]:
    """The log in range partitions, built once for all that reads it, and its bucket."""
    if bucket is not None:
        return log, bucket
    return ranged(log, ["case_id"], [F.col(c) for c in _order(tie)]), range_bucket()


def _with_next(log: DataFrame, tie: Sequence[str], bucket: Column | None) -> DataFrame:
    return with_neighbour(log, ["case_id"], _order(tie), bucket, "activity", "next_activity")


def directly_follows(
    log: DataFrame, tie: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """How often one activity directly follows another within a case."""
    pairs = _with_next(log, tie, bucket).filter(F.col("next_activity").isNotNull())
    return pairs.groupBy("activity", "next_activity").agg(F.count(F.lit(1)).alias("n"))


def process_matrix(log: DataFrame, tie: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Antecedent to consequent counts, with Start and End around every case."""
    log, bucket = _laid_out(log, tie, bucket)
    steps = _with_next(log, tie, bucket).groupBy(
        F.col("activity").alias("antecedent"),
        F.coalesce("next_activity", F.lit(END)).alias("consequent"),
    ).agg(F.count(F.lit(1)).alias("n"))
    firsts = log.groupBy("case_id").agg(
        F.min_by("activity", F.struct(*_order(tie))).alias("consequent")
    )
    starts = firsts.groupBy(F.lit(START).alias("antecedent"), "consequent").agg(
        F.count(F.lit(1)).alias("n")
    )
    return starts.unionByName(steps)


def process_map(
    log: DataFrame, tie: Sequence[str], bucket: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes (activity, n) and edges (antecedent, consequent, n) of the process map."""
    log, bucket = _laid_out(log, tie, bucket)
    nodes = log.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))
    return nodes, process_matrix(log, tie, bucket)


def process_features(
    log: DataFrame, tie: Sequence[str], drug_prefix: str = "DRUG:", bucket: Column | None = None
) -> DataFrame:
    """Path, time, repetition, entropy and drug features of each case."""
    log, bucket = _laid_out(log, tie, bucket)
    gaps_in = with_neighbour(
        log, ["case_id"], _order(tie), bucket, F.struct("activity", "ts"), "__prev", step=-1,
    )
    gap = F.timestamp_diff("MICROSECOND", F.col("__prev.ts"), F.col("ts")) / MICROS_PER_DAY
    is_drug = F.col("activity").startswith(drug_prefix)
    switch = is_drug & F.col("__prev.activity").startswith(drug_prefix) & (
        F.col("activity") != F.col("__prev.activity")
    )
    times = gaps_in.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("path_length"),
        F.min("ts").alias("__first"),
        F.max("ts").alias("__last"),
        F.sum(gap).alias("__gap"),
        F.max(gap).alias("max_waiting_days"),
        F.count(gap).alias("__gaps"),
        F.count_if(switch).alias("drug_switches"),
        F.count_if(F.col("activity") == F.col("__prev.activity")).alias("self_loops"),
    )
    per_activity = log.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("c"))
    lengths = times.select("case_id", F.col("path_length").alias("__len"))
    share = F.col("c") / F.col("__len")
    mix = per_activity.join(lengths, "case_id").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("unique_activities"),
        F.max_by("activity", F.struct("c", "activity")).alias("top_activity"),
        F.max("c").alias("top_activity_count"),
        F.count_if(F.col("c") > 1).alias("repeated_activities"),
        (-F.sum(share * F.log(share))).alias("entropy"),
    )
    same_time = (
        log.filter(is_drug).groupBy("case_id", "ts").agg(F.countDistinct("activity").alias("d"))
        .groupBy("case_id").agg(F.max("d").alias("__concurrent"))
    )
    span = F.timestamp_diff("MICROSECOND", F.col("__first"), F.col("__last")) / MICROS_PER_DAY
    return times.join(mix, "case_id").join(same_time, "case_id", "left").select(
        "case_id", "path_length", "unique_activities",
        (F.col("unique_activities") / F.col("path_length")).alias("activity_diversity"),
        "top_activity", "top_activity_count",
        span.alias("throughput_days"),
        F.coalesce("__gap", F.lit(0.0)).alias("waiting_days"),
        F.try_divide(F.col("__gap"), F.col("__gaps")).alias("mean_gap_days"),
        "max_waiting_days", "repeated_activities",
        (F.col("repeated_activities") > 0).alias("has_repetition"),
        "self_loops", "entropy", "drug_switches",
        F.coalesce("__concurrent", F.lit(0)).alias("max_concurrent_drugs"),
    )
