"""Event fact, classification and case/control cohorts.

A cohort needs one row per person (label, first dates) and then the events of the chosen persons.
The person table comes from a map-side combined aggregate; the events meet it in one equi-join, in
which adaptive execution splits hot persons. The person table is far smaller than the events and is
used twice, so it is checkpointed instead of computed twice. Controls are drawn by the smallest seeded hashes, so
a recomputed task draws the same sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careloom.constants import DIAGNOSIS_SLOTS, ED_LINES, MODIFIER_SLOTS, OPIOID_CODES
from careloom.functions.columns import any_code_in, code_prefix
from careloom.operators.mapping import rows_with_code
from careloom.operators.ordering import hash_bucket, hash_text, with_position
from careloom.session import cut_lineage

TARGET, EXCLUSION, OTHER = "opioid_ed", "ed_non_opioid", "non_target"


def classify_event(
    df: DataFrame,
    slots: Sequence[str] = DIAGNOSIS_SLOTS,
    codes: Iterable[str] | None = None,
    prefixes: Iterable[str] = (),
    cpt_slots: Sequence[str] = MODIFIER_SLOTS,
    cpt_codes: Iterable[str] = (),
    cpt_prefixes: Iterable[str] = (),
    line: str | None = "hcg_line",
    ed_lines: Sequence[str] = ED_LINES,
    else_label: str = EXCLUSION,
    out: str = "event_classification",
) -> DataFrame:
    """Label events.

    Without targets: opioid code in any slot gives 'opioid_ed', everything else ``else_label``
    (emergency lines always 'ed_non_opioid'). With target codes or prefixes (diagnoses are read
    from the first slot, procedures from ``cpt_slots``): 'target', 'ed_non_opioid', 'non_target'.
    """
    codes, prefixes = list(codes or []), list(prefixes)
    cpt_codes, cpt_prefixes = list(cpt_codes), list(cpt_prefixes)
    is_ed = F.coalesce(F.col(line).isin(*ed_lines), F.lit(False)) if line else F.lit(False)
    if codes or prefixes or cpt_codes or cpt_prefixes:
        hit = any_code_in(codes, slots[:1]) if codes else F.lit(False)
        if prefixes:
            hit = hit | code_prefix(prefixes, slots[0])
        for slot in cpt_slots if (cpt_codes or cpt_prefixes) else ():
            hit = hit | any_code_in(cpt_codes, [slot]) | code_prefix(cpt_prefixes, slot)
        first, last = "target", OTHER
    else:
        hit, first, last = any_code_in(OPIOID_CODES, slots), TARGET, else_label
    label = F.when(hit, first).when(is_ed, EXCLUSION).otherwise(last)
    return df.withColumn(out, label)


def event_sequence(
    df: DataFrame, key: str, order: Sequence[str], bucket: Column | None = None, out: str = "event_sequence"
) -> DataFrame:
    """Position of each event of a person in time order; without a bucket by range partitions."""
    return with_position(df, [key], [F.col(c) for c in order], bucket, out)


def event_fact(
    medical: DataFrame,
    pharmacy: DataFrame,
    primary: str,
    drug: str,
    key: str = "person",
    date: str = "event_date",
    order: Sequence[str] = ("event_date",),
    sequence: bool = True,
) -> DataFrame:
    """One row per event of both sources, numbered per person and source.

    Medical rows need a primary code, pharmacy rows a drug; columns of the other source are null.
    """
    sources = [
        (medical.filter(F.col(primary).isNotNull() & (F.col(primary) != "")), "medical"),
        (pharmacy.filter(F.col(drug).isNotNull() & (F.col(drug) != "")), "pharmacy"),
    ]
    parts = []
    for rows, name in sources:
        rows = rows.filter(F.col(key).isNotNull() & F.col(date).isNotNull())
        if sequence:
            usable = [c for c in order if c in rows.columns]
            rows = event_sequence(rows, key, usable)
        parts.append(rows.withColumns({"event_type": F.lit(name), "data_source": F.lit(name)}))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def drug_exposure(pharmacy: DataFrame, drug: str, columns: Sequence[str]) -> DataFrame:
    """Pharmacy events with a drug; the days to the target are not known yet."""
    return pharmacy.filter(F.col(drug).isNotNull() & (F.trim(drug) != "")).select(
        *columns, F.lit(None).cast("int").alias("days_to_target_event")
    )


def sample_controls(
    people: DataFrame, key: str, is_case: str, ratio: int | None = 5, limit: int | None = None,
    seed: str | int = 42,
) -> DataFrame:
    """All cases plus ``ratio`` controls per case (or ``limit`` controls), all if fewer exist.

    ``people`` holds one row per person. Persons fall into 4096 hash buckets; case and control
    counts per bucket give the limit and every bucket's rank offset, so there is no global sort,
    no action and no shared task beyond the 4096-row count table.
    """
    cut = people.withColumn("__h", hash_text(seed, key))
    cut = cut.withColumn("__b", hash_bucket(F.col("__h")))
    counts = cut.groupBy("__b").agg(
        F.count_if(F.col(is_case)).alias("__cases"),
        F.count_if(~F.col(is_case)).alias("__controls"),
    )
    everything = Window.partitionBy()
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.lit(limit) if limit is not None else ratio * F.sum("__cases").over(everything)
    offsets = counts.select(
        "__b",
        wanted.alias("__limit"),
        F.coalesce(F.sum("__controls").over(earlier), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy("__b", is_case).orderBy("__h", key)
    ranked = (
        cut.join(offsets, "__b")
        .filter(F.col(is_case) | (F.col("__before") < F.col("__limit")))
        .withColumn("__rank", F.col("__before") + F.row_number().over(inside))
    )
    chosen = F.col(is_case) | (F.col("__rank") <= F.col("__limit"))
    return ranked.filter(chosen).select(*people.columns)


def _finish(events: DataFrame, members: DataFrame, key: str, cohort: str, control: str,
            cohort_name: str) -> DataFrame:
    return events.join(members, key).withColumns(
        {
            "target": F.lit(1),
            "is_target_case": F.col("is_case").cast("int"),
            "cohort_name": F.lit(cohort_name),
            "cohort": F.when(F.col("is_case"), cohort).otherwise(control),
        }
    ).drop("is_case")


def case_control_cohort(
    events: DataFrame,
    is_target: Column,
    key: str = "person",
    date: str = "event_date",
    ratio: int = 5,
    seed: str | int = 42,
    cohort_name: str = "opioid_ed",
    first_date: str = "first_target_date",
) -> DataFrame:
    """Events of all target persons and of ``ratio`` sampled others per target person."""
    people = events.groupBy(key).agg(
        F.coalesce(F.bool_or(is_target), F.lit(False)).alias("is_case"),
        F.min(F.when(is_target, F.col(date))).alias(first_date),
    )
    members = sample_controls(cut_lineage(people), key, "is_case", ratio, seed=seed)
    return _finish(events, members, key, cohort_name.upper(), "NON_ED", cohort_name)


def windowed_cohort(
    events: DataFrame,
    is_target: Column,
    is_excluded: Column,
    key: str = "person",
    date: str = "event_date",
    window_days: int = 30,
    ratio: int = 5,
    seed: str | int = 42,
    cohort_name: str = "ed_non_opioid",
    first_date: str = "first_target_date",
) -> DataFrame:
    """Cohort with a look-back window on pharmacy events.

    Persons with an excluded event are neither cases nor controls. The reference date of a case
    is its first target date; of a control its first non-target medical event, else its first
    medical, else its first event. Medical events all stay; pharmacy events stay when they lie
    0 to ``window_days`` days before the reference date.
    """
    medical = F.col("event_type") == "medical"
    day = F.col(date)
    people = (
        events.groupBy(key)
        .agg(
            F.coalesce(F.bool_or(is_excluded), F.lit(False)).alias("__out"),
            F.coalesce(F.bool_or(is_target), F.lit(False)).alias("is_case"),
            F.min(F.when(is_target, day)).alias(first_date),
            F.min(F.when(medical & ~F.coalesce(is_target, F.lit(False)), day)).alias("__m1"),
            F.min(F.when(medical, day)).alias("__m2"),
            F.min(day).alias("__m3"),
        )
        .filter(~F.col("__out"))
        .withColumn(
            "__reference",
            F.when(F.col("is_case"), F.col(first_date)).otherwise(
                F.coalesce("__m1", "__m2", "__m3")
            ),
        )
        .select(key, "is_case", first_date, "__reference")
    )
    members = sample_controls(cut_lineage(people), key, "is_case", ratio, seed=seed)
    joined = _finish(events, members, key, cohort_name.upper(), "NON_ED", cohort_name)
    gap = F.datediff(F.col("__reference"), day)
    return (
        joined.withColumn("days_to_target_event", gap)
        .filter(medical | F.col("days_to_target_event").between(0, window_days))
        .drop("__reference")
    )


def control_only_cohort(
    events: DataFrame,
    is_target: Column,
    key: str = "person",
    ratio: int = 5,
    average_targets: float | None = 1000,
    fallback: int = 5000,
    seed: str | int = 42,
    cohort_name: str = "opioid_ed",
    first_date: str = "first_target_date",
) -> DataFrame:
    """Controls alone, for a partition without cases: ``ratio`` times the average target count."""
    limit = int(ratio * average_targets) if average_targets else fallback
    people = (
        events.groupBy(key)
        .agg(F.coalesce(F.bool_or(is_target), F.lit(False)).alias("is_case"))
        .filter(~F.col("is_case"))
    )
    members = sample_controls(cut_lineage(people), key, "is_case", None, limit=limit, seed=seed)
    return events.join(members.select(key), key).withColumns(
        {
            "target": F.lit(0),
            "is_target_case": F.lit(0),
            "cohort_name": F.lit(cohort_name),
            "cohort": F.lit("NON_ED"),
            first_date: F.lit(None).cast("date"),
        }
    )


def exclude_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed (keys are non-null)."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def label_members(df: DataFrame, cases: DataFrame, controls: DataFrame, key: str) -> DataFrame:
    """Events of listed persons with their 0/1 label; a person listed twice is a case."""
    labelled = cases.select(key, F.lit(1).alias("is_target_case")).unionByName(
        controls.select(key, F.lit(0).alias("is_target_case"))
    )
    members = labelled.groupBy(key).agg(F.max("is_target_case").alias("is_target_case"))
    return df.join(members, key)


def cohort_ratio(
    cohort: DataFrame, key: str = "person", by: Sequence[str] = (), window_days: int = 30
) -> DataFrame:
    """Cases, controls, their ratio, and the events inside the look-back window."""
    people = cohort.groupBy(*by, key).agg(
        F.max("is_target_case").alias("is_case"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("days_to_target_event").between(0, window_days)).alias("in_window"),
        F.sum("days_to_target_event").alias("days"),
        F.count("days_to_target_event").alias("n_days"),
    )
    cases, controls = F.count_if(F.col("is_case") == 1), F.count_if(F.col("is_case") == 0)
    return people.groupBy(*by).agg(
        cases.alias("cases"),
        controls.alias("controls"),
        F.round(F.try_divide(controls, cases), 6).alias("control_case_ratio"),
        F.sum("events").alias("events"),
        F.sum("in_window").alias("events_in_window"),
        F.round(F.try_divide(F.sum("days"), F.sum("n_days")), 6).alias("avg_days_to_target"),
    )


def cohort_checks(
    cohorts: DataFrame, by: Sequence[str], key: str = "person", max_ratio: float = 5
) -> DataFrame:
    """Partitions that must be rebuilt: more than ``max_ratio`` controls per case, or no case."""
    people = cohorts.groupBy(*by, key).agg(F.max("is_target_case").alias("is_case"))
    sizes = people.groupBy(*by).agg(
        F.count_if(F.col("is_case") == 1).alias("cases"),
        F.count_if(F.col("is_case") == 0).alias("controls"),
    )
    ratio = F.try_divide(F.col("controls"), F.col("cases"))
    return sizes.withColumn("ratio", F.round(ratio, 6)).filter(
        F.col("ratio").isNull() | (F.col("ratio") > max_ratio)
    )


def cohort_exclusivity(
    cohort: DataFrame, events: DataFrame, is_excluded: Column, key: str = "person"
) -> DataFrame:
    """How many persons of a cohort carry an excluded event anywhere (must be 0)."""
    flagged = events.filter(is_excluded).select(key).distinct()
    return (
        cohort.select(key).distinct().join(flagged, key, "left_semi")
        .agg(F.count(F.lit(1)).alias("overlapping_persons"))
        .withColumn("passed", F.col("overlapping_persons") == 0)
    )


def important_item_events(
    df: DataFrame, items: DataFrame, slots: Sequence[str], item: str = "item"
) -> DataFrame:
    """Events in which any slot holds a listed item: one semi-join for all slots."""
    return rows_with_code(df, slots, items.select(F.col(item).alias("code")))


def model_events(
    cohort: DataFrame, items: DataFrame, slots: Sequence[str], key: str = "person",
    ratio: int = 5, seed: str | int = 42, item: str = "item",
) -> DataFrame:
    """Events on important items, with at most ``ratio`` controls per case among the persons
    that still have events. These are read for the persons and for the result, so they are checkpointed."""
    kept = cut_lineage(important_item_events(cohort, items, slots, item))
    people = kept.groupBy(key).agg((F.max("is_target_case") == 1).alias("is_case"))
    members = sample_controls(cut_lineage(people), key, "is_case", ratio, seed=seed)
    return kept.join(members.select(key), key)
