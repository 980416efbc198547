"""Data-quality checks as tables: one conditional aggregate per check family."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careloom.constants import AGE_BAND_LABELS
from careloom.functions.columns import age_band, flatten_code, parse_yyyymmdd
from careloom.operators.frequency import explode_slots, mid_frequency
from careloom.operators.ordering import top_n
from careloom.session import cut_lineage

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"


def _n() -> Column:
    return F.count(F.lit(1))


def _stack(df: DataFrame, by: Sequence[str], cols: Sequence[str], name: str) -> DataFrame:
    """Columns of a small result to (name, n) rows."""
    entries = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(c).cast("bigint").alias("n")) for c in cols]
    )
    return df.select(*by, F.inline(entries))


def schema_check(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Each expected or actual column: ok, missing or extra, and its filled and all rows.

    One scan of the actual columns; a missing one has no filled rows.
    """
    names = [*expected, *[c for c in df.columns if c not in expected]]
    filled = [F.count(F.col(f"`{c}`")) if c in df.columns else F.lit(0) for c in names]
    counts = df.agg(F.array(*filled).alias("filled"), _n().alias("rows"))
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.lit("missing" if c not in df.columns else "ok" if c in expected else "extra")
            .alias("status"),
            F.col("filled")[i].cast("bigint").alias("filled"), F.col("rows").alias("rows"),
        )
        for i, c in enumerate(names)
    ])
    return counts.select(F.inline(entries))


def structure_stats(df: DataFrame, key: str, band: str, year: str, date: str) -> DataFrame:
    """Rows, distinct persons, bands and years, and the date range.

    The rows are counted by (person, band, year) once; the distinct counts come from that table
    instead of copies of every row.
    """
    grouped = df.groupBy(key, band, year).agg(
        _n().alias("__n"), F.min(date).alias("__first"), F.max(date).alias("__last")
    )
    persons = grouped.groupBy(key).agg(
        F.sum("__n").alias("__n"), F.collect_set(band).alias("__bands"),
        F.collect_set(year).alias("__years"), F.min("__first").alias("__first"),
        F.max("__last").alias("__last"),
    )
    # bands and years are a few values; the sets of all persons merge map-side
    return persons.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count(key).alias("persons"),
        F.size(F.array_distinct(F.flatten(F.collect_set("__bands")))).cast("bigint").alias("bands"),
        F.size(F.array_distinct(F.flatten(F.collect_set("__years")))).cast("bigint").alias("years"),
        F.min("__first").alias("min_date"), F.max("__last").alias("max_date"),
    )


def null_check(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Null or blank values of each column: (column, n)."""
    counts = df.groupBy(*by).agg(
        *[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c)
          for c in cols]
    )
    return _stack(counts, by, cols, "column")


def date_check(
    df: DataFrame, date_text: str, year: str, lo: int = 2015, hi: int = 2025
) -> DataFrame:
    """Null dates, years out of range, and dates whose year is not the year column."""
    parsed = F.year(parse_yyyymmdd(date_text))
    counts = df.agg(
        F.count_if(F.col(date_text).isNull()).alias("null_dates"),
        F.count_if((F.col(year) < lo) | (F.col(year) > hi)).alias("year_out_of_range"),
        F.count_if(parsed != F.col(year)).alias("year_mismatch"),
    )
    return _stack(counts, [], counts.columns, "check")


def domain_check(df: DataFrame, c: str, allowed: Sequence = tuple(AGE_BAND_LABELS)) -> DataFrame:
    """Values outside the allowed ones, with their row counts."""
    bad = df.filter(F.col(c).isNotNull() & ~F.col(c).isin(list(allowed)))
    return bad.groupBy(F.col(c).alias("value")).agg(_n().alias("n"))


def frequency_inspection(df: DataFrame, c: str, n: int = 25) -> DataFrame:
    """The n most and least frequent values and the n + 1 around the middle rank."""
    freq = df.filter(F.col(c).isNotNull() & (F.trim(c) != "")).groupBy(c).agg(
        _n().alias("frequency")
    )
    high = top_n(freq, [F.col("frequency").desc(), F.col(c)], n)
    low = top_n(freq, [F.col("frequency"), F.col(c)], n)
    middle = mid_frequency(freq, c, n // 2).drop("frequency_rank")
    parts = [(high, "high"), (low, "low"), (middle, "middle")]
    out = None
    for part, label in parts:
        part = part.select(F.lit(label).alias("slice"), F.col(c).alias("value"), "frequency")
        out = part if out is None else out.unionByName(part)
    return out


def roll_up(checks: DataFrame, check: str = "check", passed: str = "passed") -> DataFrame:
    """PASS or FAIL over all checks, with the failed ones named."""
    issues = F.sort_array(F.collect_set(F.when(~F.col(passed), F.col(check))))
    return checks.agg(
        F.when(F.bool_and(passed), PASS).otherwise(FAIL).alias("overall_status"),
        _n().alias("total_validations"),
        F.count_if(F.col(passed)).alias("passing_validations"),
        F.array_join(issues, "; ").alias("critical_issues"),
    )


def stage_checks(
    df: DataFrame, expected: Sequence[str], critical: Sequence[str], date_text: str, year: str,
    band: str, bands: Sequence[str] = tuple(AGE_BAND_LABELS), lo: int = 2015, hi: int = 2025,
) -> DataFrame:
    """The four stage-one checks as (check, passed): schema, nulls, dates, bands."""
    missing = [c for c in expected if c not in df.columns]
    nulls = null_check(df, critical).agg(
        F.lit("missing_data").alias("check"), (F.sum("n") == 0).alias("passed")
    )
    dates = date_check(df, date_text, year, lo, hi).agg(
        F.lit("date_quality").alias("check"), (F.sum("n") == 0).alias("passed")
    )
    domain = domain_check(df, band, bands).agg(
        F.lit("age_bands").alias("check"), (_n() == 0).alias("passed")
    )
    schema = nulls.select(F.lit("schema").alias("check"), F.lit(not missing).alias("passed"))
    return schema.unionByName(nulls).unionByName(dates).unionByName(domain)


def blank_check(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Blank, empty and non-castable values per field; ``cols`` maps a field to its type."""
    out = []
    for c, dtype in cols.items():
        text = F.col(c).cast("string")
        cast = F.col(c).try_cast(dtype)
        out.append(
            F.struct(
                F.lit(c).alias("field"),
                _n().alias("total_rows"),
                F.count_if(text == " ").alias("blank_strings"),
                F.count_if(text == "").alias("empty_strings"),
                F.count_if(cast.isNull()).alias("non_castable"),
            ).alias(f"__{c}")
        )
    return df.agg(*out).select(F.inline(F.array(*[F.col(f"__{c}") for c in cols])))


def completeness(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of filled values per column in percent, and of rows labelled complete if known."""
    total = _n()
    filled = [
        F.round(F.count(c) * 100.0 / total, 6).alias(c) for c in cols
    ]
    extra = []
    if "data_quality_level" in df.columns:
        whole = F.count_if(F.col("data_quality_level") == "complete")
        extra = [F.round(whole * 100.0 / total, 6).alias("complete_pct")]
    return df.groupBy(*by).agg(total.alias("rows"), *filled, *extra)


# --- cohorts ------------------------------------------------------------------------------

COHORT_PARTITION = ("cohort_name", "age_band", "event_year")


def cohort_qa(
    cohort: DataFrame,
    by: Sequence[str] = COHORT_PARTITION,
    key: str = "person",
    age: str | None = "age",
    band: str = "age_band",
    year: str = "event_year",
    date: str = "event_date",
    cohort_names: Sequence[str] = ("opioid_ed", "ed_non_opioid"),
    slots: Sequence[str] = (),
    target_codes: Sequence[str] = (),
    critical: Sequence[str] = ("event_type",),
    metadata: Sequence[str] = ("cohort_name", "cohort", "target", "is_target_case"),
    first_date: str = "first_target_date",
    window_days: int = 30,
    ratio: tuple[float, float] = (4.5, 5.5),
) -> DataFrame:
    """Checks of each cohort partition: (partition, check, value, status).

    One pass counts everything per person first, so distinct persons need no second shuffle of the
    rows. Medical events may lie outside the look-back window; the first-date rule holds for cases
    only.
    """
    by = list(by)
    medical = F.col("event_type") == "medical"
    in_window = F.col("days_to_target_event").between(0, window_days)
    rules: dict[str, Column] = {
        "invalid_cohort_name": ~F.coalesce(F.col("cohort_name").isin(*cohort_names), F.lit(False)),
        "invalid_label": ~F.coalesce(F.col("is_target_case").isin(0, 1), F.lit(False)),
        "outside_window": ~medical & ~F.coalesce(in_window, F.lit(True)),
        "year_mismatch": F.year(date) != F.col(year),
        "null_dates": F.col(date).isNull(),
        "case_without_first_date": (F.col("is_target_case") == 1) & F.col(first_date).isNull(),
        "control_with_first_date": (F.col("is_target_case") == 0) & F.col(first_date).isNotNull(),
    }
    rules |= {f"null_{c}": F.col(c).isNull() for c in (key, *critical)}
    if age:
        rules["age_out_of_range"] = ~F.coalesce(F.col(age).between(1, 114), F.lit(False))
        rules["age_outside_band"] = age_band(age) != F.col(band)
    missing = [c for c in metadata if c not in cohort.columns]
    counts = {name: F.count_if(F.coalesce(rule, F.lit(False))) for name, rule in rules.items()}
    info = {f"target_code_{s}": F.count_if(F.coalesce(F.col(s).isin(*target_codes), F.lit(False)))
            for s in (slots if target_codes else ())}
    info |= {"medical_events": F.count_if(medical), "pharmacy_events": F.count_if(~medical),
             "rows": _n()}
    people = cohort.groupBy(*by, key).agg(
        *[c.alias(n) for n, c in {**counts, **info}.items()],
        F.max("is_target_case").alias("__hi"),
        F.min("is_target_case").alias("__lo"),
    )
    cases, controls = F.count_if(F.col("__hi") == 1), F.count_if(F.col("__hi") == 0)
    table = people.groupBy(*by).agg(
        *[F.sum(n).cast("double").alias(n) for n in (*counts, *info)],
        F.count_if(F.col("__hi") != F.col("__lo")).cast("double").alias("mixed_labels"),
        cases.cast("double").alias("cases"),
        controls.cast("double").alias("controls"),
        F.try_divide(controls, cases).alias("control_case_ratio"),
        F.lit(float(len(missing))).alias("missing_metadata_columns"),
    )

    def entry(name: str, status: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), F.round(name, 6).alias("value"),
                        status.alias("status"))

    zero = [*counts, "mixed_labels", "missing_metadata_columns"]
    rated = F.col("control_case_ratio")
    entries = [entry(n, F.when(F.col(n) == 0, PASS).otherwise(FAIL)) for n in zero]
    entries.append(
        entry("control_case_ratio",
              F.when(rated.between(*ratio), PASS).when(rated.isNull(), FAIL).otherwise(WARN))
    )
    entries += [entry(n, F.lit("INFO")) for n in (*info, "cases", "controls")]
    return table.select(*by, F.inline(F.array(*entries)))


def partition_status(checks: DataFrame, by: Sequence[str] = COHORT_PARTITION) -> DataFrame:
    """FAIL if any check of the partition fails, else WARN if any warns, else PASS."""
    failed, warned = (F.bool_or(F.col("status") == s) for s in (FAIL, WARN))
    return checks.groupBy(*by).agg(
        F.when(failed, FAIL).when(warned, WARN).otherwise(PASS).alias("status"),
        F.count_if(F.col("status") == FAIL).alias("failed_checks"),
        F.count_if(F.col("status") == WARN).alias("warnings"),
    )


def event_completeness(cohort: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Filled share of the columns per event type."""
    return completeness(cohort, cols, ["event_type"])


def year_consistency(df: DataFrame, date: str, year: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose date falls in their year, and their share."""
    match = F.count_if(F.year(date) == F.col(year))
    return df.groupBy(*by).agg(
        _n().alias("total_rows"),
        match.alias("matched_rows"),
        F.count_if(F.year(date) != F.col(year)).alias("mismatched_rows"),
        F.round(match / _n(), 6).alias("consistency_rate"),
    )


def partition_presence(df: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Every configured partition with its row count and whether it is there."""
    cells = df.sparkSession.range(1)
    for name, labels in grid.items():
        cells = cells.withColumn(name, F.explode(F.array(*[F.lit(v) for v in labels])))
    counts = df.groupBy(*grid).agg(_n().alias("rows"))
    out = cells.drop("id").join(counts, list(grid), "left").fillna(0, ["rows"])
    return out.withColumn("present", F.col("rows") > 0)


def qa_report(cohort: DataFrame, key: str = "person", drug: str = "drug_name") -> DataFrame:
    """Compact report of a cohort as (section, metric, value).

    The cohort is scanned once: rows are counted by (person, drug, event type), and all sections, the
    distinct counts among them, come from that table.
    """
    kind = F.col("event_type")
    fine = cut_lineage(cohort.groupBy(F.col(key).alias("k"), F.col(drug).alias("d"), kind.alias("e")).agg(
        _n().alias("n"), F.count_if(F.col("event_date").isNull()).alias("null_event_dates"),
        F.count_if(F.col("is_target_case").isNull()).alias("null_targets"), F.max("is_target_case").alias("c"),
    ))

    def total(condition: Column | None = None, name: str = "n") -> Column:
        picked = F.col(name) if condition is None else F.when(condition, F.col(name))
        return F.coalesce(F.sum(picked), F.lit(0))

    totals = fine.agg(
        total().alias("total_rows"), total(F.col("e") == "pharmacy").alias("drug_events"),
        total(F.col("d").isNotNull()).alias("non_null_drugs"), total(F.col("k").isNull()).alias("null_person_keys"),
        total(name="null_event_dates").alias("null_event_dates"), total(F.col("e").isNull()).alias("null_events"),
        total(name="null_targets").alias("null_targets"),
    )
    drugs = fine.select("d").distinct().agg(F.count("d").alias("distinct_drugs"))
    people = fine.groupBy("k").agg(F.max("c").alias("c")).agg(
        _n().alias("distinct_persons"), F.count_if(F.col("c") == 1).alias("target_persons"),
        F.count_if(F.col("c") == 0).alias("control_persons"),
    )
    out = fine.groupBy("e").agg(F.sum("n").alias("n")).select(F.lit("events").alias("section"), F.col("e").alias("metric"), "n")
    for section, table in (("totals", totals), ("totals", drugs), ("persons", people)):
        out = out.unionByName(_stack(table, [], table.columns, "metric").select(F.lit(section).alias("section"), "metric", "n"))
    return out


def trace_code(
    stages: Mapping[str, DataFrame], code: str, slots: Sequence[str], key: str = "person"
) -> DataFrame:
    """Rows and persons that carry a code (in any spelling) at each stage."""
    wanted = "".join(ch for ch in code.upper() if ch.isalnum())
    out = None
    for name, df in stages.items():
        found = explode_slots(df, slots, [key]).filter(flatten_code("code") == wanted)
        row = found.agg(
            F.lit(name).alias("stage"), _n().alias("code_rows"),
            F.countDistinct(key).alias("persons"),
        )
        out = row if out is None else out.unionByName(row)
    return out
