"""Column naming, optional columns and row-quality labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careloom.constants import ORDINALS
from careloom.functions.columns import col


def snake_case(name: str) -> str:
    """'2nd ICD Diagnosis Code' -> 'two_icd_diagnosis_code'."""
    words = re.sub(r"\s+", "_", name.strip().lower())
    ordinal = re.match(r"(\d{1,2})(?:st|nd|rd|th)(?=_|$)", words)
    if ordinal and 1 <= int(ordinal[1]) <= len(ORDINALS):
        words = ORDINALS[int(ordinal[1]) - 1] + words[ordinal.end():]
    words = re.sub("_{2,}", "_", words).strip("_")
    return f"_{words}" if words[:1].isdigit() else words


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def select_or_null(df: DataFrame, name: str, *alternatives: str, dtype: str = "string") -> Column:
    """First of the columns that exists, under ``name``; else a typed null."""
    for candidate in (name, *alternatives):
        if candidate in df.columns:
            return F.col(f"`{candidate}`").alias(name)
    return F.lit(None).cast(dtype).alias(name)


def null_filled_select(
    df: DataFrame, columns: Sequence[str], overrides: Mapping[str, Column] | None = None
) -> DataFrame:
    """Project to a standard column order; missing columns become null."""
    overrides = overrides or {}
    return df.select(
        *[overrides[c].alias(c) if c in overrides else select_or_null(df, c) for c in columns]
    )


def quality_level(
    df: DataFrame, fields: Sequence[str], required: Iterable[str]
) -> DataFrame:
    """Number of missing demographics, and 'complete' when the required ones are all there."""
    missing = sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))
    have_all = F.lit(True)
    for f in required:
        have_all = have_all & F.col(f).isNotNull()
    return df.withColumns(
        {
            "total_missing_fields": missing,
            "data_quality_level": F.when(have_all, "complete").otherwise("partial"),
        }
    )


def repair_shifted_fields(df: DataFrame) -> DataFrame:
    """Adverse-event rows whose fields slid by one: the age sits in the gender field and so on."""
    slid_age = F.col("gndr_cod").try_cast("int").cast("double")
    return df.withColumns(
        {
            "age": F.coalesce(F.col("age"), slid_age),
            "gndr_cod": F.when(F.col("age") == slid_age, F.col("wt_cod")).otherwise(
                F.col("gndr_cod")
            ),
            "age_cod": F.when(F.col("age") < 100, "YR").otherwise(F.col("age_cod")),
        }
    )


def valid_reports(
    df: DataFrame, start: str, event: str, outcome: str, max_days: int = 30,
    outcomes: Sequence[str] = ("HO", "DE"),
) -> DataFrame:
    """Reports with two full dates, a serious outcome and 0 < duration < max_days."""
    first, last = F.try_to_date(col(start), "yyyyMMdd"), F.try_to_date(col(event), "yyyyMMdd")
    days = F.datediff(last, first)
    return (
        df.filter((F.length(start) == 8) & (F.length(event) == 8))
        .filter(F.col(outcome).isin(*outcomes))
        .withColumns({"drug_date": first, "event_date": last, "duration": days})
        .filter((F.col("duration") > 0) & (F.col("duration") < max_days))
    )


def usable_report_drugs(df: DataFrame, drug: str, max_length: int = 20) -> DataFrame:
    """Drug names shorter than the limit and without an embedded eight-digit number."""
    return df.filter(
        (F.length(drug) < max_length) & ~F.col(drug).rlike("[^0-9]([0-9]{8})[^0-9]")
    )
