"""Parquet partitions, mapping dictionaries and metric files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careloom.functions.columns import col

# Fixed value: part files of an interrupted merge, never read.
PART_FILES = r"\.part_[^/]*\.parquet$"


def read_parquet_merge(
    spark: SparkSession, paths: Sequence[str], exclude_pattern: str | None = PART_FILES
) -> DataFrame:
    """Union by name of many Parquet files; files whose path matches the pattern are skipped.

    The files are listed first and only the others are opened, so a skipped file adds no column
    and may be broken. The list of paths is what Spark's own scan holds on the driver as well.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = listing.load(list(paths)).select("path").filter(F.col("path").endswith(".parquet"))
    if exclude_pattern:
        files = files.filter(~F.col("path").rlike(exclude_pattern))
    kept = [r["path"] for r in files.collect()]
    if not kept:
        return spark.range(0).select()  # no file is left to take columns from
    return spark.read.option("mergeSchema", True).parquet(*kept)


def read_partitions(
    spark: SparkSession, root: str, age_bands: Sequence[str] | None = None,
    years: Sequence[int] | None = None, band: str = "age_band", year: str = "event_year",
) -> DataFrame:
    """Partitioned table limited to bands and years by partition pruning."""
    df = spark.read.parquet(root)
    if age_bands:
        df = df.filter(F.col(band).isin(list(age_bands)))
    if years:
        df = df.filter(F.col(year).isin(list(years)))
    return df


def path_value(path: str | Column, key: str) -> Column:
    """Value of a key=value path part, null without one."""
    found = F.regexp_extract(col(path), f"(?:^|/){key}=([^/]*)(?:/|$)", 1)
    return F.nullif(F.url_decode(found), F.lit(""))


def path_part(path: str | Column, index: int) -> Column:
    """Part of the path, counted from the right by negative numbers."""
    return F.try_element_at(F.split(col(path), "/"), F.lit(index))


def partition_values_from_path(
    df: DataFrame, keys: Sequence[str], path: Column | None = None
) -> DataFrame:
    path = F.col("_metadata.file_path") if path is None else path
    return df.select("*", *[path_value(path, k).alias(k) for k in keys])


def load_mapping(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """(key, value) of many JSON objects, lower-cased; files later in the path order override.

    Each file is one JSON object, as dictionaries are edited by hand and small.
    """
    files = spark.read.text(glob, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path")
    )
    pairs = files.select("path", F.explode(F.from_json("value", "map<string,string>")))
    lowered = pairs.select(
        "path", F.lower(F.col("key")).alias("key"), F.lower(F.col("value")).alias("value")
    )
    return lowered.groupBy("key").agg(F.max_by("value", F.struct("path", "value")).alias("value"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a readable Parquet table lies at the path."""
    try:
        return len(spark.read.parquet(path).columns) > 0
    except AnalysisException:
        return False


def consolidate_metrics(
    spark: SparkSession, paths: str | list[str], keys: Sequence[str] = (
        "cohort_name", "age_band", "event_year")
) -> DataFrame:
    """Metric JSON files of many partitions as one table with the labels from their paths."""
    df = spark.read.json(paths)
    return partition_values_from_path(df, [k for k in keys if k not in df.columns])
