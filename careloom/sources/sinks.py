"""Writers: partitioned, latest-copy, cohort and JSON outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careloom.sources.tables import exists


def write_partitioned(
    df: DataFrame, root: str, keys: Sequence[str] = ("age_band", "event_year"),
    if_exists: str = "overwrite", sort: Sequence[str] = (), compression: str = "zstd",
) -> bool:
    """Parquet partitioned by the keys; only the partitions at hand are replaced.

    With ``if_exists='skip'`` the partitions that are there already stay as they are and only
    new ones are written. The rebalance hint lets adaptive execution merge small partitions and
    split a hot one over several tasks and files. Returns whether it wrote.
    """
    if if_exists == "skip" and exists(df.sparkSession, root):
        # partition values only: no column of the files is read
        there = df.sparkSession.read.parquet(root).select(*keys).distinct()
        there = there.select(*[F.col(k).cast(df.schema[k].dataType).alias(f"__{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        df = df.join(there, same, "left_anti")
        if df.isEmpty():
            return False
    rows = df.hint("rebalance", *keys)
    if sort:
        rows = rows.sortWithinPartitions(*keys, *sort)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", compression)
        .partitionBy(*keys)
        .parquet(root)
    )
    return True


def write_cohort(df: DataFrame, root: str, if_exists: str = "overwrite") -> bool:
    """Cohort table by cohort, year and band, Snappy-compressed."""
    keys = ("cohort_name", "event_year", "age_band")
    return write_partitioned(df, root, keys, if_exists, compression="snappy")


def write_latest(df: DataFrame, parquet_path: str, csv_path: str | None = None) -> None:
    """Replace the latest copy, and its CSV twin when asked for."""
    df.write.mode("overwrite").parquet(parquet_path)
    if csv_path:
        df.write.mode("overwrite").option("header", True).csv(csv_path)


def write_json_records(df: DataFrame, path: str) -> None:
    """One JSON object per row: itemsets, rules, metrics."""
    df.write.mode("overwrite").json(path)
