"""Isotonic regression by pooling adjacent violators, distributed.

Rows are pooled to one (score, sum, weight) per distinct score by a combining aggregate. Pools are
then merged inside range partitions, and the partitions are halved until no border between them is
violated: mostly that holds after one or two rounds, and the last round at the latest sees all
pools. A task so only ever holds pools, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careloom.operators.ordering import with_bucket
from careloom.session import cut_lineage

_POOL = "lo double, hi double, total double, weight double"


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each pool with those before it whose mean is not below its own."""
    stack: list[tuple[float, float, float, float]] = []
    names = ["lo", "hi", "total", "weight"]
    for batch in batches:
        for lo, hi, total, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while stack and stack[-1][2] * weight >= total * stack[-1][3]:
                before = stack.pop()
                lo, total, weight = before[0], before[2] + total, before[3] + weight
            stack.append((lo, hi, total, weight))
    if stack:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*stack, strict=True)], names=names)


def _violated(pools: DataFrame) -> bool:
    """Whether a partition's first mean is not above the last mean of the one before it."""
    mean = F.col("total") / F.col("weight")
    ends = pools.groupBy("part").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
    # one row per partition
    border = ends.select("first", F.lag("last").over(Window.orderBy("part")).alias("before"))
    return not border.filter("before >= first").isEmpty()


def isotonic_pools(df: DataFrame, label: str, score: str, partitions: int | None = None) -> DataFrame:
    """(lo, hi, total, weight) of the pools of a rising fit; ``total / weight`` is a pool's value.

    Rows with a null label or score are left out; an empty table has no pools.
    """
    value, mark = F.col(score).cast("double"), F.col(label).cast("double")
    pools = df.filter(value.isNotNull() & mark.isNotNull()).groupBy(value.alias("lo")).agg(
        F.sum(mark).alias("total"), F.count(F.lit(1)).cast("double").alias("weight")
    ).select("lo", F.col("lo").alias("hi"), "total", "weight")
    pools = cut_lineage(pools)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        ranged = pools.repartitionByRange(n, "lo").sortWithinPartitions("lo")
        merged = ranged.mapInArrow(_pooled, _POOL).withColumn("part", F.spark_partition_id())
        merged = cut_lineage(merged)
        pools = merged.drop("part")
        if n == 1 or not _violated(merged):
            return pools
        n = (n + 1) // 2


def with_pool_value(scores: DataFrame, pools: DataFrame, score: str, out: str) -> DataFrame:
    """Each distinct score with the value of its pool; scores between pools are interpolated.

    Scores and pool ends meet in one range partitioning; a partition's rows before its first pool
    end (after its last one) take the nearest end of the partitions before (after) it from a small table.
    """
    value = (F.col("total") / F.col("weight")).alias("v")
    ends = pools.select(F.explode(F.array("lo", "hi")).alias("s"), value).distinct()
    both = ends.select("s", "v").unionByName(scores.select(F.col(score).alias("s"), F.lit(None).cast("double").alias("v")))
    cut = with_bucket(both.withColumn("end", F.when(F.col("v").isNotNull(), F.struct("s", "v"))), [], [F.col("s")], None)
    edges = cut.groupBy("__bucket").agg(F.min("end").alias("first"), F.max("end").alias("last"))
    # one row per partition; upwards and downwards, so that every frame only grows
    up, down = (Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.col("__bucket"), F.col("__bucket").desc()))
    edges = edges.select("__bucket", F.last("last", True).over(up).alias("__before"), F.last("first", True).over(down).alias("__after"))
    rising, falling = (Window.partitionBy("__bucket").orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow) for c in (F.col("s"), F.col("s").desc()))
    low, high = F.last("end", True).over(rising), F.last("end", True).over(falling)
    near = cut.join(edges, "__bucket").select("s", "v", F.coalesce(low, "__before").alias("low"), F.coalesce(high, "__after").alias("high"))
    share = F.try_divide(F.col("s") - F.col("low.s"), F.col("high.s") - F.col("low.s"))
    between = F.when(F.col("low.v") == F.col("high.v"), F.col("low.v")).otherwise(F.col("low.v") + share * (F.col("high.v") - F.col("low.v")))
    value = F.when(F.col("low").isNull(), F.col("high.v")).when(F.col("high").isNull(), F.col("low.v")).otherwise(between)
    return near.filter("v is null").select(F.col("s").alias(score), value.alias(out))
