"""Positions, neighbours and top-k that survive a hot key.

A plain window over ``partitionBy(key)`` sends all rows of one key to one task. Here every key is
cut into buckets that follow the sort order (a day, an hour, a hash prefix). Rows are numbered
inside (key, bucket), and a small per-bucket count table, built with map-side combine, supplies
the offset. A key that holds a third of all rows is then spread over all its buckets.

Where one bucket of one key can itself be hot (a placeholder person on a default date), callers
give no bucket: the rows are then range-partitioned by key and order, and the partition is the bucket.

Null keys are a key of their own, and null buckets and null times come first; no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careloom.session import cut_lineage

_BUCKET = "__bucket"


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns of the same names in which null matches null."""
    names = {c: f"__on_{i}" for i, c in enumerate(on)}
    other = right.withColumnsRenamed(names)
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return left.join(other, same).drop(*names.values())


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows range-partitioned by key and order, and checkpointed; :func:`range_bucket` is then a bucket.

    Rows that tie in the order are parted by a hash of their values, so that a tie isn't hot either.
    """
    values = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    return cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order, F.xxhash64(*values)))


def range_bucket() -> Column:
    """The bucket of rows that :func:`ranged` has laid out."""
    return F.spark_partition_id()


def with_bucket(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None
) -> DataFrame:
    """Adds the bucket; without one, the number of a range partition by key and order.

    Range partitions are checkpointed: counting and numbering must see the same ones.
    """
    return df.withColumn(_BUCKET, bucket) if bucket is not None else ranged(df, keys, order).withColumn(_BUCKET, range_bucket())


def hash_text(seed: str | int, *cols: str) -> Column:
    """Portable, seeded sort key: md5 of 'seed:value[:value...]'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_bucket(hashed: Column) -> Column:
    """First three hex digits: at most 4096 buckets, in hash order."""
    return F.substring(hashed, 1, 3)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column | None, out: str
) -> DataFrame:
    """1-based position of each row inside its key.

    ``bucket`` must not decrease along ``order``. With no keys the rows get one global position;
    the bucket table is then the only thing one task sees.
    """
    keys = list(keys)
    cut = with_bucket(df, keys, order, bucket)
    counts = cut.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    earlier = (
        Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *keys, _BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    return (
        null_safe_join(cut, offsets, [*keys, _BUCKET])
        .withColumn(out, F.col("__before") + F.row_number().over(inside))
        .drop(_BUCKET, "__before")
    )


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | None,
    value: str | Column,
    out: str,
    step: int = 1,
) -> DataFrame:
    """Value of the next (``step=1``) or previous (``step=-1``) row of the key.

    Inside a bucket this is a plain lead or lag; the edge row takes the first (last) value of the
    neighbouring bucket from a small table.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    cut = with_bucket(df, keys, [F.col(c) for c in order], bucket)
    rank = F.struct(*[F.col(c) for c in order])
    edge = F.min_by(F.struct(value.alias("v")), rank) if step > 0 else F.max_by(
        F.struct(value.alias("v")), rank
    )
    edges = cut.groupBy(*keys, _BUCKET).agg(edge.alias("__edge"))
    across = Window.partitionBy(*keys).orderBy(_BUCKET)
    shift = F.lead if step > 0 else F.lag
    edges = edges.select(*keys, _BUCKET, shift("__edge").over(across).alias("__edge"))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*[F.col(c) for c in order])
    here = shift(F.struct(value.alias("v"))).over(inside)
    return (
        null_safe_join(cut, edges, [*keys, _BUCKET])
        .withColumn(out, F.coalesce(here, F.col("__edge"))["v"])
        .drop(_BUCKET, "__edge")
    )


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column | None,
    totals: dict[str, str],
) -> DataFrame:
    """Running sums up to and including each row: ``totals`` maps new names to value columns."""
    keys = list(keys)
    cut = with_bucket(df, keys, order, bucket)
    sums = cut.groupBy(*keys, _BUCKET).agg(
        *[F.sum(v).alias(f"__{name}") for name, v in totals.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = sums.select(
        *keys,
        _BUCKET,
        *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in totals],
    )
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = null_safe_join(cut, sums, [*keys, _BUCKET])
    for name, value in totals.items():
        out = out.withColumn(name, F.col(f"__{name}") + F.sum(value).over(inside))
    return out.drop(_BUCKET, *[f"__{n}" for n in totals])


def top_n(df: DataFrame, by: Sequence[Column], n: int) -> DataFrame:
    """The n first rows; each task keeps n rows before the merge."""
    return df.orderBy(*by).limit(n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in ``order``, as a combining aggregate instead of a window."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.first(F.struct(*keys))
    picked = df.groupBy(*keys).agg(best.alias("__row"))
    return picked.select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def sample_keys(df: DataFrame, key: str, n: int | Column, seed: str | int = 42) -> DataFrame:
    """Reproducible sample of n distinct keys: the n smallest seeded hashes."""
    people = df.select(key).distinct().withColumn("__h", hash_text(seed, key))
    ranked = with_position(
        people, [], [F.col("__h"), F.col(key)], hash_bucket(F.col("__h")), "sample_rank"
    )
    return ranked.filter(F.col("sample_rank") <= n).drop("__h")
