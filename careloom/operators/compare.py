"""Before/after comparison of totals and keyed snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careloom.operators.ordering import first_per_key


def compare_totals(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Totals per key in both tables and their difference; a missing key counts 0.

    Both sides are summed in one combined aggregate, so no outer join is needed.
    """
    tagged = a.select(key, F.col(value).alias("__o"), F.lit(0).alias("__u")).unionByName(
        b.select(key, F.lit(0).alias("__o"), F.col(value).alias("__u"))
    )
    sums = tagged.groupBy(key).agg(
        F.coalesce(F.sum("__o"), F.lit(0)).alias("original"),
        F.coalesce(F.sum("__u"), F.lit(0)).alias("updated"),
    )
    return sums.withColumn("delta", F.col("updated") - F.col("original"))


def snapshot_diff(
    a: DataFrame, b: DataFrame, key: str, cols: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Keys added, removed or changed between two snapshots, and the columns that changed.

    Of a duplicated key the first row in ``order`` counts (all columns by default).
    """
    order = list(order or cols)
    one_a, one_b = (first_per_key(x.select(key, *cols), [key], order) for x in (a, b))
    left = one_a.select(key, F.struct(*cols).alias("__a"))
    right = one_b.select(key, F.struct(*cols).alias("__b"))
    both = left.join(right, key, "full")
    changed = F.array_compact(
        F.array(*[
            F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in cols
        ])
    )
    status = (
        F.when(F.col("__a").isNull(), "added")
        .when(F.col("__b").isNull(), "removed")
        .when(F.size(changed) > 0, "changed")
    )
    return (
        both.withColumn("status", status)
        .withColumn("changed_columns", F.when(F.col("status") == "changed",
                                              F.array_join(changed, ",")))
        .filter(F.col("status").isNotNull())
        .select(key, "status", "changed_columns")
    )
