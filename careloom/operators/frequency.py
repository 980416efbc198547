"""Frequency, co-occurrence, trend and chart tables.

Counts are taken once at the finest grain with map-side combine; coarser tables are rolled up from
that small result. Ranks and medians over frequencies work on frequency histograms.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careloom.functions.columns import col, matches_variant
from careloom.operators.ordering import top_n, with_neighbour, with_position


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def explode_slots(df: DataFrame, slots: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per filled slot: kept columns, 1-based ``position``, ``slot`` name and ``code``."""
    entries = F.array(
        *[F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("slot"),
                   F.col(s).cast("string").alias("code")) for i, s in enumerate(slots)]
    )
    return (
        df.select(*keep, F.explode(entries).alias("__e"))
        .select(*keep, "__e.position", "__e.slot", "__e.code")
        .filter(_present("code"))
    )


def code_frequency(
    df: DataFrame, slots: Sequence[str], period: str, band: str | None = None
) -> DataFrame:
    """Counts per code by period, by (period, slot) and by (period, band) in one pass.

    ``grain`` names the grouping of each row.
    """
    dims = [period, "position", *([band] if band else []), "code"]
    keep = [c for c in (period, band) if c]
    fine = explode_slots(df, slots, keep).groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    sets = [[period, "code"], [period, "position", "code"]]
    names = {"period": 0, "period_position": 1}
    if band:
        sets.append([period, band, "code"])
        names["period_band"] = 2
    rolled = fine.groupingSets(sets, *dims).agg(
        F.sum("n").alias("frequency"),
        F.grouping("position").alias("__p"),
        *([F.grouping(band).alias("__b")] if band else [F.lit(1).alias("__b")]),
    )
    grain = (
        F.when(F.col("__p") == 0, "period_position")
        .when(F.col("__b") == 0, "period_band")
        .otherwise("period")
    )
    return rolled.select(grain.alias("grain"), *dims, "frequency")


def combine_counts(df: DataFrame, keys: Sequence[str], n: str = "frequency") -> DataFrame:
    """Partial counts of several partitions summed to final ones."""
    return df.groupBy(*keys).agg(F.sum(n).alias(n))


def item_frequency(df: DataFrame, item: str, period: str) -> DataFrame:
    return df.filter(_present(item)).groupBy(period, item).agg(
        F.count(F.lit(1)).alias("frequency")
    )


def frequent(
    freq: DataFrame, item: str, period: str, threshold: int = 1000, n: int = 20,
    side: str = "above",
) -> DataFrame:
    """Most frequent items above (or below) a total, with the number of periods they occur in."""
    totals = freq.groupBy(item).agg(
        F.sum("frequency").alias("total_frequency"),
        F.countDistinct(period).alias("years_present"),
    )
    total = F.col("total_frequency")
    kept = totals.filter(total > threshold if side == "above" else total < threshold)
    return top_n(kept, [total.desc(), F.col(item)], n)


def frequency_summary(freq: DataFrame, item: str, period: str) -> DataFrame:
    """Distinct items, combinations and spread of the frequencies.

    The median is read from the histogram of frequencies, which has far fewer rows.
    """
    histogram = freq.groupBy("frequency").agg(F.count(F.lit(1)).alias("__c"))
    spread = histogram.agg(
        F.sum("__c").alias("total_combinations"),
        F.min("frequency").alias("min_frequency"),
        F.max("frequency").alias("max_frequency"),
        F.round(F.sum(F.col("frequency") * F.col("__c")) / F.sum("__c"), 2).alias("avg_frequency"),
        F.round(F.percentile("frequency", 0.5, F.col("__c")), 2).alias("median_frequency"),
    )
    names = freq.agg(
        F.countDistinct(item).alias("unique_items"),
        F.countDistinct(period).alias("periods_covered"),
    )
    return names.withColumns({c: spread.select(c).scalar() for c in spread.columns})


def yearly_trend(freq: DataFrame, item: str, period: str, top: int = 10) -> DataFrame:
    """Change against the previous period for the top items (windows run on the counts only)."""
    totals = freq.groupBy(item).agg(F.sum("frequency").alias("__t"))
    best = top_n(totals, [F.col("__t").desc(), F.col(item)], top).select(item)
    by_item = Window.partitionBy(item).orderBy(period)
    previous = F.lag("frequency").over(by_item)
    change = (F.col("frequency") - F.col("prev_frequency")) * 100.0 / F.col("prev_frequency")
    return (
        freq.join(best, item, "left_semi")
        .withColumn("prev_frequency", previous)
        .withColumn("pct_change", F.round(change, 2))
    )


def mid_frequency(freq: DataFrame, item: str, half_width: int = 12) -> DataFrame:
    """Items whose frequency rank lies around the middle: n // 2 plus or minus ``half_width``.

    Ranks come from per-frequency offsets; items of equal frequency are ranked by name.
    """
    ranked = with_position(
        freq.withColumn("__desc", -F.col("frequency")), [], [F.col("__desc"), F.col(item)],
        F.struct(F.col("__desc"), F.substring(item, 1, 2)), "frequency_rank",
    )
    n = freq.agg(F.floor(F.count(F.lit(1)) / 2).alias("n")).scalar()
    return ranked.filter(F.abs(F.col("frequency_rank") - n) <= half_width).drop("__desc")


def conditional_distinct(
    df: DataFrame, key: str, conditions: Mapping[str, Column], by: Sequence[str]
) -> DataFrame:
    """Distinct keys that meet each condition, per group."""
    people = df.groupBy(*by, key).agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in conditions.items()]
    )
    return people.groupBy(*by).agg(*[F.count_if(F.col(n)).alias(n) for n in conditions])


def target_average_stats(
    counts: DataFrame, value: str, by: Sequence[str], grid: Mapping[str, Sequence]
) -> DataFrame:
    """Statistics of a count over a dense grid of partitions; absent partitions count 0.

    The grid is the product of configured labels, so its row count is fixed by the caller. The
    "median" is the upper middle element of the non-zero counts.
    """
    cells = counts.sparkSession.range(1)
    for name in by:
        labels = F.array(*[F.lit(v) for v in grid[name]])
        cells = cells.withColumn(name, F.explode(labels))
    dense = cells.drop("id").join(counts.select(*by, value), list(by), "left")
    n = F.coalesce(F.col(value), F.lit(0))
    present = F.when(n > 0, n)
    ordered = F.sort_array(F.collect_list(present))
    middle = F.try_element_at(ordered, (F.size(ordered) / 2).cast("int") + 1)
    return dense.agg(
        F.count(F.lit(1)).alias("total_partitions"),
        F.count(present).alias("partitions_with_targets"),
        F.count_if(n == 0).alias("partitions_with_zero"),
        F.round(F.coalesce(F.avg(present), F.lit(0.0)), 6).alias("average"),
        F.coalesce(middle, F.lit(0)).alias("median"),
        F.coalesce(F.min(present), F.lit(0)).alias("min"),
        F.coalesce(F.max(present), F.lit(0)).alias("max"),
    )


def polypharmacy(df: DataFrame, drugs: str, min_reports: int = 2) -> DataFrame:
    """Drug combinations reported more than once, with their size."""
    return (
        df.groupBy(F.sort_array(col(drugs)).alias("drugs"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") >= min_reports)
        .withColumn("polypharmacy", F.size("drugs"))
    )


def duration_stats(df: DataFrame, duration: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, extremes and median of whole-day durations, read from their histogram."""
    histogram = df.groupBy(*by, duration).agg(F.count(F.lit(1)).alias("__c"))
    d, c = F.col(duration), F.col("__c")
    known = F.when(d.isNotNull(), c)
    return histogram.groupBy(*by).agg(
        F.sum(c).alias("n"),
        F.round(F.try_divide(F.sum(d * c), F.sum(known)), 6).alias("avg_duration"),
        F.min(d).alias("min_duration"),
        F.max(d).alias("max_duration"),
        F.percentile(d, 0.5, c).alias("median_duration"),
    )


def heavy_users(df: DataFrame, key: str, min_rows: int = 100) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_rows)


def cluster_profile(df: DataFrame, cluster: str, item: str, k: int = 10) -> DataFrame:
    """Top k items of each cluster with their counts.

    Each cluster's items are ranked in (cluster, frequency) buckets, so no cluster's vocabulary
    is sorted as a whole by one task.
    """
    counts = df.groupBy(cluster, item).agg(F.count(F.lit(1)).alias("n"))
    ranked = with_position(
        counts.withColumn("__desc", -F.col("n")), [cluster], [F.col("__desc"), F.col(item)],
        F.col("__desc"), "item_rank",
    )
    return ranked.filter(F.col("item_rank") <= k).drop("__desc")


def group_counts(df: DataFrame, keys: Sequence[str], person: str | None = None) -> DataFrame:
    """Rows (and distinct persons) per group."""
    if person is None:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    people = df.groupBy(*keys, person).agg(F.count(F.lit(1)).alias("__c"))
    return people.groupBy(*keys).agg(
        F.sum("__c").alias("n"), F.count(person).alias("persons")
    )


def null_share(df: DataFrame, c: str, by: Sequence[str]) -> DataFrame:
    """Rows with a null or empty value per group, and their share."""
    empty = F.count_if(F.col(c).isNull() | (F.trim(c) == ""))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        empty.alias("n_empty"),
        F.round(empty / F.count(F.lit(1)), 6).alias("empty_share"),
    )


def column_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Value frequencies of many columns in one scan."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
          for c in cols]
    )
    return (
        df.select(*by, F.explode(entries).alias("__e"))
        .groupBy(*by, "__e.column", "__e.value")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def range_bucket(value: str | Column, edges: Sequence[float]) -> Column:
    """Label 'lo-hi' of the half-open range that holds the value, null outside all of them."""
    v = col(value)
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when((v >= lo) & (v < hi), f"{lo}-{hi}").otherwise(out)
    return out


def bucket_counts(
    df: DataFrame, value: str, edges: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    bucketed = df.withColumn("bucket", range_bucket(value, edges))
    return bucketed.filter(F.col("bucket").isNotNull()).groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("n")
    )


def co_occurrence(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_item: str,
    right_item: str,
    top_left: int = 25,
    top_right: int = 25,
    period: str | None = None,
) -> DataFrame:
    """Counts of (left item, right item) row pairs that share the ``by`` key.

    Only the top items of each side take part, which is the report's definition. Each side is
    first counted per (key, item); a key then yields at most top_left x top_right products, no
    matter how many rows it holds.
    """

    def reduced(df: DataFrame, item: str, top: int, n: str) -> DataFrame:
        rows = df.filter(_present(item))
        totals = rows.groupBy(item).agg(F.count(F.lit(1)).alias("__t"))
        best = top_n(totals, [F.col("__t").desc(), F.col(item)], top).select(item)
        counts = rows.join(best, item, "left_semi").groupBy(*by, item)
        return counts.agg(F.count(F.lit(1)).alias(n))

    pairs = reduced(left, left_item, top_left, "__l").join(
        reduced(right, right_item, top_right, "__r"), list(by)
    )
    keys = [*([period] if period else []), left_item, right_item]
    return pairs.groupBy(*keys).agg(F.sum(F.col("__l") * F.col("__r")).alias("frequency"))


def self_pairs(
    df: DataFrame, by: Sequence[str], item: str, selected: DataFrame, period: str | None = None
) -> DataFrame:
    """Unordered pairs of different items that occur under the same key, counted once per key.

    ``selected`` is the list of items that the chart shows; it bounds the pairs of a key, however
    many rows the key holds. Repeated items of a key are merged before the join.
    """
    rows = df.filter(_present(item)).join(selected.select(item).distinct(), item, "left_semi")
    items = rows.select(*by, F.col(item).alias("item_a")).distinct()
    others = items.withColumnRenamed("item_a", "item_b")
    keys = [period] if period else []
    return (
        items.join(others, list(by))
        .filter("item_a < item_b")
        .groupBy(*keys, "item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def pivot_counts(
    df: DataFrame, row: str, column: str, value: str, columns: Sequence | None = None
) -> DataFrame:
    """Row by column table of sums, 0 where nothing occurs."""
    pivoted = df.groupBy(row).pivot(column, columns).agg(F.sum(value))
    return pivoted.fillna(0)


def top_bars(freq: DataFrame, item: str, n: int = 20) -> DataFrame:
    totals = freq.groupBy(item).agg(F.sum("frequency").alias("frequency"))
    return top_n(totals, [F.col("frequency").desc(), F.col(item)], n)


def variant_trend(
    freq: DataFrame, code: str, period: str, wanted: str, mode: str = "startswith"
) -> DataFrame:
    """Yearly counts of the spellings of one code, with each spelling's share of the year."""
    rows = freq.filter(matches_variant(code, wanted, mode))
    counts = rows.groupBy(period, code).agg(F.sum("frequency").alias("frequency"))
    # Spellings of one code: a handful of rows per period.
    total = F.sum("frequency").over(Window.partitionBy(period))
    return counts.withColumn("share", F.round(F.col("frequency") / total, 6))


def day_gaps(
    df: DataFrame, key: str, ts: str, order: Sequence[str], out: str = "gap_days",
    bucket: Column | None = None,
) -> DataFrame:
    """Days since the previous event of the key, safe for keys of any size."""
    with_prev = with_neighbour(df, [key], order, bucket, ts, "__prev", step=-1)
    micros = F.timestamp_diff("MICROSECOND", F.col("__prev"), F.col(ts))
    return with_prev.withColumn(out, micros / 86_400_000_000).drop("__prev")
