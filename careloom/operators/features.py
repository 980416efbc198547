"""Person-item features, splits and the assembled feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careloom.functions.columns import is_excluded_code
from careloom.operators.frequency import explode_slots
from careloom.operators.ordering import hash_bucket, hash_text, with_position
from careloom.session import code_list, cut_lineage


def patient_items(
    cohort: DataFrame, key: str, slots: Sequence[str], excluded: Sequence[str] = (),
    min_persons: int = 25, train: DataFrame | None = None, drop_containing: bool = False,
) -> DataFrame:
    """(key, item, n) of the items that at least ``min_persons`` training persons have.

    Without ``train`` the cohort itself decides which items are frequent. ``drop_containing``
    also drops items that merely contain an excluded word.
    """

    def counted(df: DataFrame) -> DataFrame:
        rows = explode_slots(df, slots, [key]).select(key, F.col("code").alias("item"))
        if drop_containing:
            rows = rows.filter(~is_excluded_code("item", excluded))
        elif excluded:
            rows = rows.filter(~F.col("item").isin(list(excluded)))
        return rows.groupBy(key, "item").agg(F.count(F.lit(1)).alias("n"))

    rows = counted(cohort)
    basis = rows if train is None else counted(train)
    frequent = basis.groupBy("item").agg(F.count(key).alias("persons"))
    frequent, _ = code_list(frequent.filter(F.col("persons") >= min_persons).select("item"))
    return rows.join(frequent, "item", "left_semi")


def feature_matrix(
    items: DataFrame, persons: DataFrame, key: str, columns: Sequence[str], mode: str = "count"
) -> DataFrame:
    """One row per person and one column per listed item.

    ``count`` holds the number of rows, 0 without any; ``categorical`` holds the item's name or
    ''. The columns are listed by the caller, so the width of the table is bounded.
    """
    value = F.col("n") if mode == "count" else F.col("item")
    picks = [F.max(F.when(F.col("item") == c, value)).alias(c) for c in columns]
    wide = items.filter(F.col("item").isin(list(columns))).groupBy(key).agg(*picks)
    empty = 0 if mode == "count" else ""
    return persons.select(key).distinct().join(wide, key, "left").fillna(empty, list(columns))


def sparse_features(items: DataFrame, persons: DataFrame, key: str) -> DataFrame:
    """One row per person over the whole vocabulary: sorted item numbers and their counts.

    Numbers are ranks in the sorted vocabulary, from 0. A person without items has empty arrays;
    no column per item is formed, so the vocabulary may be of any size.
    """
    words = items.select("item").distinct()
    ranked = with_position(words, [], [F.col("item")], None, "__r")
    ids = ranked.select("item", (F.col("__r") - 1).alias("__i"))
    pairs = F.sort_array(F.collect_list(F.struct("__i", "n")))
    rows = items.join(ids, "item").groupBy(key).agg(pairs.alias("__p"))
    out = persons.select(key).distinct().join(rows, key, "left")
    empty = F.array().cast("array<bigint>")
    return out.select(
        key, F.coalesce(F.col("__p.__i"), empty).alias("indices"),
        F.coalesce(F.col("__p.n"), empty).alias("values"),
    )


def sparse_categories(items: DataFrame, persons: DataFrame, key: str, value: str = "item") -> DataFrame:
    """One row per person over the whole vocabulary: sorted item numbers, the level and the value of each.

    The categorical form of :func:`sparse_features`: an item's category is its ``value``, its name unless
    another column is named, and levels number an item's distinct values from 1. An item that the person lacks
    is at level 0 and not listed. The items are read for the vocabulary and for the rows, so they are
    checkpointed.
    """
    items = cut_lineage(items)
    names = items.select(F.col("item"), F.col(value).cast("string").alias("__v")).distinct()
    levels = with_position(names, ["item"], [F.col("__v")], None, "__level")
    ranked = with_position(names.select("item").distinct(), [], [F.col("item")], None, "__r")
    ids = levels.join(ranked.select("item", (F.col("__r") - 1).alias("__i")), "item")
    own = items.withColumn("__v", F.col(value).cast("string"))
    pairs = F.sort_array(F.collect_list(F.struct("__i", "__level", "__v")))
    rows = own.join(ids, ["item", "__v"]).groupBy(key).agg(pairs.alias("__p"))
    out = persons.select(key).distinct().join(rows, key, "left")
    empty = F.array().cast("array<bigint>")
    return out.select(
        key, F.coalesce(F.col("__p.__i"), empty).alias("indices"), F.coalesce(F.col("__p.__level"), empty).alias("levels"),
        F.coalesce(F.col("__p.__v"), F.array().cast("array<string>")).alias("categories"),
    )


def constant_features(train_items: DataFrame, train_persons: DataFrame, key: str) -> DataFrame:
    """Items with one value over all training persons (a person without the item has 0)."""
    total = train_persons.agg(F.countDistinct(key).alias("n")).scalar()
    values = train_items.groupBy("item").agg(
        F.countDistinct("n").alias("__v"), F.count(key).alias("__p")
    )
    distinct = F.col("__v") + (F.col("__p") < total).cast("int")
    return values.select("item", distinct.alias("n_values")).filter(F.col("n_values") <= 1)


def drop_features(items: DataFrame, constant: DataFrame, train_items: DataFrame) -> DataFrame:
    """Rows whose item occurs in training and is not constant there."""
    seen = train_items.select("item").distinct()
    return items.join(seen, "item", "left_semi").join(
        constant.select("item"), "item", "left_anti"
    )


def mc_splits(
    persons: DataFrame, key: str, label: str, n: int, train_prop: float = 0.8,
    seed: str | int = 42,
) -> DataFrame:
    """(split, key, label) training rows of n stratified random splits.

    A split keeps, per label, the whole part of ``train_prop`` times the label's persons, chosen
    by the smallest seeded hashes.
    """
    splits = persons.select(key, label).withColumn(
        "split", F.explode(F.sequence(F.lit(1), F.lit(n)))
    )
    hashed = splits.withColumn("__h", hash_text(seed, "split", key))
    ranked = with_position(
        hashed, ["split", label], [F.col("__h"), F.col(key)], hash_bucket(F.col("__h")), "__r"
    )
    sizes = persons.groupBy(label).agg(
        F.floor(F.count(F.lit(1)) * F.lit(train_prop)).alias("__keep")
    )
    return ranked.join(sizes, label).filter(F.col("__r") <= F.col("__keep")).select(
        "split", key, label
    )


def assemble_features(base: DataFrame, parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Left joins of feature tables; columns of a part take its suffix when not empty."""
    out = base
    for suffix, part in parts.items():
        tag = f"_{suffix}" if suffix and not suffix.startswith("=") else ""
        renamed = part.withColumnsRenamed({c: f"{c}{tag}" for c in part.columns if c != key})
        out = out.join(renamed, key, "left")
    return out


def final_features(
    base: DataFrame, parts: Mapping[str, DataFrame], key: str, label: str = "is_target_case",
    target_only: bool = True,
) -> DataFrame:
    """Feature table of the target persons (or of all)."""
    rows = base.filter(F.col(label) == 1) if target_only else base
    return assemble_features(rows, parts, key)
