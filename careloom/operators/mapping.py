"""Variant-to-canonical mappings of codes and drug names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careloom.functions.columns import (
    blank_to_null,
    col,
    flatten_code,
    normalize_cpt,
    normalize_icd,
)
from careloom.operators.frequency import explode_slots
from careloom.session import code_list, cut_lineage


def _lookup_join(df: DataFrame, mapping: DataFrame, key: Column, out: str) -> DataFrame:
    """Left equi-join on the mapping; the size decides broadcast or shuffle at run time."""
    table = mapping.select(F.col("key").alias("__k"), F.col("value").alias(out))
    return df.join(table, key == F.col("__k"), "left").drop("__k")


def apply_drug_map(df: DataFrame, mapping: DataFrame, drug: str = "drug_name") -> DataFrame:
    """Replace a drug name by its canonical one; the name is trimmed and lower-cased first."""
    name = F.lower(F.trim(col(drug)))
    joined = _lookup_join(df, mapping, name, "__to")
    fixed = blank_to_null(F.coalesce(F.col("__to"), name))
    return joined.withColumn(drug, fixed).drop("__to").select(*df.columns)


def standardize_drug(
    df: DataFrame, mapping: DataFrame, drug: str = "drug_name",
    out: str = "standardized_drug_name",
) -> DataFrame:
    """Add the canonical drug name of the lower-cased (untrimmed) name."""
    name = F.lower(col(drug))
    joined = _lookup_join(df, mapping, name, "__to")
    return joined.withColumn(out, F.coalesce(F.col("__to"), name)).drop("__to")


def slot_entries(df: DataFrame, slots: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows taken apart: (id, row) with all other columns, and (id, slot, code) of the filled slots.

    Row numbers are given to checkpointed rows, so that both parts and every retry agree on them.
    """
    numbered = cut_lineage(df).withColumn("__id", F.monotonically_increasing_id())
    rest = [F.col(c) for c in df.columns if c not in slots]
    whole = F.struct(*rest) if rest else F.struct(F.lit(0).alias("__none"))
    return numbered.select("__id", whole.alias("__row")), explode_slots(numbered, slots, ["__id"]).select("__id", "slot", "code")


def resolve_codes(
    codes: DataFrame, icd_map: DataFrame, target_map: DataFrame | None, cpt_map: DataFrame | None,
    keep_unmatched: bool,
) -> DataFrame:
    """(cpt, code, value) of distinct raw codes: the dictionary that all slots share."""
    icd = codes.filter(~F.col("cpt"))
    normal = normalize_icd("code", keep_unmatched)
    if target_map is not None:
        icd = _lookup_join(icd, target_map, flatten_code("code"), "__target")
    icd = _lookup_join(icd, icd_map, normal, "__mapped")
    hits = [F.col("__target")] if target_map is not None else []
    found = icd.select("cpt", "code", blank_to_null(F.coalesce(*hits, "__mapped", normal, "code")).alias("value"))
    cpt = codes.filter("cpt")
    normal = normalize_cpt("code")
    if cpt_map is not None:
        cpt = _lookup_join(cpt, cpt_map, normal, "__mapped")
    hits = [F.col("__mapped")] if cpt_map is not None else []
    return found.unionByName(cpt.select("cpt", "code", blank_to_null(F.coalesce(*hits, normal)).alias("value")))


def apply_code_maps(
    df: DataFrame,
    slots: Sequence[str],
    icd_map: DataFrame,
    target_map: DataFrame | None = None,
    cpt_slots: Sequence[str] = (),
    cpt_map: DataFrame | None = None,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Canonical codes in every slot: target map on the flat raw text, then the code map on the
    normalised code, then the normalised code, then the raw text.

    The distinct raw codes of all slots are resolved once. Filled slots meet that dictionary in one
    join and are gathered into their rows by one regroup, however many slots there are; empty
    slots stay null and are not moved.
    """
    every = [*slots, *cpt_slots]
    rows, entries = slot_entries(df, every)
    entries = entries.withColumn("cpt", F.col("slot").isin(list(cpt_slots)))
    dictionary = resolve_codes(entries.select("cpt", "code").distinct(), icd_map, target_map, cpt_map, keep_unmatched)
    coded = entries.join(dictionary, ["cpt", "code"]).select("__id", F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.struct("slot", "value").alias("__entry"))
    both = coded.unionByName(rows.withColumn("__entry", F.lit(None).cast(coded.schema["__entry"].dataType)))
    grouped = both.groupBy("__id").agg(F.first("__row", True).alias("__row"), F.map_from_entries(F.collect_list("__entry")).alias("__codes"))
    return grouped.select(*[
        F.col("__codes")[c].alias(c) if c in every else F.col(f"__row.`{c}`").alias(c) for c in df.columns
    ])


def rows_with_code(df: DataFrame, slots: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Rows of which any slot holds a code of ``wanted`` (column ``code``).

    A list under the broadcast threshold is looked up slot by slot, and no row moves. A longer one takes one
    semi-join of the filled slots and one regroup.
    """
    listed, small = code_list(wanted.select("code").filter((F.col("code") != "")))
    if small:
        out, hit = df, F.lit(False)
        for i, slot in enumerate(slots):
            held = listed.select(F.col("code").alias(f"__code_{i}"))
            out = out.join(F.broadcast(held), F.col(slot).cast("string") == F.col(f"__code_{i}"), "left")
            hit = hit | F.col(f"__code_{i}").isNotNull()
        return out.filter(hit).select(*df.columns)
    rows, entries = slot_entries(df.withColumn("__slots", F.struct(*slots)), slots)
    hits = entries.join(listed, "code", "left_semi").select("__id").distinct()
    marked = rows.withColumn("__hit", F.lit(False)).unionByName(
        hits.select("__id", F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.lit(True).alias("__hit"))
    )
    grouped = marked.groupBy("__id").agg(F.first("__row", True).alias("__row"), F.bool_or("__hit").alias("__hit"))
    return grouped.filter("__hit").select(*[
        F.col(f"__row.__slots.`{c}`" if c in slots else f"__row.`{c}`").alias(c) for c in df.columns
    ])


def needs_update(df: DataFrame, raw: str, normalized: Column) -> DataFrame:
    """One row telling whether any raw value differs from its normal form (null-safe)."""
    changed = df.filter(~F.col(raw).eqNullSafe(normalized)).limit(1)
    return changed.agg((F.count(F.lit(1)) > 0).alias("needs_update"))


def suggest_mapping(freq: DataFrame, code: str, n: str, system: str = "icd") -> DataFrame:
    """Variants that should map to a canonical spelling, from a code frequency table.

    Diagnosis variants map to their undotted code. Procedure variants map to the five-digit
    spelling of their group if there is one, else to the most frequent (then smallest) spelling.
    """
    totals = freq.groupBy(F.col(code).alias("variant")).agg(F.sum(n).alias("frequency"))
    flat = F.translate(F.upper("variant"), " ", "")
    if system == "icd":
        token = normalize_icd(flat)
        group = F.when(token == "", F.translate(flat, ".", "")).otherwise(token)
        out = totals.withColumn("canonical", group)
    else:
        grouped = totals.withColumn("__g", F.translate(flat, ".", ""))
        # Spellings of one flattened code differ only by dots, blanks and case: a small group.
        best = Window.partitionBy("__g").orderBy(
            F.col("variant").rlike("^[0-9]{5}$").desc(), F.col("frequency").desc(), "variant"
        )
        out = grouped.withColumn("canonical", F.first("variant").over(best))
    return out.filter(F.col("variant") != F.col("canonical")).select(
        "variant", "canonical", "frequency"
    )
