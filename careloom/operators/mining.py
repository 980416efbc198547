"""Frequent itemsets, association rules, pattern features and the rule network."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careloom.constants import DENSITY_BINS, MIN_LIFT
from careloom.functions.columns import code_prefix
from careloom.functions.drugs import parse_encoding
from careloom.operators.frequency import explode_slots
from careloom.operators.ordering import top_n, with_position
from careloom.session import cut_lineage

METRICS = ["support", "confidence", "lift", "certainty"]
TARGET_ICD_MARKER = "TARGET_ICD:OPIOID_DEPENDENCE"
TARGET_ED_MARKER = "TARGET_ED:EMERGENCY_DEPT"


def items(
    events: DataFrame, key: str, kind: str, drug: str = "drug_name",
    icd_slots: Sequence[str] = (), cpt_slots: Sequence[str] = (), keep: Sequence[str] = (),
) -> DataFrame:
    """(key, item) rows of one kind: drug_name, icd_code, cpt_code or medical_code (both codes)."""
    slots = {
        "drug_name": [drug],
        "icd_code": list(icd_slots),
        "cpt_code": list(cpt_slots),
        "medical_code": [*icd_slots, *cpt_slots],
    }[kind]
    event_type = "pharmacy" if kind == "drug_name" else "medical"
    rows = events.filter(F.col("event_type") == event_type)
    return explode_slots(rows, slots, [key, *keep]).select(key, F.col("code").alias("item"), *keep)


def transactions(rows: DataFrame, key: str, item: str = "item") -> DataFrame:
    """Sorted distinct items and row count of each key.

    The set is built map-side first, so a key with very many rows ships at most one copy of each
    item per task; its size is bounded by the vocabulary.
    """
    return rows.filter(F.col(item).isNotNull() & (F.col(item) != "")).groupBy(key).agg(
        F.sort_array(F.collect_set(item)).alias("items"),
        F.count(F.lit(1)).alias("size"),
    )


def transaction_density(tx: DataFrame) -> DataFrame:
    """Density bin of each transaction by the 25th, 50th and 95th percentile of the row counts."""
    histogram = tx.groupBy("size").agg(F.count(F.lit(1)).alias("__c"))
    cuts = histogram.agg(
        F.percentile("size", [0.25, 0.5, 0.95], F.col("__c")).alias("q")
    ).scalar()
    size = F.col("size")
    low, medium, high, extreme = DENSITY_BINS
    label = (
        F.when(size <= cuts[0], low).when(size <= cuts[1], medium).when(size <= cuts[2], high)
        .otherwise(extreme)
    )
    return tx.withColumn("density", label)


def frequent_itemsets(tx: DataFrame, min_support: float, column: str = "items") -> DataFrame:
    """Itemsets (sorted items, frequency, support) of at least the support, by pattern growth.

    Equal transactions are counted once. An itemset's rows are what follows it in the transactions that hold
    it, without items that are rare beside it; every level extends all itemsets by one item, in joins and
    counts over all of them, so that no itemset's rows meet in one task. The result is small and expensive, so
    its lineage is cut.
    """
    sets = tx.groupBy(F.sort_array(F.array_distinct(column)).alias("__tail")).agg(F.count(F.lit(1)).alias("__w"))
    rows = cut_lineage(sets.withColumn("__set", F.array().cast(sets.schema["__tail"].dataType)))
    sizes = rows.agg(F.sum("__w"), F.sum(F.when(F.col("__tail").isNotNull(), F.col("__w")))).first()
    n, floor = sizes[0], math.ceil(min_support * (sizes[1] or 0))
    if not n:
        return _empty_itemsets(tx)
    parts = None
    while True:
        counts = rows.select("__set", "__w", F.explode("__tail").alias("__x")).groupBy("__set", "__x").agg(F.sum("__w").alias("frequency"))
        found = cut_lineage(counts.filter(F.col("frequency") >= floor))
        if found.isEmpty():
            break
        part = found.select(F.array_append("__set", F.col("__x")).alias("items"), "frequency")
        parts = part if parts is None else parts.unionByName(part)
        # an itemset that goes on with one item only can't go on with two
        usable = found.groupBy("__set").agg(F.collect_set("__x").alias("__next")).filter(F.size("__next") > 1)
        kept = rows.join(usable, "__set").select("__set", F.array_intersect("__tail", "__next").alias("__tail"), "__w")
        kept = kept.filter(F.size("__tail") > 1).groupBy("__set", "__tail").agg(F.sum("__w").alias("__w"))
        grown = kept.select("__set", "__tail", "__w", F.posexplode("__tail").alias("__p", "__x"))
        rest = F.slice("__tail", F.col("__p") + 2, F.size("__tail"))
        grown = grown.select(F.array_append("__set", F.col("__x")).alias("__set"), rest.alias("__tail"), "__w")
        rows = grown.filter(F.size("__tail") > 0).groupBy("__set", "__tail").agg(F.sum("__w").alias("__w"))
        rows = cut_lineage(rows)
    if parts is None:
        return _empty_itemsets(tx)
    return cut_lineage(parts.withColumn("support", F.col("frequency") / F.lit(n)))


def _empty_itemsets(tx: DataFrame) -> DataFrame:
    return tx.limit(0).select(
        F.array().cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("frequency"),
        F.lit(0.0).alias("support"),
    )


def density_support(density: str, min_support: float) -> float:
    """Support floor of a density bin: the extreme bin takes half, but at least 1 %."""
    return max(0.5 * min_support, 0.01) if density == "extreme" else min_support


def mine_by_density(tx: DataFrame, min_support: float) -> DataFrame:
    """Frequent itemsets of each density bin, however small it is; supports are shares of the bin."""
    binned = cut_lineage(transaction_density(tx))
    parts = [
        frequent_itemsets(binned.filter(F.col("density") == d), density_support(d, min_support))
        .withColumn("density", F.lit(d))
        for d in DENSITY_BINS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_lift(itemsets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support over the product of the item supports; single items have lift 1.

    The product is taken in item order, so that its last digits don't depend on the shuffle.
    """
    by = list(by)
    singles = itemsets.filter(F.size("items") == 1).select(
        *by, F.col("items")[0].alias("__item"), F.col("support").alias("__s")
    )
    expected = (
        itemsets.select(*by, "items", F.explode("items").alias("__item"))
        .join(singles, [*by, "__item"])
        .groupBy(*by, "items")
        .agg(F.sort_array(F.collect_list(F.struct("__item", "__s"))).alias("__parts"))
    )
    product = F.aggregate("__parts", F.lit(1.0), lambda acc, x: acc * x["__s"])
    expected = expected.withColumn("__expected", product).drop("__parts")
    lift = F.when(F.size("items") == 1, 1.0).otherwise(F.col("support") / F.col("__expected"))
    return itemsets.join(expected, [*by, "items"]).withColumn("lift", lift).drop("__expected")


def filter_by_lift(
    itemsets: DataFrame, min_lift: float = MIN_LIFT, by: Sequence[str] = (),
    drop_singletons: bool = False,
) -> DataFrame:
    """Itemsets whose items occur together more often than by chance.

    Single items have lift 1, so a plain threshold above 1 drops them and with them the supports
    that rules need; they stay unless ``drop_singletons``.
    """
    rows = with_lift(itemsets, by)
    kept = F.col("lift") >= min_lift
    return rows.filter(kept if drop_singletons else kept | (F.size("items") == 1))


def association_rules(
    itemsets: DataFrame, min_confidence: float, by: Sequence[str] = ()
) -> DataFrame:
    """All rules antecedent -> consequent of the itemsets, with their metrics.

    Consequents of an itemset are grown level by level: a consequent whose rule misses the
    confidence is not grown, as a larger one leaves a more frequent antecedent. Supports
    come from equi-joins with the itemset table, which holds all subsets of its itemsets, as
    mining gives them; a rule through a subset that is not listed drops out.
    """
    by = list(by)
    table = itemsets.select(*by, F.col("items").alias("__i"), F.col("support").alias("__s"))

    def looked_up(rows: DataFrame, side: str) -> DataFrame:
        lookup = table.withColumnsRenamed({"__i": side, "__s": f"{side}_support"})
        return rows.join(lookup, [*by, side])

    def confident(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("antecedents", F.array_except("items", "consequents"))
        rows = looked_up(rows, "antecedents")
        return rows.filter(F.col("support") / F.col("antecedents_support") >= min_confidence)

    one = itemsets.filter(F.size("items") >= 2).select(
        *by, "items", "support", F.explode("items").alias("__y")
    )
    level = one.select(*by, "items", "support", F.array("__y").alias("consequents"))
    level = cut_lineage(confident(level))
    growing = level.select(*by, "items", F.col("consequents")[0].alias("__y"))
    parts = level
    while True:
        # an antecedent of one item can't give another item away
        last = level.filter(F.size("antecedents") > 1).select(*by, "items", "support", "consequents")
        grown = last.join(growing, [*by, "items"]).filter(
            F.col("__y") > F.element_at("consequents", -1)
        )
        grown = grown.withColumn("consequents", F.array_append("consequents", F.col("__y")))
        level = cut_lineage(confident(grown.drop("__y")))
        if level.isEmpty():
            break
        parts = parts.unionByName(level)
    rows = looked_up(parts, "consequents")
    a, c, s = (F.col(x) for x in ("antecedents_support", "consequents_support", "support"))
    confidence = s / a
    return (
        rows.withColumns(
            {
                "confidence": confidence,
                "lift": confidence / c,
                "leverage": s - a * c,
                "conviction": F.when(confidence < 1, (1 - c) / (1 - confidence)).otherwise(
                    F.lit(float("inf"))
                ),
                "certainty": F.when(c < 1, (confidence - c) / (1 - c)).otherwise(F.lit(0.0)),
            }
        )
        .filter(F.col("confidence") >= min_confidence)
        .select(*by, "antecedents", "consequents", "antecedents_support", "consequents_support",
                "support", "confidence", "lift", "leverage", "conviction", "certainty")
    )


def merge_bins(itemsets: DataFrame) -> DataFrame:
    """One row per itemset over all bins (the first bin's support counts), ranked by support."""
    order = F.create_map(*[F.lit(x) for i, d in enumerate(DENSITY_BINS) for x in (d, i)])
    best = itemsets.groupBy("items").agg(
        F.min_by(F.struct("support", "density"), order[F.col("density")]).alias("__b")
    )
    best = best.select("items", "__b.support", "__b.density").withColumn(
        "__desc", -F.col("support")
    )
    ranked = with_position(
        best, [], [F.col("__desc"), F.col("items")], F.floor(F.col("__desc") * 1000), "__r"
    )
    return ranked.withColumn("rank", F.col("__r") - 1).drop("__desc", "__r")


def encoding_map(merged: DataFrame) -> DataFrame:
    """Support and rank of every single item."""
    return merged.filter(F.size("items") == 1).select(
        F.col("items")[0].alias("item"), "support", "rank"
    )


def mine_target(
    rows: DataFrame, key: str, label: str, min_support: float, min_confidence: float
) -> tuple[DataFrame, DataFrame]:
    """Itemsets and rules of the persons with label 1, without density bins."""
    tx = transactions(rows.filter(F.col(label) == 1), key)
    itemsets = frequent_itemsets(tx, min_support)
    return itemsets, association_rules(itemsets, min_confidence)


def add_markers(
    rows: DataFrame, events: DataFrame, key: str, code: str, prefixes: Sequence[str],
    line: str, lines: Sequence[str],
) -> DataFrame:
    """Item rows plus a marker item for persons with a target code or an emergency line."""
    markers = F.array_compact(
        F.array(
            F.when(code_prefix(prefixes, code), TARGET_ICD_MARKER),
            F.when(F.col(line).isin(*lines), TARGET_ED_MARKER),
        )
    )
    marked = events.select(key, F.explode(markers).alias("item")).distinct()
    return rows.select(key, "item").unionByName(marked)


def mine_marked(
    rows: DataFrame, key: str, min_support: float, min_confidence: float,
    min_lift: float = MIN_LIFT,
) -> tuple[DataFrame, DataFrame]:
    """Itemsets of two or more items and their rules, at the given thresholds whatever the size."""
    found = frequent_itemsets(cut_lineage(transactions(rows, key)), min_support)
    kept = filter_by_lift(found, min_lift, drop_singletons=True).filter(F.size("items") > 1)
    return kept, association_rules(found, min_confidence).join(
        kept.select(F.col("items").alias("__i")),
        F.sort_array(F.concat("antecedents", "consequents")) == F.col("__i"), "left_semi",
    )


def top_rules(rules: DataFrame, n: int | None = 1000) -> DataFrame:
    """Rules of the highest lift (support and items break ties); all of them without ``n``."""
    return rules if n is None else top_n(
        rules,
        [F.col("lift").desc(), F.col("support").desc(), F.col("antecedents"),
         F.col("consequents")],
        n,
    )


def split_rules(
    rules: DataFrame, prefixes: Mapping[str, str], n: int | None = 1000, rest: str = "CONTROL"
) -> DataFrame:
    """Rules labelled by the marker their consequent holds, the top n by lift of each label or all."""
    def holds(prefix: str) -> Column:
        return F.exists("consequents", lambda x: x.startswith(prefix))

    hits = {label: holds(prefix) for label, prefix in prefixes.items()}
    none = F.lit(True)
    for hit in hits.values():
        none = none & ~hit
    parts = [
        top_rules(rules.filter(hit), n).withColumn("rule_target", F.lit(label))
        for label, hit in {**hits, rest: none}.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def support_ladder(start: float, stop: float, step: float) -> list[float]:
    """Falling thresholds from start to stop, both included."""
    rungs, rung = [], start
    while rung >= stop:
        rungs.append(round(rung, 5))
        rung -= step
    return sorted({*rungs, stop}, reverse=True)


def mine_with_fallback(
    tx: DataFrame, start: float = 0.025, stop: float = 0.01, step: float = 0.005, k: int = 30,
    min_confidence: float = 0.3,
) -> DataFrame:
    """Rules among the top k itemsets at the highest support that yields any.

    One mining run at the lowest support serves all thresholds: the top k of a threshold are the
    overall top k above it, so the first threshold that succeeds is the highest one not above the
    best rule's support.
    """
    found = frequent_itemsets(tx, stop)
    best = cut_lineage(top_n(found, [F.col("support").desc(), F.col("items")], k))
    rules = association_rules(best, min_confidence)
    top = rules.agg(F.max("support").alias("s")).scalar()
    reached = [F.when(top >= r, F.lit(r)) for r in support_ladder(start, stop, step)]
    chosen = F.coalesce(*reached)
    return rules.withColumn("min_support", chosen).filter(F.col("support") >= chosen)


# --- pattern features ---------------------------------------------------------------------


def encode_pattern(
    patterns: DataFrame, pattern: str, item_list: str, encodings: DataFrame, layout: int = 29
) -> DataFrame:
    """Element-wise sum of the encodings of a pattern's items."""
    fields = parse_encoding("encoding", layout)
    parsed = encodings.select(
        F.col("item").alias("__item"), *[c.alias(f"enc_{n}") for n, c in fields.items()]
    )
    return (
        patterns.select(pattern, F.explode(item_list).alias("__item"))
        .join(parsed, "__item", "left")
        .groupBy(pattern)
        .agg(*[F.coalesce(F.sum(f"enc_{n}"), F.lit(0)).alias(f"enc_{n}") for n in fields])
    )


def pattern_metrics(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """Mean rule metrics of each pattern over the rules that have it as one side."""
    sides = rules.select(
        F.explode(F.array("antecedents", "consequents")).alias("items"), *METRICS
    )
    means = sides.groupBy("items").agg(*[F.avg(m).alias(f"mean_{m}") for m in METRICS])
    return patterns.join(means, "items", "left").fillna(0.0, [f"mean_{m}" for m in METRICS])


def expand_patterns(
    tx: DataFrame, patterns: DataFrame, dims: Sequence[str], tokens: str = "items", n: int = 15
) -> DataFrame:
    """Slot columns of the first n patterns: its dims and metrics where the row holds it, else 0.

    ``patterns`` has ``slot`` (1..n), ``items`` and the dims. Its n rows become literals of the
    projection, so the transactions are neither shuffled nor joined. A pattern is held when each of its
    items is; a look for an item is the same expression in all patterns that have it, and is made once a row.
    """
    rows = top_n(patterns.filter(F.col("slot") <= n), [F.col("slot")], n).collect()
    out = {}
    for slot in range(1, n + 1):
        row = next((r for r in rows if r["slot"] == slot), None)
        held = F.col(tokens).isNotNull()
        for x in row["items"] if row else ():
            held = held & F.array_contains(tokens, F.lit(x))
        for dim in dims:
            name = f"pattern_{slot}_{dim}"
            out[name] = F.when(held, F.lit(float(row[dim]))).otherwise(F.lit(0.0)) if row else F.lit(0.0)
    return tx.withColumns(out)


def attach_pattern_metrics(
    df: DataFrame, patterns: DataFrame, slots: Sequence[str], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Metrics of the pattern that each slot column names, suffixed by the slot."""
    out = df
    for slot in slots:
        table = patterns.select(
            F.col("pattern_id").alias(slot), *[F.col(m).alias(f"{m}_{slot}") for m in metrics]
        )
        out = out.join(table, slot, "left")
    return out


def rule_network(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (mean metrics per antecedent item and consequent item) and nodes (degree centrality)."""
    pairs = rules.select(
        F.explode("antecedents").alias("source"), "consequents", "support", "confidence",
        "certainty",
    ).select("source", F.explode("consequents").alias("target"), "support", "confidence",
             "certainty")
    edges = pairs.groupBy("source", "target").agg(
        *[F.avg(m).alias(m) for m in ("support", "confidence", "certainty")]
    )
    degrees = (
        edges.select(F.explode(F.array("source", "target")).alias("item"))
        .groupBy("item").agg(F.count(F.lit(1)).alias("degree"))
    )
    others = degrees.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("n")).scalar()
    return edges, degrees.withColumn("centrality", F.col("degree") / others)


def encoding_collisions(df: DataFrame, name: str, encoding: str) -> DataFrame:
    """Encodings that several names share."""
    shared = df.groupBy(encoding).agg(
        F.countDistinct(name).alias("drugs"), F.sort_array(F.collect_set(name)).alias("names")
    )
    return shared.filter(F.col("drugs") > 1)
