"""Decision rules of tree models, rule matching, explanations and what-if effects.

A model's rules come from the driver (one per leaf) and travel to the tasks as an index of bit vectors: the
rows are neither joined nor shuffled to be matched, and no expression grows with the rules. What-if
effects change elements of one feature array per row, and only those that the model uses.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careloom.operators import gram
from careloom.operators.importance import feature_array, positive_probability, used_features
from careloom.operators.leafindex import LeafIndex, as_matrix
from careloom.session import cut_lineage

RULE_SCHEMA = ("tree int, rule_id int, prediction double, "
               "literals array<struct<literal: int, feature: int, le: boolean, threshold: double>>")
_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")
_LEAF = re.compile(r"^( *)Predict: (\S+)")
_TREE = re.compile(r"^ *Tree (\d+) ")


def tree_rules(spark: SparkSession, model: Transformer) -> DataFrame:
    """One row per leaf: the conditions on the way to it and its prediction.

    Equal conditions share a literal id. Models use numeric splits only.
    """
    rules, path, tree, ids = [], [], 0, {}
    for line in model.toDebugString.splitlines():
        start = _TREE.match(line)
        if start:
            tree, path = int(start[1]), []
            continue
        branch, leaf = _BRANCH.match(line), _LEAF.match(line)
        if branch or leaf:
            depth = len((branch or leaf)[1])
            path = [p for p in path if p[0] < depth]
        if branch:
            condition = (int(branch[2]), branch[3] == "<=", float(branch[4]))
            path.append((depth, condition))
        elif leaf:
            literals = []
            for _, (feature, le, threshold) in path:
                number = ids.setdefault((feature, le, threshold), len(ids) + 1)
                literals.append((number, feature, le, threshold))
            rules.append((tree, len(rules), float(leaf[2]), literals))
    return spark.createDataFrame(rules, RULE_SCHEMA)


def rule_text(features: Sequence[str], literals: str | Column = "literals") -> Column:
    """Readable condition of each literal, e.g. 'age <= 40.5'."""
    names = F.array(*[F.lit(f) for f in features])
    return F.transform(
        literals,
        lambda x: F.concat(
            names[x["feature"]], F.when(x["le"], F.lit(" <= ")).otherwise(F.lit(" > ")),
            x["threshold"].cast("string"),
        ),
    )


def _rule_rows(rules: DataFrame) -> list[dict]:
    """Rules on the driver: one per leaf of a model that came from there."""
    return [r.asDict(recursive=True) for r in rules.collect()]


def match_rules(
    rows: DataFrame, rules: DataFrame, features: Sequence[str], predicted: str | None = None
) -> DataFrame:
    """Add ``matched``: ids of the rules whose conditions all hold (and that predict the row's
    class, when ``predicted`` is given), in the order of the rules.

    The conditions are searched by :class:`careloom.operators.leafindex.LeafIndex`. A condition on a null
    value does not hold; a rule without conditions holds everywhere. Features that no condition reads do not
    travel to the search.
    """
    listed = _rule_rows(rules)
    read = sorted({x["feature"] for r in listed for x in r["literals"]})
    place = {f: i for i, f in enumerate(read)}
    index = LeafIndex([[(place[x["feature"]], x["le"], x["threshold"]) for x in r["literals"]] for r in listed])
    ids = np.array([r["rule_id"] for r in listed], dtype=np.int32)
    classes = np.array([r["prediction"] for r in listed], dtype=float) if predicted else None
    shared = rows.sparkSession.sparkContext.broadcast((index, ids, classes))
    width = max(len(read), 1)

    def found(values: pa.Array, wanted: pa.Array | None) -> pa.Array:
        tree, numbers, predictions = shared.value
        if wanted is not None:
            wanted = wanted.cast(pa.float64()).to_numpy(zero_copy_only=False)
        offsets, places = tree.matched(*as_matrix(values, width), predictions, wanted)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(numbers[places]))

    values = feature_array([features[f] for f in read]) if read else F.array(F.lit(0.0))
    if predicted:
        @F.arrow_udf("array<int>")
        def holding(values: pa.Array, wanted: pa.Array) -> pa.Array:
            return found(values, wanted)

        return rows.withColumn("matched", holding(values, F.col(predicted).cast("double")))

    @F.arrow_udf("array<int>")
    def holding_all(values: pa.Array) -> pa.Array:
        return found(values, None)

    return rows.withColumn("matched", holding_all(values))


def hitting_set(clauses: list[frozenset[int]]) -> list[int]:
    """Small set of literals that meets every clause: greedy, then freed of spare members."""
    left, chosen = list(clauses), []
    while left:
        counts: dict[int, int] = {}
        for clause in left:
            for literal in clause:
                counts[literal] = counts.get(literal, 0) + 1
        if not counts:
            break
        best = min(counts, key=lambda x: (-counts[x], x))
        chosen.append(best)
        left = [c for c in left if best not in c]
    for literal in sorted(chosen, reverse=True):
        others = set(chosen) - {literal}
        if all(others & c for c in clauses):
            chosen.remove(literal)
    return sorted(chosen)


def explain(
    rows: DataFrame, rules: DataFrame, features: Sequence[str], predicted: str = "prediction"
) -> DataFrame:
    """Add ``explanation``: conditions that touch every matched rule of the predicted class.

    The set is irreducible. It is worked out once per distinct set of matched rules, a table that is joined
    back; the matched rows are checkpointed, as they are read twice.
    """
    listed = _rule_rows(rules)
    clauses = {r["rule_id"]: frozenset(x["literal"] for x in r["literals"]) for r in listed}
    texts = {
        x["literal"]: f"{features[x['feature']]} {'<=' if x['le'] else '>'} {x['threshold']}"
        for r in listed for x in r["literals"]
    }

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def conditions(matched: pd.Series) -> pd.Series:
        sets = matched.map(lambda ids: [clauses[i] for i in ids if clauses[i]])
        return sets.map(lambda own: [texts[x] for x in hitting_set(own)])

    matched = cut_lineage(match_rules(rows, rules, features, predicted))
    distinct = matched.select("matched").distinct().withColumn("explanation", conditions("matched"))
    return matched.join(distinct, "matched").select(*matched.columns, "explanation")


def unmatched_rows(matched: DataFrame, predicted: str = "prediction") -> DataFrame:
    """Predictions per class and how many no rule supports."""
    return matched.groupBy(predicted).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.size("matched") == 0).alias("unmatched_predictions"),
    )


def explanation_steps(
    explained: DataFrame, key: str, explanation: str = "explanation", by: Sequence[str] = ()
) -> DataFrame:
    """Long form of explanations: (key, explanation_id, position, feature, length)."""
    extra = F.col("explanation_id") if "explanation_id" in explained.columns else F.lit(0)
    return explained.select(
        *by, key, extra.alias("explanation_id"), F.size(explanation).alias("length"),
        F.posexplode(explanation).alias("position", "__c"),
    ).withColumn("feature", F.split("__c", " ")[0]).drop("__c")


def explanation_metrics(steps: DataFrame, key: str) -> DataFrame:
    """How often, how early and how steadily each feature appears in the explanations."""
    one = steps.groupBy(key, "explanation_id", "feature").agg(
        F.min("position").alias("position"), F.max("length").alias("length")
    )
    totals = one.groupBy(key).agg(F.countDistinct("explanation_id").alias("__all"))
    per_row = one.groupBy(key, "feature").agg(
        F.count(F.lit(1)).alias("__with"),
        F.sum("length").alias("__len"),
        F.sum("position").alias("__pos"),
        F.sum(F.col("position") * F.col("position")).alias("__sq"),
        F.stddev_pop("position").alias("__std"),
    ).join(totals, key)
    n_rows = totals.agg(F.count(F.lit(1)).alias("n")).scalar()
    uses = F.sum("__with")
    mean = F.sum("__pos") / uses
    spread = F.sqrt(F.greatest(F.sum("__sq") / uses - mean * mean, F.lit(0.0)))
    out = per_row.groupBy("feature").agg(
        F.count(F.lit(1)).alias("support"),
        (F.sum("__len") / uses).alias("specificity"),
        F.count_if(F.col("__with") == F.col("__all")).alias("__essential"),
        F.count_if(F.col("__with") < F.col("__all")).alias("contrastive_instances"),
        F.avg("__std").alias("stability"),
        mean.alias("avg_position"),
        spread.alias("position_std"),
    )
    total = per_row.agg(F.count(F.lit(1)).alias("n")).scalar()
    return out.select(
        "feature", "support", F.col("support").alias("coverage"), "specificity",
        (F.col("__essential") / n_rows).alias("essentiality_ratio"), "contrastive_instances",
        "stability", (F.col("support") / total).alias("relative_importance"), "avg_position",
        "position_std",
    )


def explanation_importance(steps: DataFrame, explained: DataFrame, key: str) -> DataFrame:
    """Share of the explanations that mention each feature."""
    n = explained.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = steps.select(key, "explanation_id", "feature").distinct().groupBy("feature").agg(
        F.count(F.lit(1)).alias("raw_count")
    )
    return counts.withColumn("normalized", F.col("raw_count") / n)


def unstable_features(steps: DataFrame, explained: DataFrame, share: float = 0.1) -> DataFrame:
    """Features mentioned less often than the share of rows."""
    n = explained.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = steps.groupBy("feature").agg(F.count(F.lit(1)).alias("mentions"))
    return counts.withColumn("__n", n).filter(F.col("mentions") < share * F.col("__n")).drop("__n")


def pair_interactions(steps: DataFrame, key: str, min_weight: int = 2) -> DataFrame:
    """How many explanations mention two features together.

    An explanation holds a handful of conditions; its distinct features form the pairs.
    """
    sets = steps.groupBy(key, "explanation_id").agg(
        F.sort_array(F.collect_set("feature")).alias("__f")
    )
    pairs = F.flatten(
        F.transform(
            "__f",
            lambda x: F.transform(
                F.filter("__f", lambda y: y > x),
                lambda y: F.struct(x.alias("feature_a"), y.alias("feature_b")),
            ),
        )
    )
    counts = sets.select(F.inline(pairs)).groupBy("feature_a", "feature_b").agg(
        F.count(F.lit(1)).alias("weight")
    )
    return counts.filter(F.col("weight") >= min_weight)


# --- what-if effects ----------------------------------------------------------------------


def _feature_moments(rows: DataFrame, indices: Sequence[int]) -> dict[int, tuple[bool, float]]:
    """Per element of ``x``: is it a 0/1 feature, and its deviation; one driver row per element."""
    each = F.explode(F.transform(_ints(indices), lambda i: F.struct(i.alias("i"), F.col("x")[i].alias("v"))))
    long = rows.select(each.alias("e")).select("e.i", "e.v")
    binary = (F.min("v") == 0) & (F.max("v") == 1) & F.bool_and(F.col("v").isin(0.0, 1.0))
    found = long.groupBy("i").agg(F.coalesce(binary, F.lit(False)).alias("b"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
    return {r["i"]: (r["b"], r["s"]) for r in found.collect()}


def _ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(i)) for i in values]).cast("array<int>")


def shifted(
    rows: DataFrame, indices: Sequence[int], signed: bool = True, only: Column | None = None
) -> DataFrame:
    """Every row once per listed element ``i`` of its array ``x``, with ``value`` in place of x[i].

    A 0/1 element is flipped, another one moved by one deviation: away from zero if ``signed``, otherwise
    upwards (by 1 when the deviation is 0). ``only`` is an array of the elements to vary in the row.
    """
    moments = _feature_moments(rows, indices)
    width = max(indices, default=-1) + 1
    flips = F.array(*[F.lit(moments.get(i, (False, 0.0))[0]) for i in range(width)])
    steps = F.array(*[F.lit(float(moments.get(i, (False, 0.0))[1])) for i in range(width)])
    wanted = _ints(indices)
    if only is not None:
        wanted = F.array_intersect(wanted, only)
    varied = rows.withColumn("i", F.explode(wanted))
    now, step = F.col("x")[F.col("i")], steps[F.col("i")]
    moved = now + F.signum(now) * step if signed else now + F.when(step > 0, step).otherwise(1.0)
    return varied.withColumn("value", F.when(flips[F.col("i")], 1 - now).otherwise(moved))


def with_change(varied: DataFrame) -> DataFrame:
    """Adds the feature vector with the row's one change (x, i, value) made."""
    changed = F.transform("x", lambda v, j: F.when(j == F.col("i"), F.col("value")).otherwise(v))
    return varied.withColumn("features", array_to_vector(changed)).drop("x", "value")


def _names(features: Sequence[str]) -> Column:
    return F.array(*[F.lit(f) for f in features])


def counterfactual_effect(
    model: Transformer, explained: DataFrame, key: str, features: Sequence[str],
    predicted: str = "prediction", explanation: str = "explanation", target: float = 1.0,
) -> DataFrame:
    """Share of target-class rows whose prediction leaves the class when one explained feature
    is flipped or moved."""
    rows = explained.filter(F.col(predicted) == target)
    places = F.transform(
        explanation, lambda x: (F.array_position(_names(features), F.split(x, " ")[0]) - 1).cast("int")
    )
    named = rows.select(key, feature_array(features).alias("x"), places.alias("named"))
    varied = shifted(named, used_features(model, len(features)), only=F.col("named"))
    scored = model.transform(with_change(varied.drop("named")))
    flips = scored.groupBy("i").agg(F.count_if(F.col("prediction") != target).alias("flips"))
    n = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
    return flips.filter(F.col("flips") > 0).select(
        _names(features)[F.col("i")].alias("feature"), (F.col("flips") / n).alias("causal_responsibility")
    )


def mean_abs_change(
    model: Transformer, rows: DataFrame, key: str, features: Sequence[str]
) -> DataFrame:
    """Mean absolute change of the probability when a feature is flipped or raised.

    Features that the model doesn't use change nothing and aren't scored.
    """
    arrays = rows.select(key, feature_array(features).alias("x"))
    base = model.transform(arrays.withColumn("features", array_to_vector("x")))
    base = base.select(key, "x", positive_probability().alias("__base"))
    used = used_features(model, len(features))
    scored = model.transform(with_change(shifted(base, used, signed=False)))
    change = F.abs(positive_probability() - F.col("__base"))
    found = scored.groupBy("i").agg(
        F.avg(change).alias("causal_importance"), F.stddev_samp(change).alias("change_std")
    )
    unused = [i for i in range(len(features)) if i not in set(used)]
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    still = n.filter("n > 0").select(
        F.explode(_ints(unused)).alias("i"), F.lit(0.0).alias("causal_importance"),
        F.when(F.col("n") > 1, 0.0).alias("change_std"),
    )
    return found.unionByName(still).select(
        _names(features)[F.col("i")].alias("feature"), "causal_importance", "change_std"
    )


def rule_change_effect(
    model: Transformer, matched: DataFrame, rules: DataFrame, key: str, features: Sequence[str],
    predicted: str = "prediction", min_correlation: float = 0.3,
) -> DataFrame:
    """Mean prediction change when a rule is broken and correlated features move along.

    Per rule: each literal's feature is set just beyond its threshold, and features correlated with
    it among the rule's rows move by correlation times its shift. Correlations are formed between a
    rule's own features and all others only.
    """
    width = len(features)
    targets: dict[int, dict[int, float]] = {}
    for r in _rule_rows(rules):
        for x in r["literals"]:  # the last condition on a feature is the tightest
            targets.setdefault(r["rule_id"], {})[x["feature"]] = x["threshold"] + (1e-6 if x["le"] else -1e-6)
    rows = matched.select(
        key, F.col(predicted).cast("double").alias("__before"), feature_array(features).alias("x"),
        F.explode("matched").alias("rule_id"),
    )
    rows = cut_lineage(rows)
    spark = matched.sparkSession
    rows_of = {r: sorted(own) for r, own in targets.items()}
    held = rows.filter(F.col("rule_id").isin(list(rows_of)))
    moments = gram.pair_moments(held.select(F.col("rule_id").cast("long").alias("key"), "x"), width, rows_of)
    found = gram.correlations(moments, width, rows_of)
    weight = F.when(F.col("a") == F.col("b"), 1.0).when(F.abs("correlation") > min_correlation, F.col("correlation")).otherwise(0.0)
    weights = found.groupBy("key", "a").agg(F.sort_array(F.collect_list(F.struct("b", weight.alias("w")))).alias("s"))
    ends = spark.createDataFrame([(r, i, to) for r, own in targets.items() for i, to in own.items()], "key long, a long, to double")
    steps = weights.join(ends, ["key", "a"]).groupBy(F.col("key").cast("int").alias("rule_id")).agg(
        F.sort_array(F.collect_list(F.struct("a", "to", F.col("s.w").alias("w")))).alias("steps")
    )

    def moved(now: Column, step: Column) -> Column:
        shift = step["to"] - F.col("x")[step["a"].cast("int")]
        return F.zip_with(now, step["w"], lambda v, w: v + w * shift)

    joined = rows.join(steps, "rule_id", "left")
    changed = F.when(F.col("steps").isNull(), F.col("x")).otherwise(F.reduce("steps", F.col("x"), moved))
    slim = joined.select(key, "rule_id", "__before", array_to_vector(changed).alias("features"))
    change = F.abs(F.col("__before") - F.col("prediction"))
    return model.transform(slim).groupBy("rule_id").agg(F.avg(change).alias("causal_importance"))


def rule_validation(
    matched: DataFrame, rules: DataFrame, label: str, predicted: str, features: Sequence[str]
) -> DataFrame:
    """Per rule: matched share, accuracy, deviation of the predictions and feature statistics."""
    n = matched.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
    rows = matched.select(F.explode("matched").alias("rule_id"), label, predicted, *features)
    stats = []
    for f in features:
        stats += [F.stddev_pop(f).alias(f"{f}_std"), (F.max(f) - F.min(f)).alias(f"{f}_range"),
                  F.avg(f).alias(f"{f}_mean")]
    found = rows.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("matched_rows"),
        F.stddev_pop(predicted).alias("stability"),
        F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"),
        *stats,
    )
    out = rules.select("rule_id", F.col("prediction").alias("rule_prediction")).join(
        found, "rule_id"
    )
    return out.withColumn("coverage", F.col("matched_rows") / n)


def rule_table(
    rules: DataFrame, metrics: DataFrame, features: Sequence[str], patterns: DataFrame
) -> DataFrame:
    """Rule metrics with the mined patterns that the rule's conditions name (pattern_<id>_...)."""
    text = rules.select("rule_id", F.explode(rule_text(features)).alias("condition"))
    ids = F.regexp_extract("condition", r"^pattern_(\d+)", 1)
    named = text.withColumn("pattern_id", F.nullif(ids, F.lit("")))
    listed = named.join(
        patterns.select(F.col("slot").cast("string").alias("pattern_id"),
                        F.array_join("items", "+").alias("__items"),
                        F.col("support").alias("__support")),
        "pattern_id", "left",
    )
    per_rule = listed.groupBy("rule_id").agg(
        F.array_join(F.sort_array(F.collect_set("condition")), " AND ").alias("conditions"),
        F.array_join(F.sort_array(F.collect_set("__items")), "|").alias("patterns"),
        F.max("__support").alias("pattern_support"),
    )
    return metrics.join(per_rule, "rule_id", "left")
