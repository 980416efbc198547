"""Permutation importance over Monte-Carlo splits and its aggregation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careloom.operators import evaluation as ev
from careloom.operators.features import mc_splits
from careloom.operators.ordering import hash_bucket, hash_text, with_position
from careloom.session import cut_lineage

#: Number that stands for no permuted feature.
BASELINE = -1
#: Models that are fitted at the same time, each from a thread of the driver.
FITS = 4
#: Splits that one word of a fold mask holds.
MASK_BITS = 62


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def positive_probability() -> Column:
    return vector_to_array("probability")[1]


def feature_array(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def used_features(model: Transformer, n: int) -> list[int]:
    """Numbers of the features that can change a prediction: all n if the model doesn't tell."""
    for name in ("featureImportances", "coefficients"):
        weights = getattr(model, name, None)
        if weights is not None:
            return [int(i) for i in np.flatnonzero(weights.toArray())]
    return list(range(n))


def permuted(df: DataFrame, key: str, features: Sequence[str], seed: str | int) -> DataFrame:
    """Each row with the feature values of a random other row in ``donor``.

    Rows are numbered twice, by two seeded hashes, and joined on the number: a permutation without
    a driver, a global sort or a random function that a retry could change.
    """

    return _with_donor(df, key, F.struct(*features), seed)


def _with_donor(df: DataFrame, key: str, donor: Column, seed: str | int) -> DataFrame:
    def numbered(tag: str, *cols: Column) -> DataFrame:
        rows = df.withColumn("__h", hash_text(f"{seed}-{tag}", key))
        ranked = with_position(
            rows, [], [F.col("__h"), F.col(key)], hash_bucket(F.col("__h")), "__r"
        )
        return ranked.select("__r", *cols)

    own = numbered("row", *map(F.col, df.columns))
    return own.join(numbered("donor", donor.alias("donor")), "__r").drop("__r")


def permuted_arrays(
    df: DataFrame, key: str, label: str, features: Sequence[str], seed: str | int
) -> DataFrame:
    """(key, label, x, donor): each row's features and those of a random other row, as arrays."""
    rows = df.select(key, label, feature_array(features).alias("x"))
    return cut_lineage(_with_donor(rows, key, F.col("x"), seed))


def split_importance(
    model: Transformer, test: DataFrame, label: str, features: Sequence[str]
) -> DataFrame:
    """Recall and log loss of the model, and what each loses when one feature is permuted.

    ``test`` comes from :func:`permuted_arrays`. A variant is a row and the number of the feature that the
    donor gives; all variants are scored by one transform. Features that the model doesn't use
    lose nothing and aren't varied.
    """
    used = used_features(model, len(features))
    numbers = F.array(*[F.lit(i) for i in [BASELINE, *used]])
    varied = test.select(label, "x", "donor", F.explode(numbers).alias("i"))
    values = F.transform("x", lambda v, j: F.when(j == F.col("i"), F.col("donor")[j]).otherwise(v))
    scored = model.transform(varied.select(label, "i", array_to_vector(values).alias("features")))
    scored = scored.withColumn("__p", positive_probability())
    scores = scored.groupBy("i").agg(
        ev.recall(label, "prediction").alias("recall"), ev.log_loss(label, "__p").alias("logloss")
    )
    scores = cut_lineage(scores)
    base = scores.filter(F.col("i") == BASELINE).select(
        F.col("recall").alias("base_recall"), F.col("logloss").alias("base_logloss")
    )
    lost = {r["i"]: (r["recall"], r["logloss"]) for r in scores.filter(F.col("i") != BASELINE).collect()}
    # one row per feature: the model's own list is as long
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), *[
            (F.lit(lost[i][k]) if i in lost else F.col(f"base_{m}")).alias(m) for k, m in enumerate(("recall", "logloss"))
        ])
        for i, f in enumerate(features)
    ])
    return base.select("base_recall", "base_logloss", F.inline(entries)).select(
        "feature", "base_recall", "base_logloss",
        (F.col("base_recall") - F.col("recall")).alias("recall_drop"),
        (F.col("logloss") - F.col("base_logloss")).alias("logloss_rise"),
    )


def scaled(importance: Column, performance: Column, metric: str) -> Column:
    """Importance times recall, or over log loss (0 when the loss is 0 or infinite)."""
    if metric == "recall":
        return importance * performance
    return F.when((performance > 0) & (performance < float("inf")),
                  importance / performance).otherwise(F.lit(0.0))


def fold_masks(splits: DataFrame, key: str, n_splits: int) -> DataFrame:
    """(key, mask): bit i - 1 of the mask's words says whether the row trains in split i."""
    words = -(-n_splits // MASK_BITS)
    place = F.col("split") - 1
    bits = [
        F.coalesce(F.bit_or(F.when(F.floor(place / MASK_BITS) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (place % MASK_BITS).cast("int")))), F.lit(0).cast("long"))
        for w in range(words)
    ]
    return splits.groupBy(key).agg(F.array(*bits).alias("mask"))


def in_split(split: int) -> Column:
    word, bit = divmod(split - 1, MASK_BITS)
    return F.col("mask")[word].bitwiseAND(F.lit(1 << bit)) != 0


def mc_cv_importance(
    train: DataFrame, test: DataFrame, key: str, label: str, features: Sequence[str],
    models: Mapping[str, Estimator], n_splits: int = 25, train_prop: float = 0.8,
    metric: str = "recall", seed: str | int = 42, fits: int = FITS,
) -> DataFrame:
    """Permutation importance per method, split and feature; the test rows are the same always.

    Training rows are written once, with a mask of the splits they train in; a split is a filter on it. The
    driver only walks the fits, ``fits`` of them at a time; rows, splits and scores stay in Spark.
    """
    masks = fold_masks(mc_splits(train, key, label, n_splits, train_prop, seed), key, n_splits)
    table = cut_lineage(assemble(train, features).select(key, label, "features").join(masks, key))

    def one_split(split: int) -> list[DataFrame]:
        rows = table.filter(in_split(split)).drop("mask")
        varied = permuted_arrays(test, key, label, features, f"{seed}-{split}")
        found = []
        for name, estimator in models.items():
            model = estimator.copy({estimator.getParam("labelCol"): label}).fit(rows)
            part = split_importance(model, varied, label, features)
            found.append(part.select(F.lit(name).alias("method"), F.lit(split).alias("split"), "*"))
        return found

    with ThreadPoolExecutor(max_workers=max(1, fits)) as pool:
        target = inheritable_thread_target(train.sparkSession)(one_split)
        parts = [part for found in pool.map(target, range(1, n_splits + 1)) for part in found]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    performance = F.col("base_recall") if metric == "recall" else F.col("base_logloss")
    gain = F.col("recall_drop") if metric == "recall" else F.col("logloss_rise")
    return out.select(
        "method", "split", "feature", gain.alias("importance"),
        scaled(gain, performance, metric).alias("scaled_importance"),
        F.col("base_recall").alias("recall"), F.col("base_logloss").alias("logloss"),
    )


def summarize_splits(results: DataFrame) -> DataFrame:
    """Mean, deviation and count per method and feature over the splits."""
    return results.groupBy("method", "feature").agg(
        F.avg("scaled_importance").alias("scaled_importance_mean"),
        F.stddev_samp("scaled_importance").alias("scaled_importance_std"),
        F.count("scaled_importance").alias("scaled_importance_count"),
        F.avg("importance").alias("importance_mean"),
        F.stddev_samp("importance").alias("importance_std"),
        F.avg("recall").alias("recall_mean"),
        F.avg("logloss").alias("logloss_mean"),
    )


def aggregate_importance(results: DataFrame, metric: str = "recall") -> DataFrame:
    """One importance per feature over all methods.

    Min-max per method, scaled by the method's performance, summed per feature, min-max again, and
    scaled by the best performance.
    """
    performance = F.max(f"{metric}_mean")
    methods = results.groupBy("method").agg(
        F.min("importance_mean").alias("__lo"), F.max("importance_mean").alias("__hi"),
        performance.alias("__perf"),
    )
    if metric == "recall":
        best = F.max("__perf")
    else:
        best = F.min(F.when(F.col("__perf") > 0, F.col("__perf")))
    top = methods.agg(F.coalesce(best, F.lit(0.0)).alias("best")).scalar()

    def min_max(value: str, lo: str, hi: str) -> Column:
        return F.when(
            F.col(hi) > F.col(lo), (F.col(value) - F.col(lo)) / (F.col(hi) - F.col(lo))
        ).otherwise(0.0)

    normal = results.join(methods, "method").withColumn(
        "__n", min_max("importance_mean", "__lo", "__hi")
    )
    sums = normal.groupBy("feature").agg(
        F.sum(scaled(F.col("__n"), F.col("__perf"), metric)).alias("__s")
    )
    ends = sums.agg(F.min("__s").alias("lo"), F.max("__s").alias("hi"))
    out = sums.withColumns(
        {"__lo": ends.select("lo").scalar(), "__hi": ends.select("hi").scalar(), "__best": top}
    ).withColumn("importance_normalized", min_max("__s", "__lo", "__hi"))
    boost = F.when(F.col("__best") > 0, F.col("__best")).otherwise(1.0)
    return out.select(
        "feature", "importance_normalized",
        (F.col("importance_normalized") * boost).alias("importance_scaled"),
    )


def cross_band_summary(
    importance: DataFrame, band: str, feature: str, value: str, top: int = 50
) -> DataFrame:
    """Spread of each feature's importance over the bands in which it ranks in the top."""
    ranked = with_position(
        importance.withColumn("__d", -F.col(value)), [band], [F.col("__d"), F.col(feature)],
        F.floor(F.col("__d") * 1000), "__r",
    ).filter(F.col("__r") <= top)
    out = ranked.groupBy(feature).agg(
        F.count(F.lit(1)).alias("n_age_bands"),
        F.avg(value).alias("mean_importance"),
        F.stddev_samp(value).alias("sd_importance"),
        F.min(value).alias("min_importance"),
        F.max(value).alias("max_importance"),
    )
    return out.withColumns(
        {
            "range_importance": F.col("max_importance") - F.col("min_importance"),
            "cv_importance": F.try_divide(F.col("sd_importance"), F.col("mean_importance")) * 100,
        }
    )


def importance_rank(importance: DataFrame, feature: str, value: str) -> DataFrame:
    """Rank (1 = most important) and percent rank of every feature."""
    ranked = with_position(
        importance.withColumn("__d", -F.col(value)), [], [F.col("__d"), F.col(feature)],
        F.floor(F.col("__d") * 1000), "importance_rank",
    ).drop("__d")
    n = importance.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("n")).scalar()
    return ranked.withColumn("percentile", 1 - (F.col("importance_rank") - 1) / n)


def native_vs_explained(
    native: DataFrame, explained: DataFrame, feature: str = "feature",
    a: str = "native_importance", b: str = "relative_importance",
) -> DataFrame:
    """Both importances of the shared features and their correlation."""
    means = explained.groupBy(feature).agg(F.avg(b).alias(b))
    both = native.select(feature, a).join(means, feature)
    return both.withColumn("correlation", both.agg(ev.correlation(a, b).alias("c")).scalar())


def permutation_test(
    df: DataFrame, key: str, features: Sequence[str], feature: str,
    importance: Callable[[DataFrame, str], DataFrame], n: int = 100, seed: str | int = 42,
) -> DataFrame:
    """Share of permutations in which the feature's importance reaches the observed one.

    ``importance(rows, by)`` gives (by, importance) per value of the grouping column. All
    permutations are drawn and measured in one job.
    """
    observed = df.withColumn("permutation", F.lit(0))
    draws = df.withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def numbered(tag: str, *cols: str) -> DataFrame:
        rows = draws.withColumn("__h", hash_text(f"{seed}-{tag}", "permutation", key))
        return with_position(
            rows, ["permutation"], [F.col("__h"), F.col(key)], hash_bucket(F.col("__h")), "__r"
        ).select("permutation", "__r", *cols)

    rest = [c for c in df.columns if c != feature]
    shuffled = numbered("row", *rest).join(numbered("value", feature), ["permutation", "__r"])
    scores = importance(
        observed.unionByName(shuffled.drop("__r").select("permutation", *df.columns)),
        "permutation",
    )
    actual = F.max(F.when(F.col("permutation") == 0, F.col("importance")))
    values = F.collect_list(F.when(F.col("permutation") > 0, F.col("importance")))  # n values
    out = scores.agg(actual.alias("observed"), values.alias("__v"))
    reached = F.size(F.filter("__v", lambda v: v >= F.col("observed")))
    return out.select(
        F.lit(feature).alias("feature"), "observed", (reached / n).alias("p_value")
    )
