"""Scores of binary predictions, calibration and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careloom.operators import gram
from careloom.operators.isotonic import isotonic_pools, with_pool_value
from careloom.operators.ordering import with_running_total

EPS = 1e-15


def recall(label: str, predicted: str) -> Column:
    """Share of true positives found; 0 when there are none. Rows with a null are ignored."""
    positive = F.col(predicted).isNotNull() & (F.col(label) == 1)
    found = F.count_if(positive & (F.col(predicted) == 1))
    return F.coalesce(F.try_divide(found, F.count_if(positive)), F.lit(0.0))


def log_loss(label: str, probability: str) -> Column:
    """Mean log loss with clipped probabilities; infinite without valid rows."""
    p = F.least(F.greatest(F.col(probability), F.lit(EPS)), F.lit(1 - EPS))
    loss = F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))
    valid = F.col(label).isNotNull() & F.col(probability).isNotNull()
    return F.coalesce(F.avg(F.when(valid, loss)), F.lit(float("inf")))


def brier(label: str, probability: str) -> Column:
    gap = F.col(probability) - F.col(label)
    return F.avg(gap * gap)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation, null when a column is constant (``corr`` fails there in ANSI mode)."""
    x = F.when(F.col(b).isNotNull(), F.col(a)).cast("double")
    y = F.when(F.col(a).isNotNull(), F.col(b)).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the highest score."""
    groups = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # by range: with a rare label nearly all scores can lie below a thousandth
    return with_running_total(groups, [], [F.col("score").desc()], None, {"tp": "pos", "fp": "neg"})


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC AUC (ties count half), average precision and the Youden threshold, from the counts."""
    table = score_table(df, label, score)
    totals = df.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    pos, neg = (totals.select(c).scalar() for c in ("p", "n"))
    table = table.withColumns({"__p": pos, "__n": neg})
    area = F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    youden = F.col("tp") / F.col("__p") - F.col("fp") / F.col("__n")
    return table.agg(
        (F.sum(area) / (F.max("__p") * F.max("__n"))).alias("auc"),
        F.sum(F.col("pos") / F.col("__p") * precision).alias("average_precision"),
        F.max_by("score", F.struct(F.round(youden, 12), "score")).alias("youden_threshold"),
        F.max(youden).alias("youden_index"),
    )


def threshold_metrics(
    df: DataFrame, label: str, score: str, threshold: float | Column = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, Brier score and log loss."""
    guess = F.col(score) >= threshold
    hit = F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(guess & hit).alias("tp"),
        F.count_if(guess & ~hit).alias("fp"),
        F.count_if(~guess & hit).alias("fn"),
        F.count_if(~guess & ~hit).alias("tn"),
        brier(label, score).alias("brier"),
        log_loss(label, score).alias("log_loss"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def classification_metrics(
    df: DataFrame, label: str, score: str, threshold: float = 0.5
) -> DataFrame:
    """All scores of one prediction table in one row."""
    ranked = ranking_metrics(df, label, score)
    fixed = threshold_metrics(df, label, score, threshold)
    return ranked.withColumns({c: fixed.select(c).scalar() for c in fixed.columns})


def calibrate(df: DataFrame, label: str, score: str, keep: Sequence[str] = ()) -> DataFrame:
    """Isotonic calibration: each row with its calibrated probability.

    The fit pools distinct scores, see :mod:`careloom.operators.isotonic`. Rows without a label take no
    part in it but are calibrated; a null score has no probability.
    """
    rows = df.select(*keep, F.col(label).cast("double").alias("__label"),
                     F.col(score).cast("double").alias("__score"))
    pools = isotonic_pools(rows, "__label", "__score")
    scores = rows.filter("__score is not null").select("__score").distinct()
    fitted = with_pool_value(scores, pools, "__score", "calibrated")
    out = rows.join(fitted, "__score", "left").select(*keep, "__label", "__score", "calibrated")
    return out.withColumnsRenamed({"__label": label, "__score": score})


def best_model(results: DataFrame, model: str = "model", metric: str = "recall") -> DataFrame:
    """Model of the highest mean metric over its splits."""
    means = results.groupBy(model).agg(F.avg(metric).alias(f"mean_{metric}"))
    return means.orderBy(F.col(f"mean_{metric}").desc(), model).limit(1)


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations of the listed features, in one pass over the rows.

    Blocks of the Gram matrix are summed inside the tasks, see :mod:`careloom.operators.gram`. Nulls are
    left out pair by pair; a constant feature has null correlations.
    """
    rows = df.select(
        F.lit(0).cast("long").alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    )
    found = gram.correlations(gram.pair_moments(rows, len(features)), len(features))
    names = F.array(*[F.lit(f) for f in features])
    return found.select(
        names[F.col("a").cast("int")].alias("feature_a"), names[F.col("b").cast("int")].alias("feature_b"), "correlation"
    )


def feature_distributions(
    df: DataFrame, features: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Smallest, largest, mean value and deviation of each feature, per class."""
    entries = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"))
          for f in features]
    )
    long = df.select(*by, F.inline(entries))
    return long.groupBy(*by, "feature").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
    )
