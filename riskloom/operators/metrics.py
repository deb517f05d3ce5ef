"""Classification metrics in single aggregations; curves by distributed prefix sums over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import round_exact
from riskloom.operators.skew import ordered_scan


def confusion(df: DataFrame, predicted: str = "predicted", actual: str = "actual", by: tuple[str, ...] = ()) -> DataFrame:
    """``tp, fp, tn, fn``, over all rows or per group."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    return df.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"),
        F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & ~a).alias("tn"),
        F.count_if(~p & a).alias("fn"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top.cast("double") / bottom)


def binary_metrics(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """Precision, recall, F1 and the ROC area of binary predictions from confusion counts.

    Undefined ratios are 0; the ROC area of hard predictions is the mean of sensitivity and
    specificity, 0 if a class is absent.
    """
    tp, fp, tn, fn = (F.col(name) for name in ("tp", "fp", "tn", "fn"))
    area = F.when((tp + fn == 0) | (tn + fp == 0), 0.0).otherwise((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2)
    values = {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "auc_roc": area,
    }
    if digits is not None:
        values = {name: round_exact(value, digits) for name, value in values.items()}
    return counts.withColumns(values)


def score_curve(df: DataFrame, score: str = "score", actual: str = "actual") -> DataFrame:
    """One row per distinct score with its positives and negatives and those of all higher scores."""
    positive = F.col(actual) == 1
    grouped = df.groupBy((-F.col(score).cast("double")).alias("__fall")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    above = {"pos_above": ("sum", F.col("pos")), "neg_above": ("sum", F.col("neg"))}
    walked = ordered_scan(grouped, [], ["__fall"], prior=above).na.fill(0, list(above))
    return walked.select((-F.col("__fall")).alias("score"), "pos", "neg", *above)


def curve_areas(curve: DataFrame) -> DataFrame:
    """``roc_auc`` and ``pr_auc`` from a ``score_curve``, in one aggregation.

    ROC: share of (positive, negative) pairs ranked rightly, ties half.  PR: trapezoids over falling
    thresholds, the curve starting at recall 0 with precision 1.  With one class only the ROC area is
    0; without positives recall counts as 1 everywhere, which leaves a PR area of one half.
    """
    pos, neg = F.col("pos"), F.col("neg")
    pos_above, neg_above = F.col("pos_above"), F.col("neg_above")
    n_above = pos_above + neg_above
    precision = (pos_above + pos) / (n_above + pos + neg)
    precision_above = F.when(n_above == 0, 1.0).otherwise(pos_above / n_above)
    sums = curve.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).cast("double").alias("p"),
        F.coalesce(F.sum("neg"), F.lit(0)).cast("double").alias("n"),
        F.sum(pos * (neg_above + neg / 2.0)).alias("misranked"),
        F.sum(pos * (precision + precision_above) / 2.0).alias("weighted"),
    )
    p, n = F.col("p"), F.col("n")
    return sums.select(
        F.when((p == 0) | (n == 0), 0.0).otherwise(1.0 - F.col("misranked") / p / n).alias("roc_auc"),
        F.when(p > 0, F.col("weighted") / p).when(n > 0, 0.5).otherwise(0.0).alias("pr_auc"),
    )


def evaluate_scores(df: DataFrame, *, decision: str = "decision", actual: str = "actual") -> DataFrame:
    """Precision, recall, PR and ROC area, row count and anomaly count of a scored table."""
    rows = df.select(
        F.when(F.col(decision) < 0, 1).otherwise(0).alias("predicted"),
        (-F.col(decision)).alias("score"),
        F.col(actual).alias("actual"),
    )
    counts = binary_metrics(confusion(rows)).select(
        "precision",
        "recall",
        (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_samples"),
        (F.col("tp") + F.col("fp")).alias("n_anomalies"),
    )
    areas = curve_areas(score_curve(rows)).select(
        round_exact(F.col("pr_auc"), 4).alias("pr_auc"), round_exact(F.col("roc_auc"), 4).alias("roc_auc")
    )
    # Two one-row tables side by side.
    names = ("precision", "recall", "pr_auc", "roc_auc", "n_samples", "n_anomalies")
    both = counts.unionByName(areas, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in names])
