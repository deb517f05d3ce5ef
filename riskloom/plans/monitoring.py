"""Monitoring job: feature drift and classification metrics of a period, recorded as a model run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.drift import feature_drift, model_run, retraining_recommendation, samples
from riskloom.operators.metrics import binary_metrics, confusion
from riskloom.schemas import DRIFT_THRESHOLD
from riskloom.sources.tables import append


@dataclass(frozen=True)
class Monitored:
    """Drift per feature, metrics of the period, and the advice drawn from both."""

    drift: DataFrame
    metrics: DataFrame
    advice: DataFrame


def monitor(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    *,
    predicted: str = "predicted",
    actual: str = "actual",
    threshold: float = DRIFT_THRESHOLD,
) -> Monitored:
    """Compare the features of two periods and rate the predictions of the current one."""
    drift = feature_drift(samples(reference, current, columns), threshold)
    metrics = binary_metrics(confusion(current, predicted, actual))
    return Monitored(drift, metrics, retraining_recommendation(drift, metrics))


def track_run(found: Monitored, path: str, version: str, created_at) -> DataFrame:
    """Append the run, with its metrics and whether any feature drifted; returns the new row."""
    spark = found.metrics.sparkSession
    numbers = found.metrics.select("precision", "recall", "f1", "auc_roc").first().asDict()
    drifted = not found.drift.filter(F.col("drift_detected")).isEmpty()
    run = model_run(spark, version, numbers, drifted, created_at)
    append(run, path)
    return run
