"""Training job: history -> velocity -> features -> forest -> evaluation -> saved model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.context import ScoringContext, attach_context
from riskloom.operators.forest import Forest, fit_forest, save_forest
from riskloom.operators.history import user_history
from riskloom.operators.metrics import evaluate_scores
from riskloom.operators.skew import SLIDING_LIMIT
from riskloom.plans.scoring import features_of
from riskloom.schemas import FEATURE_NAMES, FOREST_PSI, FOREST_SEED, FOREST_TREES
from riskloom.session import settle


@dataclass(frozen=True)
class Trained:
    forest: Forest
    metrics: DataFrame


def training_features(df: DataFrame, *, label: str = "is_fraud", hot_limit: int = SLIDING_LIMIT) -> DataFrame:
    """``transaction_id``, the ten features and the label; the history comes from legitimate rows only."""
    context = ScoringContext(history=user_history(df, label=label))
    rows = df
    for name in ("card_last4", "country", "merchant_name"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    enriched = attach_context(rows, context, hot_limit=hot_limit, counted=df)
    return enriched.select(
        "transaction_id", *[column.alias(f"f_{name}") for name, column in features_of().items()], label
    )


def train(
    df: DataFrame,
    *,
    label: str = "is_fraud",
    n_trees: int = FOREST_TREES,
    psi: int = FOREST_PSI,
    seed: int = FOREST_SEED,
    path: str | None = None,
    hot_limit: int = SLIDING_LIMIT,
) -> Trained:
    """Fit on all rows with their label share as contamination, evaluate on them, optionally save.

    The feature table is settled once, since counting, sampling, scoring and evaluating all read it.
    """
    rows = settle(training_features(df, label=label, hot_limit=hot_limit))
    columns = [F.col(f"f_{name}") for name in FEATURE_NAMES]
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(label), F.count(F.lit(1))).alias("share")).first()
    grown = fit_forest(rows, columns, n_trees=n_trees, psi=psi, seed=seed, n_rows=size["n"])
    # One pass of scores serves the calibration and the evaluation.
    scores = settle(grown.add_scores(rows, columns).select("anomaly", label))
    forest = grown.calibrated(scores, size["share"])
    if path is not None:
        save_forest(forest, path)
    decided = scores.withColumn("decision", F.col("anomaly") - forest.offset)
    return Trained(forest, evaluate_scores(decided, actual=label))
