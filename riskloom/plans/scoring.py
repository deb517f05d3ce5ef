"""The whole scoring job: context -> rules and features -> model -> ensemble -> class -> alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ensemble import classify, combine, ml_score, status_from_class, threshold
from riskloom.functions.features import feature_columns
from riskloom.functions.rules import fired_rules, rule_flags, rule_score
from riskloom.operators.audit import audit_scoring
from riskloom.operators.context import ScoringContext, attach_context
from riskloom.operators.forest import Forest
from riskloom.operators.skew import SLIDING_LIMIT
from riskloom.schemas import ALERT_OPEN, RULE_WEIGHTS, THRESHOLD_TIERS
from riskloom.session import settle
from riskloom.sources.tables import batch_name, store_batch

SCORE_COLUMNS = ("rule_score", "ml_score", "ensemble_score", "threshold", "classification", "fired_rules")


def flags_of(recent: str = "tx_count_last_5min") -> dict[str, Column]:
    """Rule flags over the columns that ``attach_context`` provides."""
    return rule_flags(
        amount=F.col("amount"),
        recent=F.col(recent),
        listed=F.col("merchant_listed"),
        card=F.col("card_last4"),
        has_known_cards=F.col("has_known_cards"),
        card_is_known=F.col("card_is_known"),
        ts=F.col("ts"),
        country=F.col("country"),
        home=F.col("home_country"),
    )


def features_of() -> dict[str, Column]:
    """Feature Columns over the columns that ``attach_context`` provides."""
    return feature_columns(
        amount=F.col("amount"),
        avg_amount=F.col("avg_amount"),
        std_amount=F.col("std_amount"),
        count_5min=F.col("tx_count_last_5min"),
        count_1h=F.col("tx_count_last_1h"),
        ts=F.col("ts"),
        category=F.col("merchant_category"),
    )


def score_columns(
    flags: Mapping[str, Column],
    ml: Column,
    weights: Mapping[str, float] | None,
    rule_weights: Mapping[str, float] | None,
    tiers: Sequence[tuple],
    contiguous: bool,
    context_score: Column | None,
) -> dict[str, Column]:
    rules = rule_score(flags, rule_weights)
    score = combine(rules, ml, context_score, weights)
    limit = threshold(F.col("amount"), tiers, contiguous)
    verdict = classify(score, limit)
    return {
        "rule_score": rules,
        "ml_score": ml,
        "ensemble_score": score,
        "threshold": limit,
        "classification": verdict,
        "status": status_from_class(verdict),
        "fired_rules": fired_rules(flags, rule_weights),
    }


def score_transactions(
    df: DataFrame,
    context: ScoringContext,
    *,
    model: Forest | None = None,
    weights: Mapping[str, float] | None = None,
    rule_weights: Mapping[str, float] | None = None,
    tiers: Sequence[tuple] = THRESHOLD_TIERS,
    contiguous: bool = False,
    context_score: Column | None = None,
    recent: str = "tx_count_last_5min",
    windows: Mapping[str, int] | None = None,
    hot_limit: int = SLIDING_LIMIT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Score every transaction; without a ``model`` the anomaly score is 0.

    ``recent`` names the velocity column the rule looks at, ``windows`` adds or changes windows.
    """
    kept = [name for name in df.columns if name not in ("status", *SCORE_COLUMNS)]
    rows = attach_context(df, context, windows, hot_limit, counted)
    if model is None:
        ml = F.lit(0.0)
    else:
        rows = model.add_decision(rows, list(features_of().values()))
        ml = ml_score(F.col("decision"))
    added = score_columns(flags_of(recent), ml, weights, rule_weights, tiers, contiguous, context_score)
    return rows.select(*kept, *[column.alias(name) for name, column in added.items()])


def scores_of(scored: DataFrame) -> DataFrame:
    """The append-only score table of a scored batch."""
    return scored.select("transaction_id", *SCORE_COLUMNS, "created_at")


def alerts_from_scores(scored: DataFrame) -> DataFrame:
    """One open alert per fraud row."""
    return scored.filter(F.col("classification") == "fraud").select(
        F.concat(F.lit("alert-"), F.col("transaction_id")).alias("alert_id"),
        "transaction_id",
        F.lit(ALERT_OPEN).alias("status"),
        F.col("ensemble_score").alias("score"),
        "threshold",
        "classification",
        F.lit(None).cast("string").alias("reviewed_by"),
        F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
        "created_at",
    )


def store_scoring(scored: DataFrame, path: str, batch_id: str | None = None) -> DataFrame:
    """Scores, alerts and audit entries of a scored batch, each a batch of its table below ``path``; returns the stored rows.

    Storing a batch again replaces it. Without a ``batch_id`` its transactions and their times make its name.
    The batch is computed once, into a table of its own, and the three tables are projections of that.
    """
    stored = settle(scored)
    store_tables(stored, path, batch_id or batch_name(stored, "transaction_id", "created_at"))
    return stored


def store_tables(stored: DataFrame, path: str, batch_id: str) -> None:
    """The three projections of a scored batch that is read more than once."""
    store_batch(scores_of(stored), f"{path}/scores", batch_id)
    store_batch(alerts_from_scores(stored), f"{path}/alerts", batch_id)
    store_batch(audit_scoring(stored), f"{path}/audit", batch_id)


def weights_from_table(rule_metadata: DataFrame) -> dict[str, float]:
    """The weights of active rules: one row per rule there is, the greatest weight of a name; unknown names have no rule."""
    rows = rule_metadata.filter(F.col("is_active") & F.col("name").isin(*RULE_WEIGHTS))
    return {row["name"]: float(row["weight"]) for row in rows.groupBy("name").agg(F.max("weight").alias("weight")).collect()}
