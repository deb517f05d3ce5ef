"""Tables that the queries share, all derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.alerts import action_transitions
from riskloom.operators.audit import audit_actions, audit_reports, audit_scoring
from riskloom.operators.context import VELOCITY_WINDOWS, ScoringContext, attach_context
from riskloom.operators.history import user_history
from riskloom.operators.metrics import binary_metrics, confusion
from riskloom.operators.reports import outcome_of
from riskloom.plans.scoring import alerts_from_scores, features_of, score_transactions
from riskloom.session import settle
from riskloom.sources import events as source

BURST = "tx_count_last_12h"
WINDOWS = {**VELOCITY_WINDOWS, BURST: 12 * 3600}
RULE_ONLY = {"rule": 1.0}
SPLIT_DAY = "2024-01-16 00:00:00"
DELETED_AT = "2024-02-01 00:00:00"


def split_day():
    return F.lit(SPLIT_DAY).cast("timestamp_ntz")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return source.transactions(spark, folder)


def stored_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Scored transactions as a table with status and deletions."""
    deleted = F.when(F.col("transaction_id") % 20 == 7, F.lit(DELETED_AT).cast("timestamp_ntz"))
    return scored(spark, folder).withColumn("deleted_at", deleted)


def context(spark: SparkSession, folder: str, with_history: bool = False) -> ScoringContext:
    rows = source.from_events(source.scan(spark, folder, "events"))
    return ScoringContext(
        blacklist=source.blacklist(spark, folder),
        known_cards=source.cards_before(rows),
        home_country=source.home_countries(spark, folder),
        history=user_history(rows) if with_history else None,
    )


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    events = source.scan(spark, folder, "events")
    return attach_context(transactions(spark, folder), context(spark, folder), WINDOWS, counted=events)


def scored(spark: SparkSession, folder: str, weights=RULE_ONLY, recent: str = BURST, **options) -> DataFrame:
    rows = transactions(spark, folder)
    return score_transactions(
        rows,
        context(spark, folder),
        weights=weights,
        recent=recent,
        windows=WINDOWS,
        counted=source.scan(spark, folder, "events"),
        **options,
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    """``transaction_id, ts, is_fraud`` and the ten features, history from legitimate rows."""
    events = source.scan(spark, folder, "events")
    rows = attach_context(transactions(spark, folder), context(spark, folder, with_history=True), counted=events)
    named = [column.alias(f"f_{name}") for name, column in features_of().items()]
    return rows.select("transaction_id", "ts", "is_fraud", *named)


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alerts_from_scores(scored(spark, folder))


def actions(alert_table: DataFrame) -> DataFrame:
    """Up to three analyst actions per alert."""
    key = F.col("transaction_id")
    steps = alert_table.filter(key % 4 > 0).select(
        "alert_id", key, "created_at", F.explode(F.sequence(F.lit(1), (key % 4).cast("int"))).alias("i")
    )
    kinds = F.array(F.lit("review"), F.lit("false_positive"), F.lit("revert"))
    i = F.col("i")
    return steps.select(
        F.concat_ws("-", "alert_id", "i").alias("action_id"),
        "alert_id",
        F.element_at(kinds, ((key + i) % 3 + 1).cast("int")).alias("action"),
        F.concat(F.lit("analyst-"), key % 7).alias("analyst_id"),
        F.when((key + i) % 2 == 0, F.concat(F.lit('checked "'), i, F.lit('"'))).alias("reason"),
        F.timestamp_add("HOUR", i, F.col("created_at")).alias("acted_at"),
    )


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    table = settle(alerts(spark, folder))
    return action_transitions(table, actions(table))


def reports_of(scored_rows: DataFrame) -> DataFrame:
    """Reports for two thirds of the fraud rows: pending, failed and completed ones."""
    key = F.col("transaction_id")
    text = (
        F.when(key % 5 == 1, "Error: timeout")
        .when(key % 5 == 2, "Error inesperado: timeout")
        .when(key % 5 > 2, F.concat(F.lit("Informe "), key))
    )
    rows = scored_rows.filter((F.col("classification") == "fraud") & (key % 3 != 0)).select(
        "transaction_id",
        text.alias("report_text"),
        F.lit("local-model").alias("model_name"),
        F.when(text.isNull(), "pending").otherwise(outcome_of(text)).alias("status"),
        F.when(key % 5 > 2, (key % 1000).cast("int")).alias("generation_time_ms"),
        (key % 4).cast("int").alias("retry_count"),
        F.timestamp_add("MINUTE", F.lit(1), F.col("created_at")).alias("created_at"),
    )
    given_up = (F.col("status") == "failed") & (F.col("retry_count") >= 3)
    return rows.withColumn("error", F.when(given_up, "timeout"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    return reports_of(scored(spark, folder))


def trail(spark: SparkSession, folder: str) -> DataFrame:
    return trail_of(settle(scored(spark, folder)))


def trail_of(rows: DataFrame) -> DataFrame:
    """All entries about scored rows that are stored, and therefore read several times."""
    table = alerts_from_scores(rows)
    done = reports_of(rows).filter(F.col("status") != "pending")
    moves = action_transitions(table, actions(table))
    return audit_scoring(rows).unionByName(audit_actions(moves)).unionByName(audit_reports(done))


def daily_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return daily_metrics_of(scored(spark, folder))


def daily_metrics_of(scored_rows: DataFrame) -> DataFrame:
    """Metrics of the rule classes against the proxy label, per day."""
    rows = scored_rows.select(
        F.to_date("ts").alias("day"),
        F.when(F.col("classification") == "fraud", 1).otherwise(0).alias("predicted"),
        F.col("is_fraud").alias("actual"),
    )
    return binary_metrics(confusion(rows, by=("day",)))


def model_runs(spark: SparkSession, folder: str) -> DataFrame:
    return model_runs_of(scored(spark, folder))


def model_runs_of(scored_rows: DataFrame) -> DataFrame:
    """One run per day, named by its day."""
    return daily_metrics_of(scored_rows).select(
        F.concat(F.lit("v"), F.date_format("day", "yyyy-MM-dd")).alias("model_version"),
        "precision",
        "recall",
        "f1",
        F.when(F.col("f1") > 0.15, "ready").otherwise("failed").alias("status"),
        (F.col("fp") > F.col("tp") * 5).alias("drift_detected"),
        F.col("day").cast("timestamp_ntz").alias("created_at"),
    )
