"""Audit entries with SHA-256 checksums over canonical JSON, trails and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.jsontext import json_double, json_int, json_object, json_string, json_string_list
from riskloom.operators.skew import HOT_LIMIT, ordered_scan

ENTRY_COLUMNS = (
    "action_type",
    "transaction_id",
    "user_id",
    "previous_status",
    "new_status",
    "details",
    "sha256_checksum",
    "created_at",
)
_TEXT_KEYS = ("action_type", "transaction_id", "user_id", "previous_status", "new_status")


def canonical_json() -> Column:
    """Text of an entry row, from its own columns; empty columns are left out, ``details`` is JSON already."""
    members = {key: F.when(F.col(key).isNotNull(), json_string(F.col(key).cast("string"))) for key in _TEXT_KEYS}
    return json_object({**members, "details": F.col("details")}, drop_null=True)


def checksum() -> Column:
    return F.sha2(canonical_json(), 256)


def entries(df: DataFrame) -> DataFrame:
    """Complete entry rows: missing columns become NULL, the checksum is added."""
    for key in ENTRY_COLUMNS:
        if key not in df.columns and key != "sha256_checksum":
            df = df.withColumn(key, F.lit(None).cast("string"))
    texts = [F.col(key).cast("string").alias(key) for key in _TEXT_KEYS]
    plain = df.select(*texts, "details", "created_at")
    return plain.withColumn("sha256_checksum", checksum()).select(*ENTRY_COLUMNS)


def audit_scoring(scored: DataFrame) -> DataFrame:
    """``transaction_scored`` entries with the six score details."""
    details = json_object(
        {
            "rule_score": json_double(F.col("rule_score")),
            "ml_score": json_double(F.col("ml_score")),
            "ensemble_score": json_double(F.col("ensemble_score")),
            "threshold": json_double(F.col("threshold")),
            "classification": json_string(F.col("classification")),
            "fired_rules": json_string_list(F.col("fired_rules")),
        }
    )
    return entries(
        scored.select(
            F.lit("transaction_scored").alias("action_type"),
            "transaction_id",
            "user_id",
            details.alias("details"),
            "created_at",
        )
    )


def audit_actions(transitions: DataFrame) -> DataFrame:
    """Entries of analyst actions, from ``alerts.action_transitions``."""
    details = json_object({"alert_id": json_string(F.col("alert_id")), "reason": json_string(F.col("reason"))})
    return entries(
        transitions.select(
            F.col("action").alias("action_type"),
            "transaction_id",
            F.col("analyst_id").alias("user_id"),
            "previous_status",
            "new_status",
            details.alias("details"),
            F.col("acted_at").alias("created_at"),
        )
    )


def audit_reports(reports: DataFrame) -> DataFrame:
    """``report_generated`` / ``report_failed`` entries.

    A report that used up its retries carries an ``error``; its details name the error and no
    generation time.
    """
    failed = F.col("status") == "failed"
    common = {
        "model": json_string(F.col("model_name")),
        "status": json_string(F.col("status")),
        "retry_count": json_int(F.col("retry_count")),
    }
    finished = json_object({**common, "generation_time_ms": json_int(F.col("generation_time_ms"))})
    given_up = json_object({**common, "error": json_string(F.col("error"))})
    return entries(
        reports.select(
            F.when(failed, "report_failed").otherwise("report_generated").alias("action_type"),
            "transaction_id",
            F.when(failed & F.col("error").isNotNull(), given_up).otherwise(finished).alias("details"),
            "created_at",
        )
    )


def trail_for_transaction(trail: DataFrame, transaction_id) -> DataFrame:
    """All entries of a transaction, oldest first, whether or not it was deleted."""
    return _sorted(trail.filter(F.col("transaction_id") == F.lit(transaction_id).cast("string")))


def trail_for_analyst(trail: DataFrame, analyst_id) -> DataFrame:
    """All entries of an analyst, oldest first."""
    return _sorted(trail.filter(F.col("user_id") == F.lit(analyst_id).cast("string")))


def _sorted(trail: DataFrame) -> DataFrame:
    return trail.orderBy("created_at", "sha256_checksum")


def chains(trail: DataFrame, hot_limit: int = HOT_LIMIT) -> DataFrame:
    """The trails of all transactions at once: every entry with its ``step`` in its transaction's chain."""
    linked = trail.filter(F.col("transaction_id").isNotNull())
    return ordered_scan(linked, ["transaction_id"], ["created_at", "sha256_checksum"], position="step", hot_limit=hot_limit)


def verify(trail: DataFrame) -> DataFrame:
    """Entries whose content no longer yields their checksum."""
    return trail.filter(~F.col("sha256_checksum").eqNullSafe(checksum()))
