"""Dashboard roll-ups: each is one aggregation over the table it needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import round_exact
from riskloom.operators.drift import latest_status
from riskloom.operators.tables import latest, within
from riskloom.schemas import ALERT_OPEN, HISTOGRAM_BUCKETS


def dashboard_kpis(transactions: DataFrame, scores: DataFrame, alerts: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: live transactions, blocked share, mean score over all scores, open alerts, model status."""
    live = F.col("deleted_at").isNull()
    counted = transactions.agg(
        F.count_if(live).alias("total_transactions"),
        F.count_if(live & (F.col("status") == "blocked")).alias("blocked"),
    )
    mean = scores.agg(F.avg("ensemble_score").alias("mean"))
    opened = alerts.agg(F.count_if(F.col("status") == ALERT_OPEN).alias("active_alerts"))
    parts = [counted, mean, opened, latest_status(runs)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    # Four one-row tables become one row.
    names = ("total_transactions", "blocked", "mean", "active_alerts", "model_status")
    one = rows.agg(*[F.max(name).alias(name) for name in names])
    n = F.col("total_transactions")
    share = F.when(n > 0, F.col("blocked") / n * 100).otherwise(0.0)
    return one.select(
        "total_transactions",
        round_exact(share, 2).alias("fraud_percentage"),
        round_exact(F.coalesce("mean", F.lit(0.0)), 2).alias("avg_score"),
        "active_alerts",
        "model_status",
    )


def bucket_hits(value: Column, buckets: Sequence[tuple], contiguous: bool = False) -> list[tuple[str, Column]]:
    """For each bucket its label and the aggregate that counts its values."""
    found, previous = [], None
    for low, high, label in buckets:
        start = value > previous if contiguous and previous is not None else value >= low
        found.append((label, F.count_if(start & (value <= high))))
        previous = high
    return found


def score_histogram(
    scores: DataFrame,
    score: str = "ensemble_score",
    buckets: Sequence[tuple] = HISTOGRAM_BUCKETS,
    contiguous: bool = False,
) -> DataFrame:
    """Count per bucket, zeros kept.

    Bucket bounds are whole numbers and a score between two buckets (20.5) is in none of them;
    ``contiguous=True`` lets every bucket begin right above the previous one.
    """
    counts = [F.struct(F.lit(label).alias("range"), hits.alias("count")) for label, hits in bucket_hits(F.col(score), buckets, contiguous)]
    return scores.agg(F.array(*counts).alias("buckets")).select(F.inline("buckets"))


def score_trend(
    scores: DataFrame, now, days: int = 7, *, score: str = "ensemble_score", time: str = "created_at"
) -> DataFrame:
    """Mean score per UTC day of the last ``days`` days, one decimal half-up; a day without scores is 0.

    Scores that are NULL or 0 do not count, nor do rows before the exact time ``now - days``.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    first, last = F.date_sub(F.to_date(moment), days - 1), F.to_date(moment)
    counted = within(scores, moment - F.expr(f"INTERVAL '{int(days)}' DAY"), None, time).filter(F.col(score) != 0)
    daily = counted.groupBy(F.to_date(time).alias("date")).agg(F.avg(score).alias("mean"))
    calendar = scores.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("date"))
    rounded = F.floor(F.col("mean") * 10 + 0.5) / 10
    return calendar.join(daily, "date", "left").select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce(rounded, F.lit(0.0)).alias("avg_score")
    )


def transactions_with_score(transactions: DataFrame, scores: DataFrame) -> DataFrame:
    """Transactions with their latest score and class; unscored ones stay, with NULLs."""
    time = [name for name in ("created_at",) if name in scores.columns]
    last = latest(scores.select("transaction_id", *time, "ensemble_score", "classification")).drop(*time)
    return transactions.join(last, "transaction_id", "left")


def transactions_per_day(df: DataFrame, time: str = "created_at") -> DataFrame:
    return df.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n_transactions"))


def alerts_per_rule(scored: DataFrame) -> DataFrame:
    """Fraud rows per fired rule."""
    fraud = scored.filter(F.col("classification") == "fraud")
    return fraud.select(F.explode("fired_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_alerts"))


def fraud_by_country(scored: DataFrame) -> DataFrame:
    return scored.groupBy("country").agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.count_if(F.col("classification") == "fraud").alias("n_fraud"),
    )


def transaction_detail(transactions: DataFrame, scores: DataFrame, reports: DataFrame, trail: DataFrame) -> DataFrame:
    """Transaction, its latest score and report, and trail: one row per trail entry.

    The trail is not collected into an array: its length per transaction has no bound.
    """
    report = latest(reports).select("transaction_id", F.col("status").alias("report_status"), "report_text")
    entry = trail.select(
        F.col("transaction_id").alias("__subject"),
        F.col("action_type").alias("entry_action"),
        F.col("created_at").alias("entry_at"),
        F.col("sha256_checksum").alias("entry_checksum"),
    )
    head = transactions.join(latest(scores), "transaction_id", "left").join(report, "transaction_id", "left")
    head = head.withColumn("__key", F.col("transaction_id").cast("string"))
    # An inner join lets adaptive execution split a transaction with very many entries; a left join would not.
    told = head.join(entry, F.col("__key") == F.col("__subject"))
    untold = head.join(entry.select("__subject").distinct(), F.col("__key") == F.col("__subject"), "left_anti")
    return told.unionByName(untold, allowMissingColumns=True).drop("__key", "__subject")
