"""Work queue for explanatory reports: enqueue, outcome, retry and status as table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.prompt import DEFAULT_TEMPLATE, build_prompt
from riskloom.operators.tables import latest
from riskloom.schemas import BACKOFF_BASE, FAILURE_PREFIX, MAX_RETRIES, REPORT_REQUEST

# Text of a report given up after n retries, followed by the error; detail of a failed report.
ABANDONED_TEXT = "Error después de {n} intentos: "
FAILURE_DETAIL = "Report generation failed. The LLM service may be unavailable."


def report_queue(scored: DataFrame, known: DataFrame) -> DataFrame:
    """Transactions whose latest score is fraud, without report or request in ``known``; enqueueing twice adds nothing."""
    fraud = latest(scored).filter(F.col("classification") == "fraud")
    return fraud.join(known.select("transaction_id"), "transaction_id", "left_anti").withColumn("retry_count", F.lit(0))


def request_message() -> Column:
    """A queue row as a JSON message."""
    return F.to_json(
        F.struct(
            F.col("transaction_id").cast("string").alias("transaction_id"),
            F.struct("rule_score", "ml_score", "ensemble_score", "fired_rules", "threshold").alias("score_breakdown"),
            F.struct(
                F.col("transaction_id").cast("string").alias("id"),
                F.col("amount").cast("double").alias("amount"),
                "currency",
                "merchant_name",
            ).alias("transaction"),
            F.col("retry_count"),
        )
    )


def parse_requests(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(parsed requests, malformed lines) of JSON messages, batch or stream."""
    schema = T.StructType([*REPORT_REQUEST.fields, T.StructField("__corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    parsed = lines.withColumn("__message", F.from_json(text, schema, options))
    good = F.col("__message").isNotNull() & F.col("__message.__corrupt").isNull()
    requests = parsed.filter(good).select(
        F.coalesce("__message.transaction_id", F.lit("unknown")).alias("transaction_id"),
        F.col("__message.score_breakdown").alias("score_breakdown"),
        F.col("__message.transaction").alias("transaction"),
        F.coalesce("__message.retry_count", F.lit(0)).alias("retry_count"),
        *[F.col(name) for name in lines.columns if name != text],
    )
    return requests, parsed.filter(~good).drop("__message")


def with_prompt(rows: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Queue rows with the ``prompt`` for the report writer."""
    names = (
        "transaction_id",
        "amount",
        "currency",
        "merchant_name",
        "rule_score",
        "ml_score",
        "ensemble_score",
        "threshold",
        "fired_rules",
    )
    return rows.withColumn("prompt", build_prompt(template=template, **{name: F.col(name) for name in names}))


def outcome_of(text: Column) -> Column:
    """Only texts that begin with the failure prefix count as failed."""
    return F.when(F.startswith(text, F.lit(FAILURE_PREFIX)), "failed").otherwise("completed")


def finished_reports(answers: DataFrame, model_name: str) -> DataFrame:
    """Report rows for answered requests (``transaction_id, report_text, retry_count, created_at``)."""
    return answers.select(
        "transaction_id",
        "report_text",
        F.lit(model_name).alias("model_name"),
        outcome_of(F.col("report_text")).alias("status"),
        F.lit(None).cast("int").alias("generation_time_ms"),
        "retry_count",
        F.lit(None).cast("string").alias("error"),
        "created_at",
    )


def retry_plan(attempts: DataFrame, max_retries: int = MAX_RETRIES, base: int = BACKOFF_BASE) -> DataFrame:
    """What becomes of attempts that raised (``retry_count, failed_at``): another try or failure.

    The n-th retry is due ``base ** n`` seconds after the failure.
    """
    again = F.coalesce(F.col("retry_count"), F.lit(0)) + 1
    over = again > max_retries
    delay = F.when(~over, F.pow(F.lit(float(base)), again).cast("int"))
    return attempts.withColumns(
        {
            "outcome": F.when(over, "failed").otherwise("retry"),
            "next_retry_count": F.when(~over, again),
            "delay_seconds": delay,
            "next_attempt_at": F.timestamp_add("SECOND", delay, F.col("failed_at")),
        }
    )


def abandoned_reports(attempts: DataFrame, model_name: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failed report rows for attempts (``transaction_id, retry_count, error, failed_at``) out of retries."""
    text = F.concat(F.lit(ABANDONED_TEXT.format(n=max_retries)), F.coalesce("error", F.lit("")))
    return attempts.filter(F.coalesce("retry_count", F.lit(0)) >= max_retries).select(
        "transaction_id",
        text.alias("report_text"),
        F.lit(model_name).alias("model_name"),
        F.lit("failed").alias("status"),
        F.lit(None).cast("int").alias("generation_time_ms"),
        "retry_count",
        "error",
        F.col("failed_at").alias("created_at"),
    )


def report_status(transactions: DataFrame, reports: DataFrame) -> DataFrame:
    """Per transaction: 404 without a report, 202 while pending, else 200; failed ones with a detail."""
    report = latest(reports).select("transaction_id", F.col("status").alias("report_status"), "report_text")
    joined = transactions.select("transaction_id").join(report, "transaction_id", "left")
    status = F.col("report_status")
    return joined.withColumns(
        {
            "status_code": F.when(status.isNull(), 404).when(status == "pending", 202).otherwise(200),
            "error_detail": F.when(status == "failed", FAILURE_DETAIL),
        }
    )
