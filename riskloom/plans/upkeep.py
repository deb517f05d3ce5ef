"""History, known cards and dashboard roll-ups kept up to date batch by batch, instead of read anew from all rows.

A batch or a day that is stored again replaces its part, so repeats and corrections are taken back by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.numbers import round_exact
from riskloom.operators.dashboard import bucket_hits
from riskloom.operators.drift import latest_status
from riskloom.operators.history import known_cards
from riskloom.schemas import ALERT_OPEN, HISTOGRAM_BUCKETS
from riskloom.sources.tables import read_store, store_batch

MOMENTS = "user_id long, n_transactions long, total decimal(30,0), squares decimal(38,0)"
MEASURES = "measure string, name string, n long, total double, day date"


def moments_of(df: DataFrame, *, user="user_id", amount="amount", label: str | None = "is_fraud") -> DataFrame:
    """Per user over the legitimate rows: count, sum and sum of squares of the amounts in whole cents."""
    rows = df if label is None else df.filter(F.col(label) == 0)
    cents = (F.col(amount).cast("decimal(12,2)") * 100).cast("decimal(12,0)")
    return rows.groupBy(F.col(user).alias("user_id")).agg(
        F.count(cents).alias("n_transactions"), _whole(F.sum(cents), 30).alias("total"), _whole(F.sum(cents * cents), 38).alias("squares")
    )


def _whole(value: Column, digits: int) -> Column:
    return F.coalesce(value, F.lit(0)).cast(f"decimal({digits},0)")


def merged_moments(moments: DataFrame) -> DataFrame:
    """One row per user of any number of moments: they add up."""
    return moments.groupBy("user_id").agg(
        F.sum("n_transactions").alias("n_transactions"), _whole(F.sum("total"), 30).alias("total"), _whole(F.sum("squares"), 38).alias("squares")
    )


def history_of(moments: DataFrame) -> DataFrame:
    """``operators.history.user_history`` from moments of one row per user; null for users without an amount."""
    n = F.col("n_transactions")
    has = n > 0
    # About a whole number next to the mean, so that nothing cancels.
    middle = F.floor(F.when(has, F.col("total") / n)).cast("decimal(14,0)")
    rest = (F.col("total") - middle * n).cast("decimal(24,0)")
    about = F.col("squares") - middle * (F.col("total") + rest).cast("decimal(24,0)")
    variance = about.cast("double") / n - F.pow(rest.cast("double") / n, F.lit(2))
    return moments.select(
        "user_id",
        F.when(has, (F.col("total") / 100).cast("decimal(32,2)").cast("double") / n).alias("avg_amount"),
        F.when(has, F.sqrt(F.greatest(variance, F.lit(0.0))) / 100).alias("std_amount"),
        "n_transactions",
    )


def update_history(rows: DataFrame, path: str, batch_id: str, *, label: str | None = "is_fraud") -> None:
    """Add a batch of transactions, or put it in place of the one of the same name; only these rows are read."""
    store_batch(moments_of(rows, label=label), f"{path}/moments", batch_id, None)


def update_cards(rows: DataFrame, path: str, batch_id: str) -> None:
    """The (user, card) pairs of a batch; pairs that several batches have go on when one of them is replaced."""
    store_batch(known_cards(rows), f"{path}/cards", batch_id, None)


def kept_history(spark: SparkSession, path: str) -> DataFrame:
    """The history over all batches, from a row per user and batch."""
    return history_of(merged_moments(read_store(spark, f"{path}/moments", MOMENTS)))


def kept_cards(spark: SparkSession, path: str) -> DataFrame:
    """The distinct (user, card) pairs of all batches."""
    return read_store(spark, f"{path}/cards").select("user_id", "card_last4").distinct()


def day_measures(transactions: DataFrame, scored: DataFrame, alerts: DataFrame, *, buckets: Sequence[tuple] = HISTOGRAM_BUCKETS) -> DataFrame:
    """What each day (of ``created_at``) adds to the dashboard, as rows of ``MEASURES``."""
    day = F.to_date("created_at").alias("day")
    live = F.col("deleted_at").isNull()

    def listed(table: DataFrame, *measures: tuple[str, str, Column, Column]) -> DataFrame:
        """Rows of (measure, name, n, total) from one aggregate per day."""
        row = [F.struct(F.lit(m).alias("measure"), F.lit(name).alias("name"), n.alias("n"), total.alias("total")) for m, name, n, total in measures]
        return table.groupBy(day).agg(F.array(*row).alias("rows")).select("day", F.inline("rows"))

    none = F.lit(0.0)
    score = F.col("ensemble_score")
    hits = [("bucket", label, hit, none) for label, hit in bucket_hits(score, buckets)]
    fraud = scored.filter(F.col("classification") == "fraud").select(day, F.explode("fired_rules").alias("name"))
    parts = [
        listed(
            transactions,
            ("created", "", F.count(F.lit(1)), none),
            ("live", "", F.count_if(live), none),
            ("blocked", "", F.count_if(live & (F.col("status") == "blocked")), none),
        ),
        listed(scored, ("score", "", F.count(score), F.coalesce(F.sum(score), none)), *hits),
        listed(alerts, ("open", "", F.count_if(F.col("status") == ALERT_OPEN), none)),
        fraud.groupBy("day", "name").agg(F.count(F.lit(1)).alias("n")).select("day", F.lit("rule").alias("measure"), "name", "n", none.alias("total")),
    ]
    return reduce(DataFrame.unionByName, parts)


def update_days(measures: DataFrame, path: str) -> None:
    """Put the measures of their days in place of what these days had; other days are not touched."""
    writer = measures.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def kept_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASURES).parquet(path)


def kpis_of(measures: DataFrame, runs: DataFrame) -> DataFrame:
    """``operators.dashboard.dashboard_kpis`` from the measures of all days."""

    def total(measure: str, column: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col(column))), F.lit(0))

    sums = measures.agg(
        total("live").alias("total_transactions"), total("blocked").alias("blocked"), total("score").alias("n"), total("score", "total").alias("sum"), total("open").alias("active_alerts")
    )
    both = sums.unionByName(latest_status(runs), allowMissingColumns=True)
    one = both.agg(*[F.max(name).alias(name) for name in (*sums.columns, "model_status")])
    live = F.col("total_transactions")
    return one.select(
        "total_transactions",
        round_exact(F.when(live > 0, F.col("blocked") / live * 100).otherwise(0.0), 2).alias("fraud_percentage"),
        round_exact(F.when(F.col("n") > 0, F.col("sum") / F.col("n")).otherwise(0.0), 2).alias("avg_score"),
        "active_alerts",
        "model_status",
    )


def histogram_of(measures: DataFrame) -> DataFrame:
    rows = measures.filter(F.col("measure") == "bucket")
    return rows.groupBy(F.col("name").alias("range")).agg(F.sum("n").alias("count"))


def per_day(measures: DataFrame) -> DataFrame:
    rows = measures.filter((F.col("measure") == "created") & (F.col("n") > 0))
    return rows.groupBy("day").agg(F.sum("n").alias("n_transactions"))


def per_rule(measures: DataFrame) -> DataFrame:
    rows = measures.filter(F.col("measure") == "rule")
    return rows.groupBy(F.col("name").alias("rule")).agg(F.sum("n").alias("n_alerts"))
