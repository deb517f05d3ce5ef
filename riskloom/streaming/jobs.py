"""Streaming scoring, velocity, KPIs, sinks and de-duplication.

Row-wise parts reuse the batch Columns, counts come from keyed state; every micro-batch is written into
a folder of its own, so that a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from riskloom.functions.ensemble import ml_score
from riskloom.operators.context import VELOCITY_WINDOWS, ScoringContext, join_user_context, mark_blacklisted
from riskloom.operators.forest import Forest
from riskloom.operators.history import velocity
from riskloom.operators.skew import SLIDING_LIMIT
from riskloom.plans.scoring import SCORE_COLUMNS, features_of, flags_of, score_columns, store_tables
from riskloom.schemas import THRESHOLD_TIERS, WINDOW_1H, WINDOW_5MIN
from riskloom.sources.tables import store_batch
from riskloom.streaming.clock import event_time
from riskloom.streaming.velocity import keyed_velocity

RECENT = "tx_count_last_5min"


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def score_stream(
    stream: DataFrame,
    context: ScoringContext,
    *,
    weights: Mapping[str, float] | None = None,
    rule_weights: Mapping[str, float] | None = None,
    ml: Column | None = None,
    model: Forest | None = None,
    windows: Mapping[str, int] | None = None,
    recent: str = RECENT,
    clock: str | None = None,
    late: int = 3600,
) -> DataFrame:
    """Scoring of a stream against context tables, which ``context.settled()`` has best written once.

    With ``windows`` each row is counted in keyed state (``keyed_velocity``, with ``clock`` and ``late``), and the velocity
    rule looks at ``recent``; without, it fires only if the stream brings the counts along. A ``model`` scores the
    same features as in batch jobs, ``ml`` is any other anomaly score.
    """
    kept = [name for name in stream.columns if name not in ("status", *SCORE_COLUMNS)]
    if windows is not None:
        stream = keyed_velocity(stream, windows, clock=clock, late=late)
    rows = join_user_context(mark_blacklisted(stream, context.blacklist), context)
    absent = [name for name in {*VELOCITY_WINDOWS, recent} if name not in rows.columns]
    rows = rows.withColumns({name: F.lit(None).cast("long") for name in absent})
    if model is not None:
        rows = model.add_decision(rows, list(features_of().values()))
        ml = ml_score(F.col("decision"))
    ml = F.lit(0.0) if ml is None else ml
    added = score_columns(flags_of(recent), ml, weights, rule_weights, THRESHOLD_TIERS, False, None)
    return rows.select(*kept, *[column.alias(name) for name, column in added.items()])


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch: running the batch again replaces it."""
    store_batch(df, path, f"stream-{batch_id}")


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scoring_sink(scored: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Scores, alerts and audit entries of a scored stream, in the tables below ``path`` that ``store_scoring`` writes too."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            store_tables(batch, path, f"stream-{batch_id}")
        finally:
            batch.unpersist()

    return scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def velocity_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    windows: Mapping[str, int] | None = None,
    *,
    user: str = "user_id",
    ts: str = "ts",
    hot_limit: int = SLIDING_LIMIT,
) -> DataStreamWriter:
    """Trailing counts of a stream: each batch is counted together with the rows still in reach.

    The sink table, in folders by day, is the state: a batch reads the earlier batches' rows of the days
    its windows touch, and runs the same operator as batch jobs, hot users included.  A late row is counted
    against the rows known so far; counts already written stay as they are.
    """
    windows = dict(windows or {"tx_count_last_5min": WINDOW_5MIN, "tx_count_last_1h": WINDOW_1H})
    reach = max(windows.values())

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            rows = batch.withColumn("__fresh", F.lit(True))
            bounds = batch.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
            if bounds["lo"] is not None:
                lo = bounds["lo"] - timedelta(seconds=reach)
                earlier = _earlier_rows(batch.sparkSession, path, lo, bounds["hi"])
                if earlier is not None:
                    near = earlier.filter((F.col("batch_id") < batch_id) & F.col(ts).between(F.lit(lo), F.lit(bounds["hi"])))
                    rows = rows.unionByName(
                        near.select(user, ts).withColumn("__fresh", F.lit(False)), allowMissingColumns=True
                    )
            counted = velocity(rows, windows, user=user, ts=ts, hot_limit=hot_limit).filter("__fresh").drop("__fresh")
            dated = counted.withColumns({"day": F.to_date(ts), "batch_id": F.lit(batch_id)})
            # Only the folders of this batch are replaced if it is run again.
            writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("day", "batch_id").parquet(path)
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def _earlier_rows(spark: SparkSession, path: str, lo: datetime, hi: datetime) -> DataFrame | None:
    """Rows written for the days from ``lo`` to ``hi``; only these days' folders are listed."""
    days = ",".join(str(lo.date() + timedelta(days=i)) for i in range((hi.date() - lo.date()).days + 1))
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/day={{{days}}}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def window_kpis(
    scored: DataFrame, *, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Per time window: rows, fraud rows and mean score; rows later than ``delay`` are dropped.

    Windows close, and are written in append mode, once the watermark has passed them.
    """
    timed, back = event_time(scored, ts)
    counted = timed.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.count_if(F.col("classification") == "fraud").alias("n_fraud"),
        F.avg("ensemble_score").alias("avg_score"),
    )
    return counted.select(
        back(F.col("w.start")).alias("window_start"),
        back(F.col("w.end")).alias("window_end"),
        "n_transactions",
        "n_fraud",
        "avg_score",
    )


def with_open_windows(closed: DataFrame, rows: DataFrame, *, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """The windows written by a bounded run of ``window_kpis`` and, counted from ``rows``, its input as a batch, those still open.

    Open windows are not written: a later run from the same checkpoint closes them with the rows still to come.
    """
    last = F.broadcast(closed.agg(F.max("window_end").alias("__last")))
    rest = rows.crossJoin(last).filter(F.col("__last").isNull() | (F.col(ts) >= F.col("__last"))).drop("__last")
    return closed.unionByName(window_kpis(rest, ts=ts, width=width))


def unique_requests(stream: DataFrame, *, ts: str = "ts", row_id: str = "transaction_id", delay: str = "1 hour") -> DataFrame:
    """Each request once; repeats within ``delay`` are dropped and the state is bounded by it."""
    timed, back = event_time(stream, ts)
    unique = timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([row_id])
    return unique.withColumn(ts, back(F.col(ts)))


def run_to_end(writer: DataStreamWriter, timeout: float | None = None) -> None:
    """Process what is there now, then stop; a caller may limit the seconds."""
    query = writer.trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream did not finish in {timeout} s")
