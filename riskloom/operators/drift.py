"""Population-stability drift, retraining triggers and the model-run table.

Samples come in one shape, ``feature, is_reference, value``, so a single pair of jobs serves one score
column or all ten features: the first finds each feature's range and means, the second counts bins.
Where one table has both sides (``split_drift``), the first job reads its columns side by side, and only
the second takes rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.numbers import round_exact
from riskloom.schemas import (
    DRIFT_FACTOR,
    DRIFT_THRESHOLD,
    MIN_DRIFTED_FEATURES,
    MIN_F1,
    PSI_BINS,
    PSI_EPSILON,
    RECENT_RUNS,
    RECENT_SCORES,
    RECENT_WINDOW,
)
from riskloom.session import settle

VALUE = "value"


def samples(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both sides in long form; NULLs are left out."""

    def side(df: DataFrame, is_reference: bool) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
        long = df.select(F.explode(pairs).alias("pair")).select("pair.*")
        return long.dropna().withColumn("is_reference", F.lit(is_reference))

    return side(reference, True).unionByName(side(current, False))


def split_samples(df: DataFrame, is_reference: Column, columns: Sequence[str]) -> DataFrame:
    """Long form of one table whose rows say themselves which side they belong to; one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(is_reference.alias("is_reference"), F.explode(pairs).alias("pair")).select("is_reference", "pair.*").dropna()


def bin_edges(lo: Column, hi: Column, bins: int = PSI_BINS) -> Column:
    """Equal-width edges as an array; the last one is exactly ``hi``."""
    step = (hi - lo) / float(bins)
    return F.array(*[lo + step * float(i) for i in range(bins)], hi)


def bin_of(value: Column, lo: Column, hi: Column, bins: int = PSI_BINS) -> Column:
    """0-based bin: half-open, the last one closed."""
    step = (hi - lo) / float(bins)
    return sum((F.when(value >= lo + step * float(i), 1).otherwise(0) for i in range(1, bins)), F.lit(0))


def _measures(value: Column, is_reference: Column) -> list[Column]:
    """Pooled range, and count and mean of each side."""
    reference, current = F.when(is_reference, value), F.when(~is_reference, value)
    return [
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        F.count(reference).alias("n_reference"),
        F.count(current).alias("n_current"),
        F.avg(reference).alias("mean_reference"),
        F.avg(current).alias("mean_current"),
    ]


def sample_stats(long: DataFrame) -> DataFrame:
    """Per feature: pooled range, and count and mean of each side."""
    return long.groupBy("feature").agg(*_measures(F.col("value"), F.col("is_reference")))


def wide_stats(df: DataFrame, is_reference: Column, columns: Sequence[str]) -> DataFrame:
    """``sample_stats`` of the columns of one table, all in one aggregate without taking rows apart."""
    sided = df.select(is_reference.alias("is_reference"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    sided = sided.filter(F.col("is_reference").isNotNull())
    found = [
        F.struct(F.lit(c).alias("feature"), *_measures(F.col(f"v{i}"), F.col("is_reference"))) for i, c in enumerate(columns)
    ]
    # A feature without values has no row, as in ``sample_stats``.
    return sided.agg(F.array(*found).alias("found")).select(F.inline("found")).filter("n_reference + n_current > 0")


def histogram(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Per feature and bin: counts of each side.  ``stats`` has one row per feature, hence the broadcast."""
    placed = long.join(F.broadcast(stats.select("feature", "lo", "hi")), "feature")
    return placed.groupBy("feature", bin_of(F.col("value"), F.col("lo"), F.col("hi")).alias("bin")).agg(
        F.count_if(F.col("is_reference")).alias("in_reference"),
        F.count_if(~F.col("is_reference")).alias("in_current"),
    )


def feature_psi(long: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per feature: the statistics (``sample_stats`` unless given) and ``psi``.

    A bin empty on both sides adds (e - e) * ln(1) = 0, so only occupied bins are summed; they are
    summed in bin order, whatever order they arrive in.
    """
    stats = sample_stats(long) if stats is None else stats
    parts = histogram(long, stats).join(F.broadcast(stats), "feature")
    p = F.col("in_reference") / F.greatest("n_reference", F.lit(1)) + PSI_EPSILON
    q = F.col("in_current") / F.greatest("n_current", F.lit(1)) + PSI_EPSILON
    term = F.struct(F.col("bin"), ((p - q) * F.ln(p / q)).alias("term"))
    # At most PSI_BINS entries per feature.
    terms = F.array_sort(F.collect_list(term))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x["term"])
    keys = ["feature", "lo", "hi", "n_reference", "n_current", "mean_reference", "mean_current"]
    summed = parts.groupBy(*keys).agg(total.alias("psi"))
    flat = (F.col("lo") == F.col("hi")) | (F.col("n_reference") == 0) | (F.col("n_current") == 0)
    return summed.withColumn("psi", F.when(flat, 0.0).otherwise(F.col("psi")))


def _drift_score(psi: Column) -> Column:
    return F.least(psi * DRIFT_FACTOR, F.lit(100.0))


def feature_drift(long: DataFrame, threshold: float = DRIFT_THRESHOLD, stats: DataFrame | None = None) -> DataFrame:
    """One row per feature: psi and means (4 decimals), score (2 decimals), drifted or not."""
    score = _drift_score(F.col("psi"))
    return feature_psi(long, stats).select(
        "feature",
        round_exact(F.col("psi"), 4).alias("psi"),
        round_exact(F.coalesce("mean_reference", F.lit(0.0)), 4).alias("reference_mean"),
        round_exact(F.coalesce("mean_current", F.lit(0.0)), 4).alias("current_mean"),
        round_exact(score, 2).alias("drift_score"),
        (score > threshold).alias("drift_detected"),
    )


def split_drift(df: DataFrame, is_reference: Column, columns: Sequence[str], threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """``feature_drift`` of one table whose rows say themselves which side they belong to.

    Only the columns and the side are kept, in a narrow table that both jobs read.
    """
    narrow = settle(df.select(is_reference.alias("is_reference"), *columns))
    stats = settle(wide_stats(narrow, F.col("is_reference"), columns))
    return feature_drift(split_samples(narrow, F.col("is_reference"), columns), threshold, stats)


def drift_report(reference: DataFrame, current: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """One row for two samples with a ``value`` column; all zero if either sample is empty."""
    return drift_of(samples(reference, current, [VALUE]), threshold)


def drift_of(long: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """``drift_report`` of a long sample with a single feature."""
    found = feature_psi(long)
    filled = (F.col("n_reference") > 0) & (F.col("n_current") > 0)
    # An ungrouped aggregate yields its one row for empty samples too.
    one = found.agg(
        *[F.max(F.when(filled, F.col(c))).alias(c) for c in ("psi", "mean_reference", "mean_current")]
    ).na.fill(0.0)
    score = _drift_score(F.col("psi"))
    reference, current = F.col("mean_reference"), F.col("mean_current")
    return one.select(
        F.col("psi"),
        round_exact(score, 2).alias("drift_score"),
        (score > threshold).alias("drift_detected"),
        round_exact(reference, 4).alias("reference_mean"),
        round_exact(current, 4).alias("current_mean"),
        round_exact(current - reference, 4).alias("shift"),
    )


def split_recent(
    scores: DataFrame,
    reference: DataFrame | None = None,
    *,
    score: str = "ensemble_score",
    time: str = "created_at",
    row_id: str = "transaction_id",
    n: int = RECENT_SCORES,
    window: int = RECENT_WINDOW,
) -> DataFrame:
    """Long sample of the newest ``n`` scores: newer against older half, or against ``reference``.

    With fewer than ``window`` scores they are compared with themselves.
    """
    newest = [F.col(time).desc(), F.col(row_id).desc()]
    top = scores.select(score, time, row_id).orderBy(*newest).limit(n)
    # These windows see the n rows of the top-n only.
    everything = Window.partitionBy(F.lit(0))
    numbered = top.select(
        F.lit(VALUE).alias("feature"),
        F.col(score).cast("double").alias("value"),
        F.row_number().over(everything.orderBy(*newest)).alias("place"),
        F.count(F.lit(1)).over(everything).alias("n"),
    )
    if reference is not None:
        current = numbered.filter(F.col("place") <= window).select("feature", F.lit(False).alias("is_reference"), "value")
        given = reference.select(
            F.lit(VALUE).alias("feature"), F.lit(True).alias("is_reference"), F.col("value").cast("double").alias("value")
        )
        return given.unionByName(current)
    half = F.array(F.col("place") > F.floor(F.col("n") / 2))
    sides = F.when(F.col("n") >= window, half).otherwise(F.array(F.lit(True), F.lit(False)))
    return numbered.select("feature", F.explode(sides).alias("is_reference"), "value")


def needs_retraining(f1: Column, drift_score: Column, threshold: float = DRIFT_THRESHOLD) -> Column:
    """Weak F1 or strong drift; a missing metric never triggers."""
    return F.coalesce(f1 < MIN_F1, F.lit(False)) | F.coalesce(drift_score > threshold, F.lit(False))


def retraining_recommendation(features: DataFrame, f1: DataFrame) -> DataFrame:
    """One row: drifted features, F1, reasons, recommended or not, and the run's health.

    ``features`` is a ``feature_drift`` result, ``f1`` a one-row table with column ``f1``.
    """
    drifted = features.agg(F.count_if("drift_detected").alias("drifted_features"))
    both = drifted.unionByName(f1.select("f1"), allowMissingColumns=True)
    one = both.agg(F.max("drifted_features").alias("drifted_features"), F.max("f1").alias("f1"))
    drift, weak = F.col("drifted_features") >= MIN_DRIFTED_FEATURES, F.coalesce(F.col("f1") < MIN_F1, F.lit(False))
    reasons = F.array_compact(F.array(F.when(drift, "data_drift"), F.when(weak, "performance_degradation")))
    return one.select(
        "drifted_features",
        "f1",
        F.array_join(reasons, ",").alias("reasons"),
        (drift | weak).alias("recommended"),
        F.when(weak, "degraded").otherwise("ready").alias("run_status"),
    )


def model_run(spark: SparkSession, version: str, metrics: dict[str, float], drift_detected: bool, created_at) -> DataFrame:
    """One new row of the model-run table, status ready."""
    schema = (
        "model_version string, metrics map<string,double>, status string, drift_detected boolean, created_at timestamp_ntz"
    )
    return spark.createDataFrame([(version, metrics, "ready", drift_detected, created_at)], schema)


def list_runs(runs: DataFrame, n: int = RECENT_RUNS) -> DataFrame:
    """The newest ``n`` runs."""
    return runs.orderBy(F.col("created_at").desc(), F.col("model_version").desc()).limit(n)


def latest_status(runs: DataFrame) -> DataFrame:
    """One row: status of the newest run, ``unknown`` without any."""
    newest = F.max_by("status", F.struct("created_at", "model_version"))
    return runs.agg(F.coalesce(newest, F.lit("unknown")).alias("model_status"))
