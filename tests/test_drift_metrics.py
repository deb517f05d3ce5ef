import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskloom.operators import drift
from riskloom.operators.metrics import binary_metrics, confusion, curve_areas, evaluate_scores, score_curve
from riskloom.operators.quantile import exact_quantile
from riskloom.schemas import DRIFT_FACTOR, DRIFT_THRESHOLD, PSI_BINS, PSI_EPSILON

DRAW = np.random.default_rng(29)
REFERENCE = DRAW.normal(40, 6, 60).round(3).tolist()
SHIFTED = DRAW.normal(75, 5, 60).round(3).tolist()
SIMILAR = [x + 0.25 for x in REFERENCE]


def plain_psi(reference, current):
    edges = np.linspace(min(*reference, *current), max(*reference, *current), PSI_BINS + 1)
    p, q = (np.histogram(side, edges)[0] / len(side) + PSI_EPSILON for side in (reference, current))
    return float(((p - q) * np.log(p / q)).sum())


def numbers(spark, values):
    return spark.createDataFrame([(float(x),) for x in values], "value double")


@pytest.mark.parametrize("reference,current", [(REFERENCE, SHIFTED), (REFERENCE, SIMILAR), (SHIFTED[:7], REFERENCE[:5]), ([3.5] * 4, [3.5] * 6)])
def test_drift_report(spark, reference, current):
    row = drift.drift_report(numbers(spark, reference), numbers(spark, current)).first()
    psi = plain_psi(reference, current) if len({*reference, *current}) > 1 else 0.0
    score = min(100.0, psi * DRIFT_FACTOR)
    assert row["psi"] == pytest.approx(psi, rel=1e-12)
    assert (row["drift_score"], row["drift_detected"]) == (round(score, 2), score > DRIFT_THRESHOLD)
    assert row["reference_mean"] == round(float(np.mean(reference)), 4)
    assert row["shift"] == round(float(np.mean(current)) - float(np.mean(reference)), 4)


@pytest.mark.parametrize("reference,current", [([], [1]), ([1], []), ([], [])])
def test_drift_of_an_empty_side(spark, reference, current):
    row = drift.drift_report(numbers(spark, reference), numbers(spark, current)).first()
    assert tuple(row) == (0.0, 0.0, False, 0.0, 0.0, 0.0)


def test_histogram_matches_numpy(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1)]) for _ in range(500)]
    long = drift.samples(numbers(spark, values), numbers(spark, [0.0]), ["value"])
    found = {row["bin"]: row["in_reference"] for row in drift.histogram(long, drift.sample_stats(long)).collect()}
    counts, _ = np.histogram(values, bins=np.histogram_bin_edges(np.array([*values, 0.0]), bins=10))
    assert [found.get(i, 0) for i in range(10)] == list(counts)


def test_feature_drift(spark):
    left = spark.createDataFrame([(float(a), float(b)) for a, b in zip(REFERENCE, REFERENCE)], "a double, b double")
    right = spark.createDataFrame([(float(a), float(b)) for a, b in zip(SHIFTED, SIMILAR)], "a double, b double")
    found = drift.feature_drift(drift.samples(left, right, ["a", "b"]))
    psi = {"a": plain_psi(REFERENCE, SHIFTED), "b": plain_psi(REFERENCE, SIMILAR)}
    assert rows(found, "feature", "psi", "drift_detected") == [(k, round(v, 4), v * DRIFT_FACTOR > DRIFT_THRESHOLD) for k, v in psi.items()]


def test_split_drift_equals_the_long_form(spark):
    rng = random.Random(9)
    data = [(rng.choice([True, False, None]), rng.choice([None, rng.gauss(0, 1)]), float(i % 7), None) for i in range(400)]
    df = spark.createDataFrame(data, "side boolean, a double, b double, nothing double")
    columns = ["a", "b", "nothing"]
    long = drift.split_samples(df, F.col("side"), columns)
    names = ("feature", "psi", "reference_mean", "current_mean", "drift_score", "drift_detected")
    got = drift.split_drift(df, F.col("side"), columns)
    assert rows(got, *names) == rows(drift.feature_drift(long), *names) and got.count() == 2
    stats = ("feature", "lo", "hi", "n_reference", "n_current")
    assert rows(drift.wide_stats(df, F.col("side"), columns), *stats) == rows(drift.sample_stats(long), *stats)
    assert drift.split_drift(df.limit(0), F.col("side"), columns).count() == 0


def scores(spark, n):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, float(i), at + timedelta(seconds=i)) for i in range(n)], "transaction_id long, ensemble_score double, created_at timestamp_ntz")


def test_split_recent(spark):
    def sides(n, reference=None):
        long = drift.split_recent(scores(spark, n), reference)
        parts = {True: [], False: []}
        for row in long.collect():
            parts[row["is_reference"]].append(int(row["value"]))
        return sorted(parts[True]), sorted(parts[False])

    assert sides(250) == (list(range(50, 150)), list(range(150, 250)))
    assert sides(101) == (list(range(0, 51)), list(range(51, 101)))
    assert sides(99) == (list(range(99)), list(range(99)))
    assert sides(0) == ([], [])
    assert sides(250, numbers(spark, [1, 2])) == ([1, 2], list(range(150, 250)))
    assert tuple(drift.drift_of(drift.split_recent(scores(spark, 50))).first())[:3] == (0.0, 0.0, False)


@pytest.mark.parametrize(
    "f1,score,expected",
    [(0.65, None, True), (0.7, None, False), (0.85, 45.0, True), (0.85, 30.0, False), (None, None, False), (None, 30.1, True)],
)
def test_retraining(value, f1, score, expected):
    assert value(drift.needs_retraining(F.lit(f1).cast("double"), F.lit(score).cast("double"))) is expected


def test_recommendation(spark):
    features = spark.createDataFrame([(f"f{i}", i < 3) for i in range(5)], "feature string, drift_detected boolean")
    f1 = spark.createDataFrame([(0.6,)], "f1 double")
    assert tuple(drift.retraining_recommendation(features, f1).first()) == (3, 0.6, "data_drift,performance_degradation", True, "degraded")
    calm = drift.retraining_recommendation(features.filter("feature > 'f1'"), f1.withColumn("f1", F.lit(0.9))).first()
    assert tuple(calm) == (1, 0.9, "", False, "ready")


def test_runs(spark):
    at = datetime(2024, 1, 1)
    runs = drift.model_run(spark, "v1", {"f1": 0.9}, False, at)
    for i in range(2, 25):
        runs = runs.unionByName(drift.model_run(spark, f"v{i:02d}", {}, i == 9, at + timedelta(days=i)))
    listed = drift.list_runs(runs).collect()
    assert [row["model_version"] for row in listed] == [f"v{i:02d}" for i in range(24, 4, -1)]
    assert drift.latest_status(runs).first()[0] == "ready"
    assert drift.latest_status(runs.limit(0)).first()[0] == "unknown"


def pairs(spark, predicted, actual):
    return spark.createDataFrame(list(zip(predicted, actual)), "predicted int, actual int")


@pytest.mark.parametrize("n,called,true", [(57, 0.4, 0.3), (9, 1.0, 1.0), (12, 0.0, 0.5), (8, 0.5, 0.0), (0, 0.5, 0.5)])
def test_binary_metrics(spark, n, called, true):
    draw = np.random.default_rng(31)
    predicted, actual = (draw.random(n) < called).astype(int).tolist(), (draw.random(n) < true).astype(int).tolist()
    row = binary_metrics(confusion(pairs(spark, predicted, actual))).first()
    both = list(zip(predicted, actual))
    tp, fp, tn, fn = (both.count(x) for x in ((1, 1), (1, 0), (0, 0), (0, 1)))
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (tp, fp, tn, fn)
    share = lambda top, rest: top / (top + rest) if top + rest else 0.0
    area = (share(tp, fn) + share(tn, fp)) / 2 if 0 < sum(actual) < n else 0.0
    wanted = (share(tp, fp), share(tp, fn), share(2 * tp, fp + fn), area)
    assert [row[name] for name in ("precision", "recall", "f1", "auc_roc")] == [round(x, 4) for x in wanted]


def brute_areas(scores, actual):
    """Areas by their definitions: all pairs; one point per threshold."""
    pos = [s for s, a in zip(scores, actual) if a]
    neg = [s for s, a in zip(scores, actual) if not a]
    roc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.0
    points = [(0.0, 1.0)]
    for limit in sorted(set(scores), reverse=True):
        taken = [a for s, a in zip(scores, actual) if s >= limit]
        points.append((sum(taken) / len(pos) if pos else 1.0, sum(taken) / len(taken)))
    pr = sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(points, points[1:]))
    return roc, pr


@pytest.mark.parametrize("seed,distinct", [(1, 5), (2, 1000), (3, 1)])
def test_curve_areas(spark, seed, distinct):
    rng = random.Random(seed)
    scores = [float(rng.randint(1, distinct)) for _ in range(300)]
    actual = [int(rng.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame(list(zip(scores, actual)), "score double, actual int")
    row = curve_areas(score_curve(df)).first()
    assert (row["roc_auc"], row["pr_auc"]) == pytest.approx(brute_areas(scores, actual))


def test_curve_areas_of_given_example(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.0, 0), (0.0, 1), (1.0, 1)], "score double, actual int")
    row = curve_areas(score_curve(df)).first()
    assert (row["roc_auc"], row["pr_auc"]) == pytest.approx((7 / 12, 0.766667), abs=1e-6)


@pytest.mark.parametrize("actual,areas", [([1, 1], (0.0, 1.0)), ([0, 0], (0.0, 0.5)), ([], (0.0, 0.0))])
def test_curve_areas_of_one_class(spark, actual, areas):
    df = spark.createDataFrame([(float(i), a) for i, a in enumerate(actual)], "score double, actual int")
    assert tuple(curve_areas(score_curve(df)).first()) == areas


def test_evaluate_scores(spark):
    df = spark.createDataFrame([(-0.2, 1), (-0.1, 0), (0.1, 1), (0.2, 0), (0.3, 0)], "decision double, actual int")
    row = evaluate_scores(df).first().asDict()
    roc, pr = brute_areas([0.2, 0.1, -0.1, -0.2, -0.3], [1, 0, 1, 0, 0])
    assert row == {"precision": 0.5, "recall": 0.5, "pr_auc": round(pr, 4), "roc_auc": round(roc, 4), "n_samples": 5, "n_anomalies": 2}


@pytest.mark.parametrize("final_rows", [100_000, 10])
def test_exact_quantile(spark, monkeypatch, final_rows):
    monkeypatch.setattr("riskloom.operators.quantile.FINAL_ROWS", final_rows)
    rng = random.Random(4)
    values = [rng.choice([0.5, rng.random(), rng.random() * 1e6]) for _ in range(3000)]
    df = numbers(spark, values)
    for q in (0.0, 0.05, 0.3333, 0.5, 0.999, 1.0):
        assert exact_quantile(df, "value", q) == pytest.approx(float(np.percentile(values, 100 * q)), rel=1e-12)
    assert exact_quantile(df.filter("false"), "value", 0.5) is None
    assert math.isclose(exact_quantile(df.limit(1), "value", 0.3), df.limit(1).first()[0])
