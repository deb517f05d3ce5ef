import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions.ensemble import (
    class_from_status,
    classify,
    combine,
    ml_score,
    risk_band,
    status_from_class,
    threshold,
    tier_label,
)
from riskloom.schemas import ENSEMBLE_WEIGHTS, THRESHOLD_TIERS


def lit(x):
    return F.lit(float(x))


@pytest.mark.parametrize("weights", [None, {"rule": 0.7, "ml": 0.2, "context": 0.1}, {"ml": 1.7}, {"rule": -0.9, "context": 0.3}])
def test_combine(value, weights):
    draw = random.Random(11)
    used = ENSEMBLE_WEIGHTS if weights is None else weights
    for _ in range(4):
        layers = {name: round(draw.uniform(0, 100), 2) for name in ("rule", "ml", "context")}
        expected = min(100.0, max(0.0, sum(weight * layers[name] for name, weight in used.items())))
        assert value(combine(*[lit(x) for x in layers.values()], weights)) == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize(
    "amount,exact,contiguous",
    [
        (0, 70, 70), (500, 70, 70), (1000, 70, 70), (1000.5, 70, 60), (1001, 60, 60), (5000, 60, 60), (10000, 60, 60),
        (10000.5, 70, 50), (10001, 50, 50), (25000, 50, 50), (50000, 50, 50), (50000.5, 70, 40), (50001, 40, 40),
        (100000, 40, 40), (-100, 70, 70),
    ],
)
def test_threshold(value, amount, exact, contiguous):
    assert value(threshold(lit(amount))) == exact
    assert value(threshold(lit(amount), contiguous=True)) == contiguous


def test_threshold_of_nothing(value):
    assert value(threshold(F.lit(None).cast("double"))) == 70.0
    assert value(tier_label(lit(1000.5))) is None
    assert value(tier_label(lit(1000))) == "low"


def test_fixed_values_hang_together():
    assert sum(ENSEMBLE_WEIGHTS.values()) == pytest.approx(1)
    assert len(THRESHOLD_TIERS) == 4
    assert all(b[1] == a[2] + 1 for a, b in zip(THRESHOLD_TIERS, THRESHOLD_TIERS[1:]))


@pytest.mark.parametrize("score,expected", [(70.1, "fraud"), (70, "review"), (69.9, "legitimate")])
def test_classify(value, score, expected):
    assert value(classify(lit(score), lit(70))) == expected


def test_status_and_class(value):
    pairs = {"legitimate": "approved", "review": "flagged", "fraud": "blocked", "other": "pending"}
    for name, status in pairs.items():
        assert value(status_from_class(F.lit(name))) == status
    assert value(class_from_status(F.lit("blocked"))) == "fraud"
    assert value(class_from_status(F.lit("reverted"))) == "pending"


@pytest.mark.parametrize("score,band", [(70.5, "high"), (70, "medium"), (40.5, "medium"), (40, "low"), (None, "low")])
def test_risk_band(value, score, band):
    assert value(risk_band(F.lit(score).cast("double"))) == band


@pytest.mark.parametrize("decision,expected", [(0, 50), (-0.5, 100), (0.5, 0), (-2, 100), (2, 0), (0.1, 40), (None, 0)])
def test_ml_score(value, decision, expected):
    assert value(ml_score(F.lit(decision).cast("double"))) == pytest.approx(expected)
