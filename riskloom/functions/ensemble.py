"""Weighted ensemble score, amount-dependent threshold, class, status and bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.schemas import (
    BAND_HIGH,
    BAND_MEDIUM,
    DEFAULT_THRESHOLD,
    ENSEMBLE_WEIGHTS,
    PENDING,
    SCORE_CAP,
    STATUS_OF_CLASS,
    THRESHOLD_TIERS,
)


def clamp(x: Column) -> Column:
    """``x`` within 0..100; NULL stays NULL, although ``greatest`` and ``least`` skip NULLs."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(SCORE_CAP), x)))


def combine(
    rule: Column,
    ml: Column,
    context: Column | None = None,
    weights: Mapping[str, float] | None = None,
) -> Column:
    """``rule*w + ml*w + context*w`` in doubles, in this order, clamped to 0..100.

    The order of operations matters: ``review`` needs exact equality with the threshold.
    """
    weights = weights or ENSEMBLE_WEIGHTS
    layers = {"rule": rule, "ml": ml, "context": F.lit(0.0) if context is None else context}
    weighted = [column * F.lit(float(weights.get(name, 0.0))) for name, column in layers.items()]
    return clamp(weighted[0] + weighted[1] + weighted[2])


def threshold(amount: Column, tiers: Sequence[tuple] = THRESHOLD_TIERS, contiguous: bool = False) -> Column:
    """Threshold of the amount's tier.

    The tier bounds are whole numbers, so an amount between two tiers (1000.50) has no tier and takes
    the default.  ``contiguous=True`` closes these gaps by looking at the upper bounds only.
    """
    return F.coalesce(_tier_value(amount, tiers, contiguous, 3), F.lit(DEFAULT_THRESHOLD))


def tier_label(amount: Column, tiers: Sequence[tuple] = THRESHOLD_TIERS, contiguous: bool = False) -> Column:
    """Name of the amount's tier, NULL in a gap."""
    return _tier_value(amount, tiers, contiguous, 0)


def _tier_value(amount: Column, tiers: Sequence[tuple], contiguous: bool, field: int) -> Column:
    chain = F.when(F.lit(False), F.lit(tiers[0][field]))
    above = None
    for tier in tiers:
        low, high = tier[1], tier[2]
        if contiguous:
            inside = amount > F.lit(above) if high is None else amount <= F.lit(high)
        else:
            inside = amount >= F.lit(low)
            inside = inside if high is None else inside & (amount <= F.lit(high))
        chain = chain.when(inside, F.lit(tier[field]))
        above = high
    return chain


def classify(score: Column, limit: Column) -> Column:
    """NULL without a score, which the status rules keep pending."""
    return F.when(score > limit, "fraud").when(score == limit, "review").when(score.isNotNull(), "legitimate")


def status_from_class(classification: Column) -> Column:
    chain = None
    for name, status in STATUS_OF_CLASS.items():
        hit = classification == name
        chain = F.when(hit, status) if chain is None else chain.when(hit, status)
    return chain.otherwise(PENDING)


def class_from_status(status: Column) -> Column:
    chain = None
    for name, value in STATUS_OF_CLASS.items():
        hit = status == value
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(PENDING)


def risk_band(score: Column) -> Column:
    return F.when(score > BAND_HIGH, "high").when(score > BAND_MEDIUM, "medium").otherwise("low")


def ml_score(decision: Column) -> Column:
    """Risk 0..100 from the forest's decision value; without a model (NULL) the risk is 0."""
    return F.coalesce(clamp(F.lit(100.0) * (1.0 - (decision + 0.5))), F.lit(0.0))
