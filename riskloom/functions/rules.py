"""The six deterministic rules as Columns.

Every rule yields a non-null boolean; a missing input leaves its rule silent.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.clock import hour_of
from riskloom.schemas import HIGH_AMOUNT_LIMIT, QUIET_HOURS_END, RULE_WEIGHTS, SCORE_CAP, VELOCITY_LIMIT


def _fires(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _filled(text: Column) -> Column:
    return F.length(text) > 0


def high_amount(amount: Column, limit: float = HIGH_AMOUNT_LIMIT) -> Column:
    return _fires(amount > F.lit(limit))


def high_velocity(recent: Column, limit: int = VELOCITY_LIMIT) -> Column:
    return _fires(recent > F.lit(limit))


def unusual_merchant(listed: Column) -> Column:
    """``listed``: the lower-cased merchant name is on the lower-cased blacklist."""
    return _fires(listed)


def card_mismatch(card: Column, has_known_cards: Column, card_is_known: Column) -> Column:
    return _fires(has_known_cards) & _fires(_filled(card)) & ~_fires(card_is_known)


def unusual_hours(ts: Column, end: int = QUIET_HOURS_END) -> Column:
    return _fires(hour_of(ts) < F.lit(end))


def country_mismatch(country: Column, home: Column) -> Column:
    return _fires(_filled(country) & _filled(home) & (country != home))


def rule_flags(
    *,
    amount: Column,
    recent: Column,
    listed: Column,
    card: Column,
    has_known_cards: Column,
    card_is_known: Column,
    ts: Column,
    country: Column,
    home: Column,
) -> dict[str, Column]:
    """All rules, in firing order."""
    return {
        "high_amount": high_amount(amount),
        "high_velocity": high_velocity(recent),
        "unusual_merchant": unusual_merchant(listed),
        "card_mismatch": card_mismatch(card, has_known_cards, card_is_known),
        "unusual_hours": unusual_hours(ts),
        "country_mismatch": country_mismatch(country, home),
    }


def rule_score(flags: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """Sum of the weights of the fired rules, at most 100; a rule without a weight adds nothing."""
    weights = RULE_WEIGHTS if weights is None else weights
    total = F.lit(0.0)
    for name, flag in flags.items():
        if name in weights:
            total = total + F.when(flag, F.lit(float(weights[name]))).otherwise(0.0)
    return F.least(total, F.lit(SCORE_CAP))


def fired_rules(flags: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """Names of the fired rules, in order; with ``weights`` only the rules named there."""
    names = [F.when(flag, F.lit(name)) for name, flag in flags.items() if weights is None or name in weights]
    if not names:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*names))
