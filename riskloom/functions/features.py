"""The ten model features as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.clock import hour_of, is_weekend
from riskloom.functions.numbers import zero_if_null
from riskloom.schemas import CRYPTO_CATEGORY, FEATURE_NAMES, HIGH_RISK_CATEGORIES


def _one_if(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def feature_columns(
    *,
    amount: Column,
    avg_amount: Column,
    std_amount: Column,
    count_5min: Column,
    count_1h: Column,
    ts: Column,
    category: Column,
) -> dict[str, Column]:
    """Feature name -> double Column, in vector order; missing inputs count as zero."""
    value = zero_if_null(amount)
    avg, std = zero_if_null(avg_amount), zero_if_null(std_amount)
    kind = F.lower(category)
    columns = {
        "amount": value,
        "amount_vs_user_avg": F.when(avg > 0, value / avg - 1.0).otherwise(0.0),
        "amount_vs_user_std": F.when(std > 0, (value - avg) / std).otherwise(0.0),
        "tx_count_last_5min": zero_if_null(count_5min),
        "tx_count_last_1h": zero_if_null(count_1h),
        "hour_of_day": zero_if_null(hour_of(ts)),
        "is_weekend": _one_if(is_weekend(ts)),
        "merchant_risk_level": _one_if(kind.isin(*HIGH_RISK_CATEGORIES)),
        "is_crypto": _one_if(kind == CRYPTO_CATEGORY),
        "amount_round_number": _one_if((amount > 0) & (amount % 100 == 0)),
    }
    assert tuple(columns) == FEATURE_NAMES
    return columns


def feature_names() -> list[str]:
    return list(FEATURE_NAMES)


def feature_vector(prefix: str = "") -> Column:
    """The named feature columns assembled into one ``array<double>``."""
    return F.array(*[F.col(prefix + name).cast("double") for name in FEATURE_NAMES])
