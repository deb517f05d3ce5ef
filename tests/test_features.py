from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskloom.functions.clock import parse_wall_clock
from riskloom.functions.features import feature_columns, feature_names, feature_vector
from riskloom.schemas import FEATURE_NAMES

SCHEMA = "amount decimal(12,2), avg double, std double, n5 long, n60 long, time string, category string"


def vector(spark, amount=None, avg=None, std=None, n5=None, n60=None, time=None, category=None):
    row = (None if amount is None else Decimal(str(amount)), avg, std, n5, n60, time, category)
    columns = feature_columns(
        amount=F.col("amount"), avg_amount=F.col("avg"), std_amount=F.col("std"), count_5min=F.col("n5"), count_1h=F.col("n60"),
        ts=parse_wall_clock(F.col("time")), category=F.col("category"),
    )
    df = spark.createDataFrame([row], SCHEMA).select(*[c.alias(f"f_{n}") for n, c in columns.items()])
    return dict(zip(FEATURE_NAMES, df.select(feature_vector("f_").alias("v")).first()["v"]))


def test_names():
    assert feature_names() == list(FEATURE_NAMES) and len(FEATURE_NAMES) == 10


def test_nothing_known(spark):
    assert set(vector(spark).values()) == {0.0}


@pytest.mark.parametrize(
    "inputs,name,expected",
    [
        ({"amount": 150, "avg": 100.0}, "amount_vs_user_avg", 0.5),
        ({"amount": 150, "avg": 0.0}, "amount_vs_user_avg", 0.0),
        ({"amount": 150, "avg": 100.0, "std": 25.0}, "amount_vs_user_std", 2.0),
        ({"amount": 150, "avg": 100.0, "std": 0.0}, "amount_vs_user_std", 0.0),
        ({"n5": 4, "n60": 9}, "tx_count_last_5min", 4.0),
        ({"n5": 4, "n60": 9}, "tx_count_last_1h", 9.0),
        ({"time": "2031-03-08T03:00:00+00:00"}, "hour_of_day", 3.0),
        ({"time": "2031-03-08T03:00:00+00:00"}, "is_weekend", 1.0),
        ({"time": "2031-03-09T03:00:00+00:00"}, "is_weekend", 1.0),
        ({"time": "2031-03-10T03:00:00+00:00"}, "is_weekend", 0.0),
        ({"time": "broken"}, "is_weekend", 0.0),
        ({"category": "Gambling"}, "merchant_risk_level", 1.0),
        ({"category": "groceries"}, "merchant_risk_level", 0.0),
        ({"category": "CRYPTOCURRENCY"}, "is_crypto", 1.0),
        ({"category": "gambling"}, "is_crypto", 0.0),
        ({"amount": 1000}, "amount_round_number", 1.0),
        ({"amount": 870.25}, "amount_round_number", 0.0),
        ({"amount": 0}, "amount_round_number", 0.0),
        ({"amount": -100}, "amount_round_number", 0.0),
    ],
)
def test_features(spark, inputs, name, expected):
    assert vector(spark, **inputs)[name] == expected
