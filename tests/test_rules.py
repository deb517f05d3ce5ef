import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.functions.clock import parse_wall_clock
from riskloom.functions.rules import fired_rules, rule_score
from riskloom.operators.context import ScoringContext, attach_context
from riskloom.plans.scoring import flags_of, weights_from_table

SCHEMA = (
    "transaction_id long, user_id string, amount decimal(12,2), merchant_name string, card_last4 string, "
    "timestamp string, country string, recent long"
)


def evaluate(spark, amount=None, recent=None, merchant=None, card=None, time=None, country=None, blacklist=(), known=(), home=None):
    from decimal import Decimal

    row = (1, "u", None if amount is None else Decimal(str(amount)), merchant, card, time, country, recent)
    df = spark.createDataFrame([row], SCHEMA).withColumn("ts", parse_wall_clock(F.col("timestamp")))
    context = ScoringContext(
        blacklist=spark.createDataFrame([(name,) for name in blacklist], "merchant_name string"),
        known_cards=spark.createDataFrame([("u", c) for c in known], "user_id string, card_last4 string"),
        home_country=spark.createDataFrame([("u", home)], "user_id string, home_country string"),
    )
    flags = flags_of("recent")
    out = attach_context(df, context).select(rule_score(flags).alias("s"), fired_rules(flags).alias("f")).first()
    return out["s"], out["f"]


CASES = [
    ({}, 0, []),
    ({"amount": 5000}, 0, []),
    ({"amount": 5000.01}, 30, ["high_amount"]),
    ({"recent": 3}, 0, []),
    ({"recent": 4}, 25, ["high_velocity"]),
    ({"merchant": "Bad SHOP", "blacklist": ["bad shop"]}, 20, ["unusual_merchant"]),
    ({"merchant": "Bad shop 2", "blacklist": ["bad shop"]}, 0, []),
    ({"card": "1111", "known": ["2222"]}, 20, ["card_mismatch"]),
    ({"card": "1111", "known": ["2222", "1111"]}, 0, []),
    ({"card": "1111"}, 0, []),
    ({"card": "", "known": ["2222"]}, 0, []),
    ({"time": "2024-06-15T03:00:00+00:00"}, 10, ["unusual_hours"]),
    ({"time": "2024-06-15T06:00:00+00:00"}, 0, []),
    ({"time": "2024-06-15T03:00:00+09:00"}, 10, ["unusual_hours"]),
    ({"time": "yesterday"}, 0, []),
    ({"country": "FR", "home": "US"}, 15, ["country_mismatch"]),
    ({"country": "us", "home": "US"}, 15, ["country_mismatch"]),
    ({"country": "US", "home": "US"}, 0, []),
    ({"country": "", "home": "US"}, 0, []),
    ({"country": "FR"}, 0, []),
    ({"amount": 6000, "recent": 5}, 55, ["high_amount", "high_velocity"]),
    (
        {
            "amount": 9000, "recent": 9, "merchant": "x", "blacklist": ["X"], "card": "1", "known": ["2"],
            "time": "2024-06-15T01:00:00", "country": "FR", "home": "US",
        },
        100,
        ["high_amount", "high_velocity", "unusual_merchant", "card_mismatch", "unusual_hours", "country_mismatch"],
    ),
]


@pytest.mark.parametrize("inputs,score,fired", CASES)
def test_rules(spark, inputs, score, fired):
    assert evaluate(spark, **inputs) == (float(score), fired)


def test_no_context_at_all(spark):
    df = spark.createDataFrame(
        [(1, "u", 1, "m", "1111", datetime.datetime(2024, 1, 1, 12), "FR")],
        "transaction_id long, user_id string, amount int, merchant_name string, card_last4 string, ts timestamp_ntz, country string",
    )
    out = attach_context(df, ScoringContext()).select(fired_rules(flags_of()).alias("f")).first()
    assert out["f"] == []


def test_weights_from_table(spark):
    table = spark.createDataFrame([("high_amount", 50.0, True), ("unusual_hours", 9.0, False)], "name string, weight double, is_active boolean")
    assert weights_from_table(table) == {"high_amount": 50.0}
    many = spark.range(300).select(F.concat(F.lit("other_"), "id").alias("name"), F.lit(1.0).alias("weight"), F.lit(True).alias("is_active"))
    assert weights_from_table(table.unionByName(many)) == {"high_amount": 50.0}


@pytest.mark.parametrize(
    "text",
    [
        "2024-06-15T03:00:00+00:00", "2024-06-15T03:00:00-05:30", "2024-06-15", "20240615T0304", "2024-06-15T23",
        "2024-06-15 05:59:59.999999", "2024-06-15T05:59:59.5Z", "2024-06", "2024", "no date", "2024-02-30", "2024-06-15T24:00",
        "2024-06-15T10:61", "2024-06-15T10:00:60", "2024-02-29T00:00:00",
    ],
)
def test_wall_clock(value, text):
    try:
        expected = datetime.datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        expected = None
    assert value(parse_wall_clock(F.col("s")), "s string", (text,)) == expected
