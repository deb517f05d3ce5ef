"""Labelled synthetic transactions, every value a function of the row's number and the seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.schemas import TRAINING_CSV

# Profiles, shares and amount ranges of the synthetic population.
USERS = 100
FRAUD_RATE = 0.05
TIER_SHARES = (("low_risk", 0.7, 20), ("medium_risk", 0.25, 10), ("high_risk", 0.05, 10))
PATTERN_SHARES = (("amount_outlier", 0.4), ("high_risk_merchant", 0.3), ("unusual_hours", 0.2), ("round_amount", 0.1))
ROUND_AMOUNTS = (500, 1000, 2000, 5000, 10000, 50000)
CURRENCIES = ("USD", "EUR", "GBP", "CAD")
HOME_COUNTRIES = ("US", "US", "US", "UK", "CA", "DE", "FR")
BURST_SHARE = 0.3
ODD_HOUR_SHARE = 0.05 * 2 * FRAUD_RATE
MAX_HOURS = 720

# Names of a row's draws, four to a digest, and of a user's.
ROW_DRAWS = (
    "user", "fraud", "pattern", "tier", "radius", "angle", "amount", "merchant", "burst",
    "odd", "currency", "hours", "burst_hours", "burst_minutes", "hour", "minute", "second",
)
USER_DRAWS = ("avg", "std", "country")


def _digest(seed: int, salt: str, key: Column, number: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string"), F.lit(str(number))))


def _uniform(digest: Column, part: int) -> Column:
    """A number in [0, 1): one of the four words of an MD5 digest, so that any SQL engine can draw it again."""
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("long") / 2.0**32


def _user_draw(seed: int, user: Column, name: str) -> Column:
    return _uniform(_digest(seed, "user", user, 0), USER_DRAWS.index(name))


def _integer(u: Column, low: int, high: int) -> Column:
    """Whole number in low..high from a uniform number."""
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def _pick(u: Column, options) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), _integer(u, 1, len(options)))


def _by_share(u: Column, shares) -> Column:
    chain, bound = None, 0.0
    for name, share in [pair[:2] for pair in shares[:-1]]:
        bound += share
        chain = F.when(u < bound, name) if chain is None else chain.when(u < bound, name)
    return chain.otherwise(shares[-1][0])


def synthesize_transactions(
    spark: SparkSession,
    n: int,
    fraud_rate: float = FRAUD_RATE,
    seed: int = 42,
    start: str = "2024-01-01 00:00:00",
    users: int = USERS,
) -> DataFrame:
    """``n`` labelled rows of ``users`` users in the training-CSV shape."""
    return synthesize_for(spark.range(n), "id", fraud_rate, seed, start, users)


def synthesize_for(
    ids: DataFrame,
    row_id: str,
    fraud_rate: float = FRAUD_RATE,
    seed: int = 42,
    start: str = "2024-01-01 00:00:00",
    users: int = USERS,
) -> DataFrame:
    """One labelled row per whole number in ``ids``; a projection without any shuffle."""
    key = F.col(row_id)
    digests = [_digest(seed, "row", key, i).alias(f"digest_{i}") for i in range(-(-len(ROW_DRAWS) // 4))]

    def u(name: str) -> Column:
        place = ROW_DRAWS.index(name)
        return _uniform(F.col(f"digest_{place // 4}"), place % 4)

    rows = ids.select(key.alias("id"), *digests).select(
        "id",
        _integer(u("user"), 0, users - 1).alias("user"),
        (u("fraud") < fraud_rate).alias("fraud"),
        _by_share(u("pattern"), PATTERN_SHARES).alias("pattern"),
        _by_share(u("tier"), TIER_SHARES).alias("tier"),
        (F.sqrt(-2 * F.ln(1 - u("radius"))) * F.cos(u("angle") * 2 * math.pi)).alias("gauss"),
        u("amount").alias("u_amount"),
        u("merchant").alias("u_merchant"),
        (u("burst") < BURST_SHARE).alias("burst"),
        (u("odd") < ODD_HOUR_SHARE).alias("odd"),
        _pick(u("currency"), CURRENCIES).alias("currency"),
        _integer(u("hours"), 0, MAX_HOURS).alias("hours"),
        _integer(u("burst_hours"), 0, 2).alias("burst_hours"),
        _integer(u("burst_minutes"), 0, 10).alias("burst_minutes"),
        u("hour").alias("u_hour"),
        _integer(u("minute"), 0, 59).alias("minute"),
        _integer(u("second"), 0, 59).alias("second"),
    )
    fraud, pattern, draw = F.col("fraud"), F.col("pattern"), F.col("u_amount")
    avg = 20 + 180 * _user_draw(seed, F.col("user"), "avg")
    std = 10 + 40 * _user_draw(seed, F.col("user"), "std")
    criminal = (
        F.when(pattern == "amount_outlier", avg + std * (5 + 15 * draw))
        .when(pattern == "high_risk_merchant", 100 + 4900 * draw)
        .when(pattern == "unusual_hours", 50 + 450 * draw)
        .otherwise(_pick(draw, ROUND_AMOUNTS).cast("double"))
    )
    amount = F.round(F.when(fraud, criminal).otherwise(F.greatest(F.lit(1.0), avg + std * F.col("gauss"))), 2)
    shop_tier = (
        F.when(~fraud, F.col("tier")).when(pattern == "high_risk_merchant", "high_risk").otherwise("medium_risk")
    )
    shops = F.create_map(*[F.lit(x) for name, _, count in TIER_SHARES for x in (name, count)])
    shop = F.floor(F.col("u_merchant") * shops[shop_tier]).cast("int") + 1
    category = F.when(fraud, "high_risk").otherwise(F.col("tier"))
    base = F.lit(start).cast("timestamp_ntz")
    burst = fraud & F.col("burst")
    moment = F.timestamp_add(
        "MINUTE",
        F.when(burst, F.col("burst_hours") * 60 + F.col("burst_minutes")).otherwise(F.col("hours") * 60),
        base,
    )
    hour = F.when(F.col("odd"), F.floor(F.col("u_hour") * 6)).otherwise(F.floor(F.col("u_hour") * 16) + 8)
    clock = F.format_string("T%02d:%02d:%02d+00:00", hour.cast("int"), F.col("minute"), F.col("second"))
    result = rows.withColumns({"amount": amount, "category": category, "moment": moment, "shop_tier": shop_tier})
    return result.select(
        F.format_string("tx-%06d", "id").alias("transaction_id"),
        F.format_string("user-%04d", "user").alias("user_id"),
        "amount",
        "currency",
        F.format_string("%s merchant %02d", F.regexp_replace("shop_tier", "_risk", ""), shop).alias("merchant_name"),
        F.col("category").alias("merchant_category"),
        F.concat(F.date_format("moment", "yyyy-MM-dd"), clock).alias("timestamp"),
        fraud.cast("int").alias("is_fraud"),
        F.hour("moment").alias("hour_of_day"),
        F.when(F.weekday("moment") >= 5, 1).otherwise(0).alias("is_weekend"),
        F.when(F.col("category") == "high_risk", 1).otherwise(0).alias("is_crypto"),
        F.when(F.col("amount") % 100 == 0, 1).otherwise(0).alias("amount_round_number"),
        F.round(avg, 2).alias("user_avg_amount"),
        F.round(std, 2).alias("user_std_amount"),
    ).select(*TRAINING_CSV.names)


def user_profiles(spark: SparkSession, seed: int = 42, users: int = USERS) -> DataFrame:
    """``user_id, home_country`` of the synthetic users."""
    return spark.range(users).select(
        F.format_string("user-%04d", "id").alias("user_id"),
        _pick(_user_draw(seed, F.col("id"), "country"), HOME_COUNTRIES).alias("home_country"),
    )
