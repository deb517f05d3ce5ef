import bisect
import random
import statistics
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskloom.operators.context import ScoringContext, attach_context
from riskloom.operators.history import attach_history, home_country, known_cards, point_in_time_history, user_history, velocity
from riskloom.operators.skew import _cells, ordered_scan, split_hot

SCHEMA = "transaction_id long, user_id string, ts timestamp_ntz, amount decimal(12,2)"
WINDOWS = {"short": 60, "long": 600}


@pytest.fixture(scope="module")
def data():
    """600 rows, a third of them of one user, with equal times among them; one row without a user."""
    from decimal import Decimal

    rng, start = random.Random(3), datetime(2024, 1, 1)
    out = []
    for i in range(600):
        user = "hot" if i % 3 == 0 else f"u{rng.randint(0, 9)}"
        at = start + timedelta(seconds=rng.randint(0, 3000), microseconds=rng.choice([0, 0, 250000]))
        out.append((i, user, at, Decimal(rng.randint(1, 99999)) / 100))
    out.append((600, None, start, Decimal("5.00")))
    return out


def brute_velocity(data, seconds):
    times = defaultdict(list)
    for _, user, at, _ in data:
        times[user].append(at)
    for values in times.values():
        values.sort()
    return {
        i: bisect.bisect_right(times[user], at) - bisect.bisect_left(times[user], at - timedelta(seconds=seconds))
        for i, user, at, _ in data
    }


@pytest.mark.parametrize("limit", [10**6, 100, 0])
def test_velocity_against_brute_force(spark, data, limit):
    df = spark.createDataFrame(data, SCHEMA)
    got = velocity(df, WINDOWS, hot_limit=limit).collect()
    assert len(got) == len(data)
    for name, seconds in WINDOWS.items():
        assert {row["transaction_id"]: row[name] for row in got} == brute_velocity(data, seconds)


def test_velocity_without_a_time(spark):
    df = spark.createDataFrame([(1, "u", None, None), (2, "u", datetime(2024, 1, 1), None)], SCHEMA)
    for limit in (10, 0):
        assert rows(velocity(df, {"n": 60}, hot_limit=limit), "transaction_id", "n") == [(1, None), (2, 1)]


def test_fourth_within_the_window_makes_four(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "u", at + timedelta(seconds=100 * i), None) for i in range(4)], SCHEMA)
    assert rows(velocity(df), "transaction_id", "tx_count_last_5min") == [(0, 1), (1, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("limit", [10**6, 100])
def test_point_in_time_history(spark, data, limit):
    df = spark.createDataFrame(data, SCHEMA)
    got = {row["transaction_id"]: row for row in point_in_time_history(df, hot_limit=limit).collect()}
    earlier = defaultdict(list)
    for i, user, _, amount in sorted(data, key=lambda r: (r[2], r[0])):
        before = [float(x) for x in earlier[user]]
        assert got[i]["prior_count"] == len(before)
        assert got[i]["prior_avg_amount"] == pytest.approx(statistics.fmean(before) if before else 0.0)
        assert got[i]["prior_std_amount"] == pytest.approx(statistics.pstdev(before) if before else 0.0, abs=1e-9)
        earlier[user].append(amount)


def test_deviation_of_large_amounts(spark):
    amounts = ["9000000000.00", "9000000000.01", "9999999999.99", "-3.25"]
    data = [(i, "u", datetime(2031, 1, 1, i), Decimal(x)) for i, x in enumerate(amounts + ["0.00"])]
    got = point_in_time_history(spark.createDataFrame(data, "transaction_id long, user_id string, ts timestamp_ntz, amount decimal(12,2)")).collect()
    for row in got:
        before = [Decimal(x) for x in amounts[: row["transaction_id"]]]
        want = float(statistics.pstdev(before)) if before else 0.0
        assert row["prior_std_amount"] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("limit", [10**6, 100, 0])
def test_ordered_scan(spark, data, limit):
    df = spark.createDataFrame(data, SCHEMA)
    got = ordered_scan(
        df, ["user_id"], ["ts", "transaction_id"], position="n", previous={"before": "transaction_id"},
        prior={"total": ("sum", F.col("amount")), "low": ("min", F.col("amount")), "high": ("max", F.col("amount"))}, hot_limit=limit,
    ).collect()
    found = {row["transaction_id"]: row for row in got}
    seen = defaultdict(list)
    for i, user, _, amount in sorted(data, key=lambda r: (r[2], r[0])):
        past, row = seen[user], found[i]
        assert (row["n"], row["before"]) == (len(past) + 1, past[-1][0] if past else None)
        amounts = [a for _, a in past]
        want = (sum(amounts), min(amounts), max(amounts)) if amounts else (None, None, None)
        assert (row["total"], row["low"], row["high"]) == want
        past.append((i, amount))


def test_ordered_scan_of_a_whole_table(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    got = {row["transaction_id"]: row["n"] for row in ordered_scan(df, [], ["ts", "transaction_id"], position="n").collect()}
    order = sorted(data, key=lambda r: (r[2], r[0]))
    assert [got[row[0]] for row in order] == list(range(1, len(data) + 1))


def test_split_hot(spark, data):
    split = split_hot(spark.createDataFrame(data, SCHEMA), ["user_id"], 150)
    assert (split.cold.count(), split.hot.count(), split.n_keys) == (401, 200, 1)
    assert split_hot(spark.createDataFrame(data, SCHEMA), ["user_id"], 10**6).hot is None


def test_hot_and_cold_context_agree(spark, data):
    df = spark.createDataFrame(data, SCHEMA).withColumns(
        {"merchant_name": F.concat(F.lit("Shop "), F.col("transaction_id") % 5), "card_last4": F.lpad((F.col("transaction_id") % 7).cast("string"), 4, "0"),
         "country": F.lit("US")}
    )
    context = ScoringContext(
        blacklist=spark.createDataFrame([("SHOP 3",)], "merchant_name string"),
        known_cards=known_cards(df.filter("transaction_id < 200")),
        home_country=df.select("user_id", F.concat(F.lit("c-"), "user_id").alias("home_country")).dropna().distinct(),
        history=user_history(df, label=None).filter("user_id is not null"),
    )
    plain, split = (attach_context(df, context, hot_limit=limit) for limit in (10**6, 100))
    columns = sorted(plain.columns)
    assert rows(plain, *columns) == rows(split, *columns)


def test_user_history(spark):
    df = spark.createDataFrame([("a", 10.0, 0), ("a", 20.0, 0), ("a", 900.0, 1), ("b", 7.0, 0), ("c", 5.0, 1)], "user_id string, amount double, is_fraud int")
    found = user_history(df)
    assert rows(found) == [("a", 15.0, 5.0, 2), ("b", 7.0, 0.0, 1)]
    joined = attach_history(df.select("user_id").distinct(), found)
    assert rows(joined, "user_id", "avg_amount", "std_amount") == [("a", 15.0, 5.0), ("b", 7.0, 0.0), ("c", 0.0, 0.0)]


def test_known_cards_and_home(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", ""), ("b", None)], "user_id string, card_last4 string")
    assert rows(known_cards(df)) == [("a", "1")]
    users = spark.createDataFrame([("a", 1), ("b", 9)], "user_id string, nation_id int")
    nations = spark.createDataFrame([(1, "FR")], "nation_id int, home_country string")
    assert rows(home_country(users, nations)) == [("a", "FR"), ("b", None)]


def test_number_of_cells(monkeypatch):
    monkeypatch.undo()
    assert [_cells(n, 200) for n in (0, 1, 1001, 10**6, 10**9, 10**12)] == [1, 1, 2, 200, 500, 20_000]
