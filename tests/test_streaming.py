import bisect
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from catalogue.queries import QUERIES
from conftest import rows
from pyspark.sql import functions as F

from riskloom.operators.audit import verify
from riskloom.operators.context import ScoringContext
from riskloom.plans.scoring import score_transactions
from riskloom.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = (
    "transaction_id long, user_id string, amount decimal(12,2), merchant_name string, merchant_category string, card_last4 string, "
    "country string, ts timestamp_ntz, created_at timestamp_ntz"
)


def make(spark, numbers, gap=40):
    at = F.timestamp_add("SECOND", F.col("transaction_id") * gap, F.lit(START).cast("timestamp_ntz"))
    df = spark.createDataFrame([(i,) for i in numbers], "transaction_id long")
    key = F.col("transaction_id")
    return df.select(
        key,
        F.when(key % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), key % 5)).alias("user_id"),
        (key * 700 % 9000).cast("decimal(12,2)").alias("amount"),
        F.concat(F.lit("Shop "), key % 4).alias("merchant_name"),
        F.lit("retail").alias("merchant_category"),
        F.lpad((key % 6).cast("string"), 4, "0").alias("card_last4"),
        F.when(key % 7 == 0, "FR").otherwise("US").alias("country"),
        at.alias("ts"),
        at.alias("created_at"),
    )


@pytest.fixture
def files(spark, tmp_path):
    """Three files, in order."""
    path = f"{tmp_path}/in"
    for part in range(3):
        make(spark, range(part * 100, part * 100 + 100)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return jobs.read_stream(spark, path, spark.read.parquet(path).schema, "*.parquet", per_trigger=1)


@pytest.fixture
def context(spark):
    users = [("hot",)] + [(f"u{i}",) for i in range(5)]
    return ScoringContext(
        blacklist=spark.createDataFrame([("SHOP 2",)], "merchant_name string"),
        known_cards=spark.createDataFrame([(u, f"000{c}") for (u,) in users for c in range(4)], "user_id string, card_last4 string"),
        home_country=spark.createDataFrame([(u, "US") for (u,) in users], "user_id string, home_country string"),
    )


def test_stream_scores_equal_batch_scores(spark, files, context, tmp_path):
    weights = {"rule": 1.0}
    scored = jobs.score_stream(stream(spark, files), context, weights=weights)
    out = f"{tmp_path}/out"
    jobs.run_to_end(jobs.scoring_sink(scored, out, f"{tmp_path}/cp"))
    batch = score_transactions(spark.read.parquet(files), context, weights=weights, windows={"tx_count_last_5min": 0, "tx_count_last_1h": 0})
    columns = ("transaction_id", "rule_score", "ensemble_score", "threshold", "classification", "fired_rules")
    scores = jobs.read_sink(spark, f"{out}/scores")
    assert rows(scores, *columns) == rows(batch, *columns)
    assert scores.select("batch_id").distinct().count() == 3
    frauds = batch.filter("classification = 'fraud'")
    assert frauds.count() > 0
    assert rows(jobs.read_sink(spark, f"{out}/alerts"), "transaction_id") == rows(frauds, "transaction_id")
    entries = jobs.read_sink(spark, f"{out}/audit")
    assert entries.count() == 300 and verify(entries).count() == 0


def test_a_repeated_batch_replaces_itself(spark, files, tmp_path):
    batch = make(spark, range(5))
    for _ in range(2):
        jobs._write_batch(batch, f"{tmp_path}/t", 7)
    assert jobs.read_sink(spark, f"{tmp_path}/t").count() == 5


@pytest.mark.parametrize("limit", [10**6, 20])
def test_stream_velocity(spark, files, tmp_path, limit):
    windows = {"n": 300, "m": 3600}
    path = f"{tmp_path}/v"
    jobs.run_to_end(jobs.velocity_sink(stream(spark, files), path, f"{tmp_path}/cp", windows, hot_limit=limit))
    found = {row["transaction_id"]: row for row in jobs.read_sink(spark, path).collect()}
    times = defaultdict(list)
    assert len(found) == 300
    for i in range(300):
        user, at = found[i]["user_id"], found[i]["ts"]
        times[user].append(at)
        for name, seconds in windows.items():
            assert found[i][name] == len(times[user]) - bisect.bisect_left(times[user], at - timedelta(seconds=seconds))


def test_window_kpis(spark, files, tmp_path):
    rows_in = stream(spark, files).select(
        "ts", F.when(F.col("transaction_id") % 2 == 0, "fraud").otherwise("review").alias("classification"), F.lit(2.0).alias("ensemble_score")
    )
    path = f"{tmp_path}/k"
    writer = jobs.window_kpis(rows_in, width="1 hour", delay="5 minutes").writeStream.format("parquet").option("path", path)
    jobs.run_to_end(writer.option("checkpointLocation", f"{tmp_path}/cp"))
    # 300 rows 40 s apart reach into the fourth hour; the first three have closed.
    assert rows(spark.read.parquet(path)) == [
        (START + timedelta(hours=h), START + timedelta(hours=h + 1), 90, 45, 2.0) for h in range(3)
    ]


def test_window_kpis_with_the_windows_still_open(spark, files, tmp_path):
    def rated(df):
        return df.select("ts", F.lit("fraud").alias("classification"), F.lit(2.0).alias("ensemble_score"))

    path = f"{tmp_path}/k"
    writer = jobs.window_kpis(rated(stream(spark, files)), width="1 hour", delay="5 minutes").writeStream.format("parquet").option("path", path)
    jobs.run_to_end(writer.option("checkpointLocation", f"{tmp_path}/cp"))
    whole = jobs.with_open_windows(spark.read.parquet(path), rated(spark.read.parquet(files)), width="1 hour")
    # 300 rows 40 s apart: 90 in each of three closed hours, 30 in the open fourth.
    assert rows(whole, "window_start", "n_transactions") == [(START + timedelta(hours=h), n) for h, n in enumerate((90, 90, 90, 30))]


def test_stream_kpis_has_every_day(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    want = rows(events.groupBy(F.to_date("ts").alias("d")).count())
    got = QUERIES["stream_kpis"](spark, folder)
    assert rows(got.select(F.to_date("window_start").alias("d"), "n_transactions")) == want


def test_run_to_end_has_no_limit_of_its_own():
    class Slow:
        """A writer and its query in one; a limited wait always ends too early."""

        stopped = False

        def trigger(self, availableNow):
            return self

        def start(self):
            return self

        def awaitTermination(self, timeout=None):
            return None if timeout is None else False

        def stop(self):
            self.stopped = True

    slow = Slow()
    jobs.run_to_end(slow)
    assert not slow.stopped
    with pytest.raises(TimeoutError):
        jobs.run_to_end(slow, timeout=5)
    assert slow.stopped


def test_unique_requests(spark, tmp_path):
    path = f"{tmp_path}/in"
    for part in ([0, 1, 2, 3], [2, 3, 4], [4, 5]):
        make(spark, part).coalesce(1).write.mode("append").parquet(path)
    out = f"{tmp_path}/out"
    unique = jobs.unique_requests(stream(spark, path)).select("transaction_id")
    writer = unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp")
    jobs.run_to_end(writer)
    assert rows(spark.read.parquet(out)) == [(i,) for i in range(6)]
