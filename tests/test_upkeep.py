"""Tables kept up to date equal those read anew; lookups read one bucket; one way of sampling at any size."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskloom.operators.dashboard import alerts_per_rule, dashboard_kpis, score_histogram, transactions_per_day
from riskloom.operators.forest import draw_samples
from riskloom.operators.history import known_cards, user_history
from riskloom.operators.tables import get_by_id
from riskloom.plans import upkeep
from riskloom.plans.scoring import alerts_from_scores
from riskloom.sources.tables import store_by_key

START = datetime(2024, 3, 1)
TX = "transaction_id long, user_id long, amount decimal(12,2), is_fraud int, card_last4 string"


def transactions(spark, n, seed):
    draw = random.Random(seed)
    lines = []
    for i in range(n):
        user = draw.choice([1, 1, 1, 2, 3, None])
        amount = draw.choice([None, Decimal("9999999999.99"), Decimal("9999999999.98"), Decimal(draw.randrange(10**6)) / 100])
        lines.append((i, user, amount, draw.choice([0, 0, 0, 1, None]), draw.choice(["1", "22", "", None])))
    return spark.createDataFrame(lines, TX)


def test_history_and_cards_of_merged_batches(spark, tmp_path):
    table = transactions(spark, 600, 1)
    path = str(tmp_path)
    for i in range(3):
        part = table.filter(F.col("transaction_id") % 3 == i)
        for given in (part.limit(5), part):  # a batch that comes again in full
            upkeep.update_history(given, path, str(i))
            upkeep.update_cards(given, path, str(i))
    kept = {r["user_id"]: r for r in upkeep.kept_history(spark, path).collect()}
    want = {r["user_id"]: r for r in user_history(table).collect()}
    assert kept.keys() == want.keys()
    for user, row in want.items():
        assert kept[user]["n_transactions"] == row["n_transactions"] and kept[user]["avg_amount"] == row["avg_amount"]
        assert kept[user]["std_amount"] == pytest.approx(row["std_amount"], rel=1e-9)
    assert rows(upkeep.kept_cards(spark, path)) == rows(known_cards(table))
    close = spark.createDataFrame([(1, 7, Decimal("9999999999.98"), 0, "1"), (2, 7, Decimal("9999999999.99"), 0, "1"), (3, 8, None, 0, "1")], TX)
    found = {r["user_id"]: r["std_amount"] for r in upkeep.history_of(upkeep.merged_moments(upkeep.moments_of(close))).collect()}
    assert found == {7: 0.005, 8: None}  # exact: nothing cancels


def test_dashboard_of_kept_days(spark, tmp_path):
    draw = random.Random(3)
    schema = "transaction_id long, status string, deleted_at timestamp_ntz, ensemble_score double, threshold double, classification string, fired_rules array<string>, created_at timestamp_ntz"
    lines = [
        (i, draw.choice(["blocked", "approved"]), draw.choice([None, None, START]), draw.choice([None, draw.randrange(101) + 0.5, 40.0]), 50.0, draw.choice(["fraud", "legitimate"]), draw.sample(["a", "b"], draw.randrange(3)), START + timedelta(hours=i))
        for i in range(200)
    ]
    table = spark.createDataFrame(lines, schema)
    runs = spark.createDataFrame([("v", "ready", START)], "model_version string, status string, created_at timestamp_ntz")
    path = f"{tmp_path}/days"
    wrong = table.withColumns({"status": F.lit("blocked"), "ensemble_score": F.lit(1.0), "classification": F.lit("fraud")})
    upkeep.update_days(upkeep.day_measures(wrong, wrong, alerts_from_scores(wrong)), path)
    for low, high in ((0, 90), (90, 200)):  # later days first wrong, then right
        part = table.filter((F.dayofyear("created_at") >= 61 + low // 24) & (F.dayofyear("created_at") <= 61 + high // 24))
        upkeep.update_days(upkeep.day_measures(part, part, alerts_from_scores(part)), path)
    kept = upkeep.kept_days(spark, path)
    assert rows(upkeep.kpis_of(kept, runs)) == rows(dashboard_kpis(table, table, alerts_from_scores(table), runs))
    assert rows(upkeep.histogram_of(kept), "range", "count") == rows(score_histogram(table), "range", "count")
    assert rows(upkeep.per_rule(kept)) == rows(alerts_per_rule(table))
    assert rows(upkeep.per_day(kept)) == rows(transactions_per_day(table))


@pytest.mark.parametrize("key", ["transaction_id", "user_id"])
def test_a_key_is_read_from_one_bucket(spark, tmp_path, key):
    table = transactions(spark, 500, 4)
    stored = store_by_key(table, f"by_{key}", f"{tmp_path}/t", key, buckets=8)
    found = get_by_id(stored, 2, key)
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # off, so that the plan tells the buckets it reads
    spark.conf.set(name, "false")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(get_by_id(stored, 2, key)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset(name)
    assert "SelectedBucketsCount: 1 out of 8" in plan, plan
    assert rows(found) == rows(get_by_id(table, 2, key)) and found.count() > 0


@pytest.mark.parametrize("n", [50, 3000, 200_000])
def test_one_way_of_sampling(spark, n):
    """Trees have psi rows of even chance, the same whatever the partitioning, in a table below psi or far above."""
    trees, psi = 20, 64
    one = draw_samples(spark.range(n).coalesce(1), "id", n, trees, min(psi, n), 5).select("tree", "id")
    many = draw_samples(spark.range(n).repartition(13), "id", n, trees, min(psi, n), 5).select("tree", "id")
    drawn = rows(one)
    assert drawn == rows(many)
    sizes = {t: sum(1 for tree, _ in drawn if tree == t) for t in range(trees)}
    assert sizes == {t: min(psi, n) for t in range(trees)}
    assert len(set(drawn)) == len(drawn)
    assert abs(sum(i for _, i in drawn) / len(drawn) / n - 0.5) < 0.05
