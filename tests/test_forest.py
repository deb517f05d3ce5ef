import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskloom.functions.ensemble import ml_score
from riskloom.operators.forest import average_path, draw_samples, fit_forest, load_forest, predict_anomaly, save_forest
from riskloom.plans.training import train
from riskloom.sources.synthetic import synthesize_for, synthesize_transactions, user_profiles
from riskloom.sources.tables import read_transactions_csv, write_csv

COLUMNS = [f"x{i}" for i in range(10)]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(7)
    data = np.vstack([rng.normal(50, 10, (50, 10)), rng.normal(500, 100, (10, 10))])
    schema = "transaction_id long, " + ", ".join(f"{c} double" for c in COLUMNS)
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(data)], schema)


@pytest.fixture(scope="module")
def model(matrix):
    return fit_forest(matrix, [F.col(c) for c in COLUMNS], n_trees=50, contamination=0.1)


def score(model, df):
    return model.add_decision(df, [F.col(c) for c in COLUMNS]).withColumn("score", ml_score(F.col("decision")))


def test_average_path():
    assert average_path(256) == pytest.approx(10.244770920116851)
    assert (average_path(1), average_path(2)) == (0.0, 1.0)


def test_scores(spark, matrix, model):
    found = score(model, matrix).collect()
    assert all(0 <= row["score"] <= 100 for row in found)
    assert sum(row["decision"] < 0 for row in found) == 6
    normal = [row["score"] for row in found[:50]]
    far = [row["score"] for row in found[50:]]
    assert np.mean(far) > np.mean(normal) + 10
    extreme = spark.createDataFrame([(100, *[1e9] * 10), (101, *[50.0] * 10)], matrix.schema)
    out = {row["transaction_id"]: row["score"] for row in score(model, extreme).collect()}
    assert out[100] > 50 > out[101]


def test_prediction(value):
    assert value(predict_anomaly(F.lit(-0.1))) == 1 and value(predict_anomaly(F.lit(0.0))) == 0


def test_independent_of_partitioning(matrix, model):
    again = fit_forest(matrix.repartition(7), [F.col(c) for c in COLUMNS], n_trees=50, contamination=0.1)
    assert rows(again.nodes) == rows(model.nodes) and again.offset == pytest.approx(model.offset)
    other = fit_forest(matrix, [F.col(c) for c in COLUMNS], n_trees=50, seed=1)
    assert rows(other.nodes) != rows(model.nodes)


def walk(nodes, point):
    """Depth at which a point is isolated in one tree, node by node."""
    at = 0
    while nodes[at]["feature"] >= 0:
        at = 2 * at + (2 if point[nodes[at]["feature"]] > nodes[at]["split"] else 1)
    return nodes[at]["depth"] + average_path(nodes[at]["size"])


def test_scores_against_walking_the_trees(matrix, model):
    trees = {}
    for row in model.nodes.collect():
        trees.setdefault(row["tree"], {})[row["node"]] = row
    assert len(trees) == 50
    assert all(sum(n["size"] for n in tree.values() if n["feature"] < 0) == 60 for tree in trees.values())
    for row in score(model, matrix.limit(20)).collect():
        depth = np.mean([walk(tree, [row[c] for c in COLUMNS]) for tree in trees.values()])
        assert row["decision"] == pytest.approx(-(2 ** (-depth / average_path(60))) - model.offset)


@pytest.mark.parametrize("n,trees,psi", [(5000, 10, 64), (5000, 4, 16), (100, 10, 64)])
def test_samples(spark, n, trees, psi):
    drawn = draw_samples(spark.range(n), "id", n, trees, psi, 3)
    counts = [row["count"] for row in drawn.groupBy("tree").count().collect()]
    assert counts == [min(psi, n)] * trees
    assert drawn.groupBy("tree", "id").count().filter("count > 1").count() == 0


def test_save_and_load(spark, matrix, model, tmp_path):
    save_forest(model, f"{tmp_path}/model")
    back = load_forest(spark, f"{tmp_path}/model")
    assert rows(score(back, matrix), "transaction_id", "score") == rows(score(model, matrix), "transaction_id", "score")
    assert load_forest(spark, f"{tmp_path}/nothing") is None


def test_synthetic_rows(spark, tmp_path):
    df = synthesize_transactions(spark, 20000)
    assert rows(df.limit(100)) == rows(synthesize_for(spark.range(20000).repartition(3), "id").filter("transaction_id < 'tx-000100'"))
    facts = df.agg(
        F.avg("is_fraud").alias("fraud"), F.countDistinct("user_id").alias("users"), F.min("amount").alias("least"),
        F.avg(F.when(F.col("is_fraud") == 0, (F.col("merchant_category") == "low_risk").cast("int"))).alias("low"),
        F.count_if((F.col("is_fraud") == 1) & (F.col("merchant_category") != "high_risk")).alias("odd"),
        F.avg(F.when(F.col("is_fraud") == 0, F.col("amount") - F.col("user_avg_amount"))).alias("bias"),
    ).first()
    assert facts["fraud"] == pytest.approx(0.05, abs=0.006) and facts["users"] == 100 and facts["least"] >= 1
    assert facts["low"] == pytest.approx(0.7, abs=0.02) and facts["odd"] == 0 and abs(facts["bias"]) < 2
    assert user_profiles(spark).count() == 100
    path = f"{tmp_path}/csv"
    write_csv(df, path)
    back = read_transactions_csv(spark, path)
    assert rows(back.drop("ts")) == rows(df)
    assert back.filter("ts IS NULL OR hour(ts) <> cast(substr(timestamp, 12, 2) as int)").count() == 0


def test_training(spark, tmp_path):
    df = synthesize_transactions(spark, 5000)
    path = f"{tmp_path}/csv"
    write_csv(df, path)
    trained = train(read_transactions_csv(spark, path), n_trees=30, path=f"{tmp_path}/model")
    row = trained.metrics.first()
    share = df.agg(F.avg("is_fraud")).first()[0]
    assert row["n_samples"] == 5000 and abs(row["n_anomalies"] / 5000 - share) < 0.01
    assert row["roc_auc"] > 0.8 and 0 < row["precision"] <= 1 and 0 < row["pr_auc"] <= 1
    assert load_forest(spark, f"{tmp_path}/model").n_trees == 30
