from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from catalogue import tables as t
from riskloom.operators.audit import verify
from riskloom.operators.drift import latest_status, list_runs
from riskloom.operators.reports import parse_requests
from riskloom.plans.monitoring import monitor, track_run
from riskloom.plans.scoring import store_scoring
from riskloom.streaming.jobs import run_to_end


def test_store_scoring(spark, folder, tmp_path):
    stored = store_scoring(t.scored(spark, folder), str(tmp_path))
    n, frauds = stored.count(), stored.filter("classification = 'fraud'").count()
    assert (n, frauds) == (1000, 123)
    assert spark.read.parquet(f"{tmp_path}/scores").count() == n
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == frauds
    assert verify(spark.read.parquet(f"{tmp_path}/audit")).count() == 0


def test_monitor_and_track(spark, tmp_path):
    reference = spark.range(500).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    current = reference.select(
        (F.col("a") + 100).alias("a"), "b", F.when(F.col("a") > 4, 1).otherwise(0).alias("predicted"), F.when(F.col("a") > 3, 1).otherwise(0).alias("actual")
    )
    found = monitor(reference, current, ["a", "b"])
    assert rows(found.drift, "feature", "drift_detected") == [("a", True), ("b", False)]
    path = f"{tmp_path}/runs"
    track_run(found, path, "v1", datetime(2024, 1, 1))
    track_run(found, path, "v2", datetime(2024, 1, 2))
    newest = list_runs(spark.read.parquet(path)).first()
    assert newest["model_version"] == "v2" and newest["drift_detected"] and newest["metrics"]["f1"] == round(10 / 11, 4)
    assert latest_status(spark.read.parquet(path)).first()[0] == "ready"


def test_requests_from_a_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    lines = [('{"transaction_id": "t1", "retry_count": 2}',), ("not json",), ('{"transaction_id": "t2"}',)]
    spark.createDataFrame(lines, "value string").write.text(source)
    for kind in (0, 1):
        chosen = parse_requests(spark.readStream.text(source))[kind]
        out = f"{tmp_path}/out{kind}"
        run_to_end(chosen.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp{kind}"))
    assert rows(spark.read.parquet(f"{tmp_path}/out0"), "transaction_id", "retry_count") == [("t1", 2), ("t2", 0)]
    assert rows(spark.read.parquet(f"{tmp_path}/out1")) == [("not json",)]
