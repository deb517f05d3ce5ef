import hashlib
import json
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskloom.operators.alerts import action_transitions, fold_actions, illegal_actions
from riskloom.operators.audit import (
    audit_actions,
    audit_reports,
    audit_scoring,
    canonical_json,
    chains,
    entries,
    trail_for_analyst,
    trail_for_transaction,
    verify,
)
from riskloom.sources.tables import audit_between, export_audit, read_audit_export

AT = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def scored(spark):
    data = [("t1", "u1", 30.0, 0.0, 13.5, 60.0, "legitimate", ["high_amount"], AT), ("t2", "ü\"2", 0.0, 0.0, 0.0, 70.0, "legitimate", [], AT)]
    schema = (
        "transaction_id string, user_id string, rule_score double, ml_score double, ensemble_score double, threshold double, "
        "classification string, fired_rules array<string>, created_at timestamp_ntz"
    )
    return spark.createDataFrame(data, schema)


def test_scoring_entry(scored):
    entry = {row["transaction_id"]: row for row in audit_scoring(scored).collect()}
    assert entry["t1"]["sha256_checksum"] == "38e91d8ac67b40dd560730d6899f988a5974f99d15d1487d9a29177682e71bf7"
    details = {
        "rule_score": 0.0, "ml_score": 0.0, "ensemble_score": 0.0, "threshold": 70.0, "classification": "legitimate", "fired_rules": [],
    }
    body = {"action_type": "transaction_scored", "transaction_id": "t2", "user_id": 'ü"2', "details": details}
    text = json.dumps(body, sort_keys=True)
    assert entry["t2"]["sha256_checksum"] == hashlib.sha256(text.encode()).hexdigest()


def test_canonical_text(spark):
    details = '{"generation_time_ms": 1500, "model": "llama3.2:3b"}'
    df = entries(spark.createDataFrame([("report_generated", "tx-uuid", details, AT)], "action_type string, transaction_id string, details string, created_at timestamp_ntz"))
    row = df.withColumn("text", canonical_json()).first()
    assert row["text"] == '{"action_type": "report_generated", "details": ' + details + ', "transaction_id": "tx-uuid"}'
    assert row["sha256_checksum"] == "3922ace6adf77ce507bcd1a59d3a2dfba1936ad7f573fc5c4f2a850721163175"


ALERTS = "alert_id string, transaction_id string, status string, reviewed_by string, reviewed_at timestamp_ntz"
ACTIONS = "action_id string, alert_id string, action string, analyst_id string, reason string, acted_at timestamp_ntz"


@pytest.fixture(scope="module")
def alert_tables(spark):
    alerts = spark.createDataFrame([("a1", "t1", "open", None, None), ("a2", "t2", "open", None, None), ("a3", "t3", "open", None, None)], ALERTS)
    steps = [("a1", "review", "u2", None), ("a1", "revert", "u3", "x"), ("a1", "revert", "u3", "x"), ("a2", "false_positive", "u2", " ")]
    actions = [(f"s{i}", a, kind, who, why, AT + timedelta(hours=i)) for i, (a, kind, who, why) in enumerate(steps)]
    return alerts, spark.createDataFrame(actions, ACTIONS)


def test_fold(alert_tables):
    assert rows(fold_actions(*alert_tables), "alert_id", "status", "reviewed_by", "reviewed_at") == [
        ("a1", "open", "u3", AT + timedelta(hours=2)),
        ("a2", "resolved", "u2", AT + timedelta(hours=3)),
        ("a3", "open", None, None),
    ]


@pytest.mark.parametrize("limit", [100, 0])
def test_transitions(alert_tables, limit):
    moves = action_transitions(*alert_tables, hot_limit=limit)
    assert rows(moves, "action_id", "previous_status", "new_status") == [
        ("s0", "open", "reviewed"), ("s1", "reviewed", "open"), ("s2", "open", "open"), ("s3", "open", "resolved"),
    ]
    bad = illegal_actions(moves)
    assert rows(bad, "action_id", "problems") == [("s2", ["illegal_transition"]), ("s3", ["missing_reason"])]
    first = audit_actions(moves.filter("action_id = 's0'")).first()
    assert first["sha256_checksum"] == "13fec88a5f0013dfe720c8f7c240be1b6c0917b5a58bb36c25b2a18f962c2f66"


def test_report_entries(spark):
    schema = "transaction_id string, model_name string, status string, generation_time_ms int, retry_count int, error string, created_at timestamp_ntz"
    df = spark.createDataFrame([("t1", "m", "completed", None, 0, None, AT), ("t2", "m", "failed", None, 3, "boom \"x\"", AT)], schema)
    found = {row["transaction_id"]: row for row in audit_reports(df).collect()}
    assert found["t1"]["action_type"] == "report_generated"
    assert found["t1"]["details"] == json.dumps({"generation_time_ms": None, "model": "m", "retry_count": 0, "status": "completed"})
    assert found["t2"]["action_type"] == "report_failed"
    assert found["t2"]["details"] == json.dumps({"error": 'boom "x"', "model": "m", "retry_count": 3, "status": "failed"})


@pytest.fixture(scope="module")
def trail(spark):
    data = [("review", f"t{i % 3}", f"u{i % 2}", '{"n": %d}' % i, AT + timedelta(minutes=(7 * i) % 30)) for i in range(30)]
    return entries(spark.createDataFrame(data, "action_type string, transaction_id string, user_id string, details string, created_at timestamp_ntz"))


def test_trails(trail):
    for found, count in ((trail_for_transaction(trail, "t1"), 10), (trail_for_analyst(trail, "u0"), 15)):
        times = [row["created_at"] for row in found.collect()]
        assert len(times) == count and times == sorted(times)


@pytest.mark.parametrize("limit", [100, 0])
def test_chains(trail, limit):
    steps = chains(trail, hot_limit=limit).orderBy("transaction_id", "created_at", "sha256_checksum").collect()
    assert [row["step"] for row in steps] == list(range(1, 11)) * 3


def test_verify(trail):
    assert verify(trail).count() == 0
    changed = trail.withColumn("user_id", F.when(F.col("details") == '{"n": 4}', "u9").otherwise(F.col("user_id")))
    assert [row["details"] for row in verify(changed).collect()] == ['{"n": 4}']
    assert verify(trail.withColumn("sha256_checksum", F.lit(None).cast("string"))).count() == 30


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_export(spark, trail, tmp_path, fmt):
    path, lo, hi = f"{tmp_path}/{fmt}", AT + timedelta(minutes=5), AT + timedelta(minutes=20)
    export_audit(trail, path, lo, hi, fmt)
    back = read_audit_export(spark, path, fmt)
    assert rows(back) == rows(audit_between(trail, lo, hi)) and verify(back).count() == 0
    with pytest.raises(ValueError):
        export_audit(trail, path, lo, hi, "xml")
