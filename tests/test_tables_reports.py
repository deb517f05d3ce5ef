from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskloom.functions.prompt import SECTIONS, build_prompt, fill
from riskloom.operators import dashboard, reports, tables
from riskloom.sources.tables import append, append_by_day, read_reference_sample, replace_reference_sample

AT = datetime(2024, 1, 10)
TX = "transaction_id long, user_id string, amount double, status string, created_at timestamp_ntz, deleted_at timestamp_ntz"


@pytest.fixture(scope="module")
def table(spark):
    status = ["approved", "flagged", "blocked"]
    data = [(i, f"u{i % 4}", float(i), status[i % 3], AT + timedelta(hours=i // 2), AT if i % 10 == 9 else None) for i in range(40)]
    return spark.createDataFrame(data, TX)


def ids(df):
    return [row["transaction_id"] for row in df.collect()]


def test_filters(table):
    assert len(ids(tables.live(table))) == 36
    found = tables.filter_transactions(table, status="flagged", user_id="u1", date_from=AT, date_to=AT + timedelta(hours=6))
    assert sorted(ids(found)) == [1, 13]
    assert tables.total(tables.filter_alerts(table, status="blocked")).first()["total"] == 13
    assert ids(tables.get_by_id(table, 9)) == [9]


def test_pages_cover_the_list_once(table):
    listed = ids(tables.newest_first(table))
    assert listed[:4] == [38, 39, 36, 37]
    pages = [ids(tables.page(table, n, 15)) for n in (1, 2, 3)]
    assert pages == [listed[:15], listed[15:30], listed[30:]]
    last = tables.page(table, 1, 15).collect()[-1]
    assert ids(tables.page_after(table, last["created_at"], last["transaction_id"], 15)) == listed[15:30]
    for number, size in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            tables.page(table, number, size)


def test_soft_delete(spark, table):
    some = spark.createDataFrame([(1,), (1,), (9,), (777,)], "transaction_id long")
    later = datetime(2024, 3, 1)
    changed = {row["transaction_id"]: row["deleted_at"] for row in tables.soft_delete(table, some, later).collect()}
    assert len(changed) == 40 and changed[1] == later and changed[9] == AT and changed[2] is None


def test_sorting(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0)], "transaction_id long, risk_score double")
    assert ids(tables.sort_transactions(df, "risk_score", "asc")) == [1, 3, 2]
    assert ids(tables.sort_transactions(df, "risk_score", "desc")) == [3, 1, 2]


def test_validation(spark):
    schema = "transaction_id string, amount double, currency string, merchant_name string, merchant_category string, card_last4 string, user_id string"
    good = ("t", 1.0, "USD", "m", None, "1234", "u")
    broken = {"amount": 0.0, "currency": "US", "merchant_name": "x" * 256, "merchant_category": "x" * 101, "card_last4": "123", "user_id": None}
    names = schema.replace(" double", "").replace(" string", "").split(", ")
    data = [good] + [tuple(value if name == field else g for name, g in zip(names, good)) for field, value in broken.items()]
    data.append(("t", None, None, None, None, None, "u"))
    valid, rejects = tables.validate(spark.createDataFrame(data, schema))
    assert rows(valid) == [good]
    reasons = sorted(row["reasons"] for row in rejects.collect())
    assert reasons == sorted([[name] for name in broken] + [["amount", "currency", "merchant_name", "card_last4"]])


def test_responses(table):
    item = tables.transaction_response(table.withColumn("ensemble_score", F.lit(7.5))).first().asDict()
    assert item["id"] == 0 and item["risk_score"] == 7.5
    assert tables.transaction_response(table).first()["risk_score"] is None


def test_kpis(spark, table):
    scores = spark.createDataFrame([(10.0,), (20.005,)], "ensemble_score double")
    alerts = spark.createDataFrame([("open",), ("open",), ("resolved",)], "status string")
    runs = spark.createDataFrame([("v1", "failed", AT), ("v2", "ready", AT + timedelta(days=1))], "model_version string, status string, created_at timestamp_ntz")
    row = dashboard.dashboard_kpis(table, scores, alerts, runs).first()
    assert tuple(row) == (36, 33.33, 15.0, 2, "ready")
    empty = dashboard.dashboard_kpis(table.limit(0), scores.limit(0), alerts.limit(0), runs.limit(0)).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0, "unknown")


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 20.0, 20.5, 21.0, 60.0, 100.0)], "ensemble_score double")
    assert [tuple(r) for r in dashboard.score_histogram(df).collect()] == [("0-20", 2), ("21-40", 1), ("41-60", 1), ("61-80", 0), ("81-100", 1)]
    assert [r["count"] for r in dashboard.score_histogram(df, contiguous=True).collect()] == [2, 2, 1, 0, 1]


def test_trend(spark):
    now = datetime(2024, 1, 10, 12)
    data = [(10.0, now), (10.1, now - timedelta(hours=1)), (0.0, now), (None, now), (30.0, now - timedelta(days=3)),
            (50.0, now - timedelta(days=7, seconds=-1)), (70.0, now - timedelta(days=7, seconds=1))]
    df = spark.createDataFrame(data, "ensemble_score double, created_at timestamp_ntz")
    trend = dict(rows(dashboard.score_trend(df, now)))
    assert len(trend) == 7 and trend["2024-01-10"] == 10.1 and trend["2024-01-07"] == 30.0 and trend["2024-01-04"] == 0.0


def test_charts(spark):
    schema = "transaction_id long, classification string, fired_rules array<string>, country string, created_at timestamp_ntz"
    df = spark.createDataFrame([(1, "fraud", ["a", "b"], "FR", AT), (2, "fraud", ["a"], "US", AT), (3, "review", ["b"], "US", AT)], schema)
    assert rows(dashboard.alerts_per_rule(df)) == [("a", 2), ("b", 1)]
    assert rows(dashboard.fraud_by_country(df)) == [("FR", 1, 1), ("US", 2, 1)]
    assert rows(dashboard.transactions_per_day(df)) == [(date(2024, 1, 10), 3)]


def test_detail_keeps_transactions_without_entries(spark, table):
    scores = spark.createDataFrame([(1, 5.0)], "transaction_id long, ensemble_score double")
    report = spark.createDataFrame([(1, "pending", None)], "transaction_id long, status string, report_text string")
    trail = spark.createDataFrame([("1", "x", AT, "c1"), ("1", "y", AT, "c2")], "transaction_id string, action_type string, created_at timestamp_ntz, sha256_checksum string")
    found = dashboard.transaction_detail(table.filter("transaction_id < 3").select("transaction_id"), scores, report, trail)
    assert rows(found, "transaction_id", "ensemble_score", "report_status", "entry_action") == [
        (0, None, None, None), (1, 5.0, "pending", "x"), (1, 5.0, "pending", "y"), (2, None, None, None),
    ]


def prompt(value, **given):
    columns = dict.fromkeys(
        ("transaction_id", "amount", "currency", "merchant_name", "rule_score", "ml_score", "ensemble_score", "threshold"), F.lit(None)
    )
    columns["fired_rules"] = F.array(*[F.lit(x) for x in given.pop("fired", [])]).cast("array<string>")
    columns.update({name: F.lit(x) for name, x in given.items()})
    return value(build_prompt(**columns))


def test_prompt(value):
    text = prompt(value, transaction_id="op-9", amount=81.5, currency="CLP", merchant_name="Kiosk", rule_score=33.25, ml_score=7.0,
                  ensemble_score=18.05, threshold=60.0, fired=["unusual_hours", "card_mismatch"])
    for part in ("id=op-9;", "importe=81.5 CLP;", "comercio=Kiosk\n", "reglas=33.2;", "anomalía=7.0;", "límite=60.0\n", "- unusual_hours\n- card_mismatch\n"):
        assert part in text
    assert all(title in text for title in SECTIONS)


def test_prompt_without_data(value):
    text = prompt(value)
    for part in ("id=N/A;", "importe=N/A USD;", "comercio=N/A\n", "reglas=0.0;", "límite=70.0\n", "- Ninguna regla activada"):
        assert part in text
    assert value(fill("{a}-{{x}}-{a}", {"a": F.lit("1")})) == "1-{x}-1"


def test_queue(spark):
    schema = "transaction_id string, amount double, currency string, merchant_name string, rule_score double, ml_score double, ensemble_score double, threshold double, fired_rules array<string>, classification string"
    def row(key, kind):
        return (key, 9.5, "USD", "m", 1.0, 0.0, 0.5, 40.0, ["a"], kind)
    scored = spark.createDataFrame([row("t1", "fraud"), row("t1", "fraud"), row("t2", "fraud"), row("t3", "review")], schema)
    known = spark.createDataFrame([("t2",)], "transaction_id string")
    queue = reports.report_queue(scored, known)
    assert rows(queue, "transaction_id", "retry_count") == [("t1", 0)]
    assert reports.report_queue(scored, known.unionByName(queue.select("transaction_id"))).count() == 0
    lines = queue.select(reports.request_message().alias("value"))
    parsed, bad = reports.parse_requests(lines.union(spark.createDataFrame([("{broken",), ("[]",), ("",), ('{"retry_count": 2}',)], "value string")))
    assert rows(parsed, "transaction_id", "retry_count", "score_breakdown.fired_rules", "transaction.amount") == [
        ("t1", 0, ["a"], 9.5), ("unknown", 2, None, None),
    ]
    assert sorted(r["value"] for r in bad.collect()) == ["", "[]", "{broken"]


@pytest.mark.parametrize(
    "text,status", [("Error: no connection", "failed"), ("Error inesperado al generar", "completed"), ("Informe", "completed"), ("error: x", "completed")]
)
def test_outcome(value, text, status):
    assert value(reports.outcome_of(F.lit(text))) == status


def test_retries(spark):
    df = spark.createDataFrame([(n, AT) for n in (None, 0, 1, 2, 3, 4)], "retry_count int, failed_at timestamp_ntz")
    plan = [(r["outcome"], r["next_retry_count"], r["delay_seconds"]) for r in reports.retry_plan(df).collect()]
    assert plan == [("retry", 1, 3), ("retry", 1, 3), ("retry", 2, 9), ("retry", 3, 27), ("failed", None, None), ("failed", None, None)]
    assert reports.retry_plan(df).collect()[3]["next_attempt_at"] == AT + timedelta(seconds=27)


def test_status(spark):
    tx = spark.createDataFrame([(i,) for i in range(4)], "transaction_id int")
    done = spark.createDataFrame([(1, "pending", None), (2, "failed", "Error: x"), (3, "completed", "ok")], "transaction_id int, status string, report_text string")
    found = {r["transaction_id"]: (r["status_code"], r["error_detail"] is not None) for r in reports.report_status(tx, done).collect()}
    assert found == {0: (404, False), 1: (202, False), 2: (200, True), 3: (200, False)}


def test_append_and_sample(spark, table, tmp_path):
    path = f"{tmp_path}/t"
    append(table, path)
    append(table.limit(1), path)
    assert spark.read.parquet(path).count() == 41
    append_by_day(table, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").filter("day = '2024-01-10'").count() == 40
    sample = f"{tmp_path}/s"
    for values in ([1.0, 2.0], [3.0]):
        replace_reference_sample(spark.createDataFrame([(v,) for v in values], "x double"), sample, "x")
    assert rows(read_reference_sample(spark, sample)) == [(3.0,)]


def test_latest_row_counts(spark):
    schema = "transaction_id long, created_at timestamp_ntz, ensemble_score double, classification string"
    day = [datetime(2031, 5, i) for i in range(1, 4)]
    scores = spark.createDataFrame([(1, day[0], 90.0, "fraud"), (1, day[2], 10.0, "legitimate"), (2, day[1], 80.0, "fraud"), (2, None, 1.0, "review")], schema)
    known = spark.createDataFrame([(1,), (2,), (3,)], "transaction_id long")
    found = dashboard.transactions_with_score(known, scores).orderBy("transaction_id").collect()
    assert [tuple(r) for r in found] == [(1, 10.0, "legitimate"), (2, 80.0, "fraud"), (3, None, None)]
    assert [r["transaction_id"] for r in reports.report_queue(scores, known.limit(0)).collect()] == [2]
