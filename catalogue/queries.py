"""One query per operator; every query reads the driver tables as a whole."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import tables as t
from riskloom.functions.ensemble import (
    class_from_status,
    classify,
    combine,
    ml_score,
    risk_band,
    status_from_class,
    threshold,
    tier_label,
)
from riskloom.functions.features import feature_names, feature_vector
from riskloom.functions.numbers import fixed_text, round_exact
from riskloom.functions.rules import fired_rules, rule_score
from riskloom.operators import alerts as alert_ops
from riskloom.operators import audit, dashboard, drift, forest, history, metrics, reports, tables
from riskloom.operators.context import mark_blacklisted
from riskloom.plans import monitoring, training, upkeep
from riskloom.plans.scoring import alerts_from_scores, flags_of, score_transactions, scores_of, store_scoring, weights_from_table
from riskloom.schemas import FEATURE_NAMES
from riskloom.session import new_folder, settle
from riskloom.sources import events as source
from riskloom.sources import synthetic
from riskloom.sources import tables as io
from riskloom.streaming import alerts as alert_streams
from riskloom.streaming import jobs
from riskloom.streaming import reports as report_streams
from riskloom.streaming.velocity import keyed_velocity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2024-01-30 12:00:00"
FEATURES = [f"f_{name}" for name in FEATURE_NAMES]


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _joined(names):
    return F.array_join(names, ",")


def _flat(rows: DataFrame) -> DataFrame:
    """Score columns in plain types."""
    return rows.select(
        "transaction_id",
        "rule_score",
        "ml_score",
        "ensemble_score",
        "threshold",
        "classification",
        "status",
        _joined("fired_rules").alias("fired_rules"),
    )


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select(
        "action_type", "transaction_id", "user_id", "previous_status", "new_status", "details", "sha256_checksum", "created_at"
    )


# --- Rules ------------------------------------------------------------------


@query
def rule_flags(spark, folder):
    rows = t.enriched(spark, folder)
    return rows.select("transaction_id", *[flag.alias(name) for name, flag in flags_of(t.BURST).items()])


@query
def rule_scores(spark, folder):
    flags = flags_of(t.BURST)
    rows = t.enriched(spark, folder)
    return rows.select("transaction_id", rule_score(flags).alias("rule_score"), _joined(fired_rules(flags)).alias("fired_rules"))


@query
def rule_hit_counts(spark, folder):
    rows = t.enriched(spark, folder).select(F.explode(fired_rules(flags_of(t.BURST))).alias("rule"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n_hits"))


@query
def rules_weighted_table(spark, folder):
    metadata = spark.createDataFrame(
        [
            ("high_amount", 40.0, True),
            ("high_velocity", 25.0, False),
            ("unusual_merchant", 35.0, True),
            ("unusual_hours", 5.0, True),
            ("country_mismatch", 45.0, True),
        ],
        "name string, weight double, is_active boolean",
    )
    weights = weights_from_table(metadata)
    flags = flags_of(t.BURST)
    return t.enriched(spark, folder).select(
        "transaction_id",
        rule_score(flags, weights).alias("rule_score"),
        _joined(fired_rules(flags, weights)).alias("fired_rules"),
    )


@query
def blacklisted_merchants(spark, folder):
    rows = mark_blacklisted(t.transactions(spark, folder), source.blacklist(spark, folder))
    return rows.groupBy("merchant_name", "merchant_listed").agg(F.count(F.lit(1)).alias("n_transactions"))


# --- History and velocity ---------------------------------------------------


def _base(spark, folder):
    return source.from_events(source.scan(spark, folder, "events"))


@query
def velocity_5m(spark, folder):
    rows = history.velocity(_base(spark, folder), {"n": 300})
    return rows.select("transaction_id", "n")


@query
def velocity_1h(spark, folder):
    rows = history.velocity(_base(spark, folder), {"n": 3600})
    return rows.select("transaction_id", "n")


@query
def velocity_12h_burst(spark, folder):
    rows = history.velocity(_base(spark, folder), {"n": 12 * 3600})
    return rows.filter(F.col("n") > 3).select("transaction_id", "user_id", "n")


@query
def velocity_hot_users(spark, folder):
    """The running-sum way, taken here by every user with more than 50 rows."""
    rows = history.velocity(_base(spark, folder), {"n_1h": 3600, "n_12h": 12 * 3600}, hot_limit=50)
    return rows.select("transaction_id", "n_1h", "n_12h")


@query
def known_cards(spark, folder):
    return source.cards_before(_base(spark, folder))


@query
def home_country(spark, folder):
    return source.home_countries(spark, folder)


def _rounded_history(rows, *keys):
    return rows.select(*keys, F.round("avg_amount", 6).alias("avg_amount"), F.round("std_amount", 6).alias("std_amount"))


@query
def user_history(spark, folder):
    rows = history.user_history(_base(spark, folder))
    return _rounded_history(rows, "user_id", "n_transactions")


@query
def attached_history(spark, folder):
    rows = _base(spark, folder)
    early = rows.filter(F.col("ts") < t.split_day())
    return _rounded_history(history.attach_history(rows, history.user_history(early)), "transaction_id")


@query
def history_prior(spark, folder):
    rows = history.point_in_time_history(_base(spark, folder))
    return rows.select(
        "transaction_id",
        "prior_count",
        F.round("prior_avg_amount", 6).alias("prior_avg_amount"),
        F.round("prior_std_amount", 6).alias("prior_std_amount"),
    )


# --- Features ---------------------------------------------------------------


@query
def features(spark, folder):
    rows = t.features(spark, folder)
    return rows.select("transaction_id", *[F.round(name, 6).alias(name) for name in FEATURES])


@query
def feature_vectors(spark, folder):
    rows = t.features(spark, folder)
    texts = F.transform(feature_vector("f_"), lambda x: fixed_text(F.round(x, 6), 3))
    return rows.select("transaction_id", _joined(texts).alias("vector"))


@query
def named_features(spark, folder):
    """Each feature's name and place in the vector, the rows where it is not 0, and its greatest value."""
    names = feature_names()
    rows = t.features(spark, folder).select(*[F.col(f"f_{name}").alias(name) for name in names])
    counts = rows.agg(*[F.struct(F.count_if(F.col(name) != 0).alias("n"), F.max(name).alias("top")).alias(name) for name in names])
    each = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("feature"), f"{name}.n", F.round(f"{name}.top", 4).alias("top")) for i, name in enumerate(names)]
    return counts.select(F.inline(F.array(*each)))


# --- Ensemble and scoring ---------------------------------------------------


@query
def threshold_tiers(spark, folder):
    orders = source.scan(spark, folder, "orders")
    price = F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        threshold(price).alias("threshold"),
        threshold(price, contiguous=True).alias("threshold_contiguous"),
        F.coalesce(tier_label(price), F.lit("none")).alias("tier"),
    )


@query
def ensemble_grid(spark, folder):
    """Weighted sums of several weight sets over order prices and account balances as layer scores."""
    orders = source.scan(spark, folder, "orders")
    rule = F.floor(F.col("o_totalprice")) % 101
    ml = F.col("o_orderkey") % 101
    place = F.col("o_custkey") % 101
    return orders.select(
        "o_orderkey",
        combine(rule, ml).alias("standard"),
        combine(rule, ml, weights={"rule": 0.4, "ml": 0.6}).alias("two_layers"),
        combine(rule, ml, place, {"rule": 0.4, "ml": 0.4, "context": 0.2}).alias("three_layers"),
        combine(rule, ml, weights={"rule": 0.6, "ml": 0.6}).alias("capped"),
        combine(rule, ml, weights={"rule": -0.5, "ml": 0.25}).alias("floored"),
        classify(combine(rule, ml, weights={"rule": 0.5, "ml": 0.5}), F.lit(50.0)).alias("classification"),
    )


@query
def scored_transactions(spark, folder):
    return _flat(t.scored(spark, folder))


@query
def scored_transactions_default(spark, folder):
    return _flat(t.scored(spark, folder, weights=None, recent="tx_count_last_5min"))


@query
def scored_transactions_contiguous(spark, folder):
    return _flat(t.scored(spark, folder, contiguous=True))


@query
def alerts(spark, folder):
    return t.alerts(spark, folder).select("alert_id", "transaction_id", "status", "score", "threshold", "classification", "created_at")


@query
def status_rollup(spark, folder):
    rows = t.scored(spark, folder).groupBy("status", "classification").agg(F.count(F.lit(1)).alias("n_transactions"))
    return rows.withColumn("expected_status", status_from_class(F.col("classification")))


@query
def class_by_tier(spark, folder):
    rows = t.scored(spark, folder).withColumn("tier", F.coalesce(tier_label(F.col("amount")), F.lit("none")))
    return rows.groupBy("tier", "classification").agg(F.count(F.lit(1)).alias("n_transactions"))


@query
def status_and_band(spark, folder):
    rows = t.scored(spark, folder)
    return rows.select(
        "transaction_id",
        class_from_status(F.col("status")).alias("classification"),
        risk_band(F.col("ensemble_score")).alias("band"),
    )


# --- Tables, lists ----------------------------------------------------------


@query
def table_scan(spark, folder):
    customers = source.scan(spark, folder, "customer")
    return customers.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_users"))


def _with_faults(spark, folder):
    key = F.col("transaction_id")
    rows = t.transactions(spark, folder)
    return rows.withColumns(
        {
            "amount": F.when(key % 11 == 0, F.lit(0).cast("decimal(12,2)")).otherwise(F.col("amount")),
            "currency": F.when(key % 13 == 0, "US").otherwise(F.col("currency")),
            "merchant_name": F.when(key % 17 == 0, "").otherwise(F.col("merchant_name")),
            "card_last4": F.when(key % 19 == 0, "123").otherwise(F.col("card_last4")),
            "merchant_category": F.when(key % 23 == 0, F.repeat(F.lit("x"), 101)).otherwise(F.col("merchant_category")),
        }
    )


@query
def valid_rejects(spark, folder):
    _, rejects = tables.validate(_with_faults(spark, folder))
    return rejects.select("transaction_id", _joined("reasons").alias("reasons"))


@query
def valid_rows(spark, folder):
    valid, _ = tables.validate(_with_faults(spark, folder))
    return valid.select("transaction_id", F.col("amount").cast("double").alias("amount"))


@query
def live_transactions(spark, folder):
    return tables.live(t.stored_transactions(spark, folder)).select("transaction_id", "status")


@query
def soft_deletion(spark, folder):
    rows = t.stored_transactions(spark, folder)
    ids = rows.filter(F.col("classification") == "fraud").select("transaction_id")
    deleted = tables.soft_delete(rows, ids, "2024-02-02 00:00:00")
    return deleted.select("transaction_id", "deleted_at")


def _filtered(spark, folder):
    return tables.filter_transactions(
        t.stored_transactions(spark, folder), status="flagged", date_from="2024-01-05 00:00:00", date_to="2024-01-25 00:00:00"
    )


@query
def filtered_page(spark, folder):
    return tables.page(_filtered(spark, folder), 2, 20).select("transaction_id", "status", "created_at")


@query
def filtered_page_after(spark, folder):
    rows = tables.page_after(_filtered(spark, folder), "2024-01-20 00:00:00", 0, 50)
    return rows.select("transaction_id", "created_at")


@query
def filtered_total(spark, folder):
    return tables.total(_filtered(spark, folder))


@query
def user_transactions(spark, folder):
    rows = tables.filter_transactions(t.stored_transactions(spark, folder), user_id=7)
    return rows.select("transaction_id", "user_id", "status")


@query
def point_lookup(spark, folder):
    rows = tables.get_by_id(t.stored_transactions(spark, folder), 27)
    return rows.select("transaction_id", "status", "deleted_at")


@query
def alert_page(spark, folder):
    rows = tables.filter_alerts(t.alerts(spark, folder), status="open", date_from="2024-01-03 00:00:00", date_to="2024-01-28 00:00:00")
    return tables.page(rows, 1, 100, row_id="alert_id").select("alert_id", "score", "created_at")


@query
def sorted_transactions(spark, folder):
    rows = t.scored(spark, folder).withColumn("risk_score", F.when(F.col("transaction_id") % 9 != 0, F.col("ensemble_score")))
    return tables.sort_transactions(rows, "risk_score", "desc").select("transaction_id", "risk_score")


@query
def transaction_list(spark, folder):
    return tables.transaction_response(t.scored(spark, folder))


@query
def alert_list(spark, folder):
    return tables.alert_response(t.alerts(spark, folder)).drop("reviewed_by", "reviewed_at")


# --- Alerts -----------------------------------------------------------------


@query
def alert_fold(spark, folder):
    table = settle(t.alerts(spark, folder))
    folded = alert_ops.fold_actions(table, t.actions(table))
    return folded.select("alert_id", "status", "reviewed_by", "reviewed_at")


@query
def alert_transitions(spark, folder):
    return t.transitions(spark, folder).select("action_id", "transaction_id", "action", "previous_status", "new_status")


@query
def alert_illegal(spark, folder):
    rows = alert_ops.illegal_actions(t.transitions(spark, folder))
    return rows.select("action_id", _joined("problems").alias("problems"))


# --- Dashboard --------------------------------------------------------------


@query
def dashboard_kpis(spark, folder):
    needed = ("transaction_id", "ts", "is_fraud", "status", "deleted_at", "ensemble_score", "threshold", "classification", "created_at")
    rows = settle(t.stored_transactions(spark, folder).select(*needed))
    return dashboard.dashboard_kpis(rows, rows, alerts_from_scores(rows), t.model_runs_of(rows))


@query
def score_histogram(spark, folder):
    rows = t.scored(spark, folder, weights=None)
    return dashboard.score_histogram(rows)


@query
def score_histogram_contiguous(spark, folder):
    rows = t.scored(spark, folder, weights=None)
    return dashboard.score_histogram(rows, contiguous=True)


@query
def score_trend(spark, folder):
    return dashboard.score_trend(t.scored(spark, folder), NOW)


@query
def tx_per_day(spark, folder):
    rows = dashboard.transactions_per_day(_base(spark, folder), "ts")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_transactions")


@query
def alerts_per_rule(spark, folder):
    return dashboard.alerts_per_rule(t.scored(spark, folder))


@query
def fraud_by_country(spark, folder):
    return dashboard.fraud_by_country(t.scored(spark, folder))


@query
def transactions_with_score(spark, folder):
    scores = scores_of(t.scored(spark, folder)).filter(F.col("transaction_id") % 9 != 0)
    rows = dashboard.transactions_with_score(_base(spark, folder), scores)
    return rows.select("transaction_id", F.col("amount").cast("double").alias("amount"), "ensemble_score", "classification")


@query
def transaction_detail(spark, folder):
    rows = settle(t.scored(spark, folder))
    scores = rows.select("transaction_id", "rule_score", "ensemble_score", "classification")
    detail = dashboard.transaction_detail(_base(spark, folder), scores, t.reports_of(rows), settle(t.trail_of(rows)))
    return detail.select(
        "transaction_id", "rule_score", "ensemble_score", "classification", "report_status", "entry_action", "entry_at", "entry_checksum"
    )


# --- Audit ------------------------------------------------------------------


@query
def audit_scoring(spark, folder):
    return _entries(audit.audit_scoring(t.scored(spark, folder)))


@query
def audit_actions(spark, folder):
    return _entries(audit.audit_actions(t.transitions(spark, folder)))


@query
def audit_reports(spark, folder):
    return _entries(audit.audit_reports(t.reports(spark, folder).filter(F.col("status") != "pending")))


@query
def audit_trail(spark, folder):
    """The trail of the transaction that most entries belong to is found by its id."""
    return _entries(audit.trail_for_transaction(t.trail(spark, folder), 103))


@query
def audit_chains(spark, folder):
    rows = audit.chains(settle(t.trail(spark, folder)))
    return rows.select("transaction_id", "step", "action_type", "sha256_checksum")


@query
def audit_by_analyst(spark, folder):
    return _entries(audit.trail_for_analyst(t.trail(spark, folder), "analyst-3"))


@query
def audit_verify(spark, folder):
    entries = audit.audit_scoring(t.scored(spark, folder))
    hit = F.col("transaction_id").cast("long") % 10 == 3
    altered = F.when(hit, F.regexp_replace("details", '"ml_score": 0.0', '"ml_score": 9.0')).otherwise(F.col("details"))
    return audit.verify(entries.withColumn("details", altered)).select("transaction_id", "details")


def _export(spark, folder, fmt):
    path = new_folder(spark, "audit-export")
    io.export_audit(t.trail(spark, folder), path, "2024-01-10 00:00:00", "2024-01-20 00:00:00", fmt)
    return _entries(io.read_audit_export(spark, path, fmt))


@query
def audit_export(spark, folder):
    """An inclusive range written as CSV and read back."""
    return _export(spark, folder, "csv")


@query
def audit_export_json(spark, folder):
    """The same as JSON."""
    return _export(spark, folder, "json")


# --- Metrics ----------------------------------------------------------------


def _label_pairs(spark, folder):
    labels = source.scan(spark, folder, "labels")
    return labels.select(F.col("quality").alias("predicted"), (1 - F.col("toxic")).alias("actual"))


@query
def confusion(spark, folder):
    return metrics.confusion(_label_pairs(spark, folder))


@query
def binary_metrics(spark, folder):
    return metrics.binary_metrics(metrics.confusion(_label_pairs(spark, folder)))


@query
def undefined_metrics(spark, folder):
    """Metrics where ratios are undefined: of no rows, of rows that are never called positive, of rows of one class."""
    pairs = _label_pairs(spark, folder)
    none = metrics.binary_metrics(metrics.confusion(pairs.where("predicted > 1"))).withColumn("part", F.lit("none"))
    missed = metrics.binary_metrics(metrics.confusion(pairs.withColumn("predicted", F.lit(0)))).withColumn("part", F.lit("never called"))
    only = metrics.binary_metrics(metrics.confusion(pairs.where("actual = 0"))).withColumn("part", F.lit("one class"))
    return none.unionByName(missed).unionByName(only)


@query
def daily_metrics(spark, folder):
    rows = t.daily_metrics(spark, folder)
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _score_pairs(spark, folder):
    return t.scored(spark, folder).select(F.col("rule_score").alias("score"), F.col("is_fraud").alias("actual"))


@query
def curve_areas(spark, folder):
    areas = metrics.curve_areas(metrics.score_curve(_score_pairs(spark, folder)))
    return areas.select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query
def curve_areas_continuous(spark, folder):
    """Many distinct scores: the amounts themselves."""
    rows = _base(spark, folder).select(F.col("amount").cast("double").alias("score"), F.col("is_fraud").alias("actual"))
    areas = metrics.curve_areas(metrics.score_curve(rows))
    return areas.select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query
def score_curve(spark, folder):
    return metrics.score_curve(_score_pairs(spark, folder))


# --- Drift ------------------------------------------------------------------


def _halves(spark, folder):
    rows = _base(spark, folder).select("ts", F.col("amount").cast("double").alias("value"))
    return rows.filter(F.col("ts") < t.split_day()), rows.filter(F.col("ts") >= t.split_day())


@query
def psi_value(spark, folder):
    long = drift.samples(*_halves(spark, folder), ["value"])
    return drift.feature_psi(long).select("n_reference", "n_current", F.round("psi", 9).alias("psi"))


@query
def psi_histogram(spark, folder):
    long = drift.samples(*_halves(spark, folder), ["value"])
    return drift.histogram(long, drift.sample_stats(long)).select("bin", "in_reference", "in_current")


@query
def psi_edges(spark, folder):
    long = drift.samples(*_halves(spark, folder), ["value"])
    edges = drift.sample_stats(long).select(F.posexplode(drift.bin_edges(F.col("lo"), F.col("hi"))).alias("i", "edge"))
    return edges.select("i", F.round("edge", 6).alias("edge"))


@query
def drift_report(spark, folder):
    return drift.drift_report(*_halves(spark, folder)).withColumn("psi", F.round("psi", 9))


def _feature_drift(spark, folder):
    return drift.split_drift(t.features(spark, folder), F.col("ts") < t.split_day(), FEATURES, threshold=0.005)


@query
def feature_drift(spark, folder):
    return _feature_drift(spark, folder)


@query
def drift_recent(spark, folder):
    rows = t.scored(spark, folder, weights=None)
    return drift.drift_of(drift.split_recent(rows)).withColumn("psi", F.round("psi", 6))


@query
def drift_recent_reference(spark, folder):
    """Against a stored reference sample: the scores of the first half of the month."""
    rows = settle(scores_of(t.scored(spark, folder, weights=None)))
    path = new_folder(spark, "reference-sample")
    io.replace_reference_sample(rows.filter(F.col("created_at") < t.split_day()), path, "ensemble_score")
    found = drift.drift_of(drift.split_recent(rows, io.read_reference_sample(spark, path)))
    return found.withColumn("psi", F.round("psi", 6))


@query
def retraining(spark, folder):
    rows = t.daily_metrics(spark, folder)
    return rows.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        "f1",
        drift.needs_retraining(F.col("f1"), F.col("fp") * 1.0).alias("retrain"),
    )


@query
def retraining_recommendation(spark, folder):
    found = _feature_drift(spark, folder)
    return drift.retraining_recommendation(found, binary_metrics(spark, folder))


@query
def model_runs(spark, folder):
    return drift.list_runs(t.model_runs(spark, folder))


@query
def latest_model_run(spark, folder):
    return drift.latest_status(t.model_runs(spark, folder))


# --- Report queue -----------------------------------------------------------


def _queue(spark, folder):
    rows = settle(t.scored(spark, folder))
    return reports.report_queue(rows, t.reports_of(rows))


@query
def report_queue(spark, folder):
    """Queued rows as JSON messages, parsed back."""
    lines = _queue(spark, folder).select(reports.request_message().alias("value"))
    requests, _ = reports.parse_requests(lines)
    return requests.select(
        F.col("transaction_id").cast("long").alias("transaction_id"),
        F.col("score_breakdown.ensemble_score").alias("ensemble_score"),
        _joined("score_breakdown.fired_rules").alias("fired_rules"),
        F.col("transaction.amount").alias("amount"),
        F.col("transaction.merchant_name").alias("merchant_name"),
        "retry_count",
    )


def _lines(spark, folder):
    """Report requests as text, every tenth one cut off."""
    key = F.col("event_id")
    whole = F.format_string('{"transaction_id": "%d", "retry_count": %d}', key, key % 4)
    bare = F.format_string('{"score_breakdown": {"rule_score": %d.5}}', key % 100)
    text = F.when(key % 10 == 3, F.format_string('{"transaction_id": "%d", "retry', key)).when(key % 10 == 4, bare).otherwise(whole)
    return source.scan(spark, folder, "events").select("event_id", text.alias("value"))


@query
def report_requests(spark, folder):
    requests, _ = reports.parse_requests(_lines(spark, folder))
    return requests.select("event_id", "transaction_id", "retry_count", F.col("score_breakdown.rule_score").alias("rule_score"))


@query
def report_request_rejects(spark, folder):
    _, rejects = reports.parse_requests(_lines(spark, folder))
    return rejects


@query
def prompts(spark, folder):
    return reports.with_prompt(t.scored(spark, folder, weights=None)).select("transaction_id", "prompt")


@query
def report_outcome(spark, folder):
    answers = t.reports(spark, folder).filter(F.col("report_text").isNotNull())
    done = reports.finished_reports(answers, "local-model")
    return done.select("transaction_id", "status", "model_name", "retry_count")


@query
def retry_plan(spark, folder):
    rows = _base(spark, folder).select(
        "transaction_id", (F.col("transaction_id") % 5).cast("int").alias("retry_count"), F.col("ts").alias("failed_at")
    )
    return reports.retry_plan(rows)


@query
def abandoned_reports(spark, folder):
    rows = _base(spark, folder).select(
        "transaction_id",
        (F.col("transaction_id") % 5).cast("int").alias("retry_count"),
        F.concat(F.lit("timeout "), F.col("transaction_id") % 3).alias("error"),
        F.col("ts").alias("failed_at"),
    )
    done = reports.abandoned_reports(rows, "local-model")
    return done.select("transaction_id", "report_text", "status", "retry_count", "error", "created_at")


@query
def report_status(spark, folder):
    rows = settle(t.scored(spark, folder))
    return reports.report_status(rows, t.reports_of(rows)).select("transaction_id", "status_code", "error_detail")


# --- Model ------------------------------------------------------------------


@query
def ml_score_map(spark, folder):
    """Decision values from -1 to 1 mapped to scores; every seventh row has no model."""
    rows = _base(spark, folder)
    decision = F.when(F.col("transaction_id") % 7 != 0, F.col("amount").cast("double") / 10000 - 1)
    return rows.select("transaction_id", F.round(ml_score(decision), 6).alias("ml_score"))


@query
def contamination(spark, folder):
    return forest.contamination(_base(spark, folder))


def _trained(spark, folder, path=None):
    return training.train(_base(spark, folder), path=path)


@query
def forest_scores(spark, folder):
    """Trained, saved, loaded, and used inside the scoring job."""
    path = new_folder(spark, "forest")
    _trained(spark, folder, path)
    model = forest.load_forest(spark, path)
    rows = score_transactions(
        t.transactions(spark, folder), t.context(spark, folder, with_history=True), model=model, windows=t.WINDOWS, recent=t.BURST
    )
    return _flat(rows)


@query
def forest_evaluation(spark, folder):
    return _trained(spark, folder).metrics


def _numbers(spark, folder):
    """Two numbers a row, of which most values differ."""
    return settle(_base(spark, folder).select("transaction_id", F.col("amount").cast("double").alias("a"), F.hour("ts").cast("double").alias("h")))


@query
def forest_trees(spark, folder):
    """Per tree: rows drawn, leaves beyond splits, nodes below the height limit, splits whose sides do not add up, distinct rows."""
    rows = _numbers(spark, folder)
    model = forest.fit_forest(rows, [F.col("a"), F.col("h")])
    limit = F.ceil(F.log2(F.lit(float(model.psi))))
    nodes = model.nodes.select("tree", "node", "feature", "depth", "size")
    sides = nodes.where("node > 0").groupBy("tree", F.floor((F.col("node") - 1) / 2).cast("int").alias("node"))
    sides = sides.agg(F.sum("size").alias("below"), F.count(F.lit(1)).alias("n_sides"))
    joined = nodes.join(sides, ["tree", "node"], "left")
    leaf = F.col("feature") < 0
    broken = F.when(leaf, F.col("below").isNotNull()).otherwise((F.coalesce("n_sides", F.lit(0)) != 2) | (F.col("below") != F.col("size")))
    return joined.groupBy("tree").agg(
        F.sum(F.when(F.col("node") == 0, F.col("size"))).alias("n_drawn"),
        (F.count_if(leaf) - F.count_if(~leaf)).alias("extra_leaves"),
        F.count_if(F.col("depth") > limit).alias("n_deep"),
        F.count_if(broken).alias("n_broken"),
    )


@query
def forest_reloaded(spark, folder):
    """Rows scored by a forest, those whose score differs once it is saved and loaded, and those outside [-1, 0)."""
    rows, path = _numbers(spark, folder), new_folder(spark, "forest")
    columns = [F.col("a"), F.col("h")]
    model = forest.fit_forest(rows, columns, contamination=0.1)
    forest.save_forest(model, path)
    both = forest.load_forest(spark, path).add_decision(model.add_decision(rows, columns, "before"), columns, "after")
    score = F.col("after") + model.offset
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("before") != F.col("after")).alias("n_changed"),
        F.count_if((score < -1) | (score >= 0)).alias("n_outside"),
    )


@query
def decision_evaluation(spark, folder):
    """All measures of a model's decisions: an amount over 8000 is an anomaly, the more the larger."""
    rows = _base(spark, folder).select((8000 - F.col("amount").cast("double")).alias("decision"), F.col("is_fraud").alias("actual"))
    return metrics.evaluate_scores(rows)


# --- Kept up to date --------------------------------------------------------


def _thirds(rows):
    """The rows in three parts of whole days."""
    day = F.coalesce(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")), F.lit(0))
    return [rows.filter(F.pmod(day, F.lit(3)) == i) for i in range(3)]


@query
def user_history_kept(spark, folder):
    """The history from three batches' moments; the first batch comes a second time, after a wrong one of its name."""
    path = new_folder(spark, "history")
    first, *others = _thirds(_base(spark, folder))
    upkeep.update_history(first.withColumn("amount", F.col("amount") + 1), path, "0")
    for i, rows in enumerate([first, *others]):
        upkeep.update_history(rows, path, str(i))
    return _rounded_history(upkeep.kept_history(spark, path), "user_id", "n_transactions")


@query
def known_cards_kept(spark, folder):
    path = new_folder(spark, "cards")
    until = F.lit(source.KNOWN_CARDS_UNTIL).cast("timestamp_ntz")
    for i, rows in enumerate(_thirds(_base(spark, folder).filter(F.col("ts") < until))):
        upkeep.update_cards(rows, path, str(i))
    return upkeep.kept_cards(spark, path)


def _kept_days(spark, rows):
    """Measures of all days; one day is stored with wrong scores first and then again."""
    path, day = new_folder(spark, "days"), F.to_date("created_at") == F.lit("2024-01-16").cast("date")
    wrong = rows.withColumns(
        {"ensemble_score": F.when(day, F.lit(99.0)).otherwise(F.col("ensemble_score")), "classification": F.when(day, "fraud").otherwise(F.col("classification"))}
    )
    upkeep.update_days(upkeep.day_measures(rows, wrong, alerts_from_scores(wrong)), path)
    again = rows.filter(day)
    upkeep.update_days(upkeep.day_measures(again, again, alerts_from_scores(again)), path)
    return upkeep.kept_days(spark, path)


@query
def dashboard_kpis_kept(spark, folder):
    rows = settle(t.stored_transactions(spark, folder))
    return upkeep.kpis_of(_kept_days(spark, rows), t.model_runs_of(rows))


@query
def dashboard_lists_kept(spark, folder):
    """Rows per day and alerts per rule from the kept measures, one below the other."""
    days = settle(_kept_days(spark, settle(t.stored_transactions(spark, folder))))
    by_day = upkeep.per_day(days).select(F.date_format("day", "yyyy-MM-dd").alias("name"), F.col("n_transactions").alias("n"))
    return by_day.unionByName(upkeep.per_rule(days).select(F.col("rule").alias("name"), F.col("n_alerts").alias("n")))


@query
def score_histogram_kept(spark, folder):
    rows = settle(t.scored(spark, folder, weights=None).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz")))
    return upkeep.histogram_of(_kept_days(spark, rows))


@query
def point_lookup_by_bucket(spark, folder):
    """The point lookup from a table in buckets by transaction."""
    path = new_folder(spark, "by-transaction")
    table = io.store_by_key(t.stored_transactions(spark, folder), "lookup_" + path.rsplit("-", 1)[1], path, "transaction_id", buckets=16)
    return tables.get_by_id(table, 27).select("transaction_id", "status", "deleted_at")


@query
def tracked_runs(spark, folder):
    """A monitoring run of the whole table against its first half, tracked and listed: version, status and F1."""
    path = new_folder(spark, "runs")
    rows = _base(spark, folder)
    sample = rows.select(F.col("amount").cast("double").alias("amount"), "ts", F.col("is_fraud").alias("actual"), F.when(F.col("amount") > 10000, 1).otherwise(0).alias("predicted"))
    found = monitoring.monitor(sample.filter(F.col("ts") < t.split_day()), sample, ["amount"])
    for version, at in (("v1", "2024-01-30 00:00:00"), ("v2", "2024-01-31 00:00:00")):
        monitoring.track_run(found, path, version, datetime.fromisoformat(at))
    runs = drift.list_runs(spark.read.parquet(path))
    return runs.select("model_version", "status", round_exact(F.col("metrics")["f1"], 4).alias("f1"), "created_at")


# --- Files and streams ------------------------------------------------------


@query
def synthetic_transactions(spark, folder):
    """One synthetic labelled row per event number, of 250 users."""
    return synthetic.synthesize_for(source.scan(spark, folder, "events"), "event_id", users=250)


@query
def csv_round_trip(spark, folder):
    """Transactions written in the training-CSV shape and read back with their wall-clock times."""
    path = new_folder(spark, "csv")
    rows = t.transactions(spark, folder)
    io.write_csv(
        rows.select(
            F.col("transaction_id").cast("string").alias("transaction_id"),
            F.col("user_id").cast("string").alias("user_id"),
            "amount",
            "currency",
            "merchant_name",
            "merchant_category",
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:00")).alias("timestamp"),
            "is_fraud",
            F.hour("ts").alias("hour_of_day"),
            F.lit(0).alias("is_weekend"),
            F.lit(0).alias("is_crypto"),
            F.lit(0).alias("amount_round_number"),
            F.lit(1.5).alias("user_avg_amount"),
            F.lit(2.5).alias("user_std_amount"),
        ),
        path,
    )
    back = io.read_transactions_csv(spark, path)
    return back.select("transaction_id", "user_id", "amount", "merchant_name", "merchant_category", "ts", "is_fraud", "hour_of_day")


@query
def appended_tables(spark, folder):
    """Scores appended in two batches by day and read back."""
    path = new_folder(spark, "scores")
    rows = settle(scores_of(t.scored(spark, folder)))
    io.append_by_day(rows.filter(F.col("created_at") < t.split_day()), path)
    io.append_by_day(rows.filter(F.col("created_at") >= t.split_day()), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "classification").agg(F.count(F.lit(1)).alias("n_scores"))


def _event_stream(spark, folder):
    schema = source.scan(spark, folder, "events").schema
    return jobs.read_stream(spark, folder, schema, "events.parquet")


@query
def stream_scores(spark, folder):
    """Scores, alerts and audit entries written by a stream, joined back together."""
    stream = source.add_merchant_and_country(source.from_events(_event_stream(spark, folder)), spark, folder)
    scored = jobs.score_stream(stream.withColumn("created_at", F.col("ts")), t.context(spark, folder), weights=t.RULE_ONLY)
    path = new_folder(spark, "stream-scores")
    jobs.run_to_end(jobs.scoring_sink(scored, path, new_folder(spark, "stream-checkpoint")))
    scores = jobs.read_sink(spark, f"{path}/scores")
    opened = jobs.read_sink(spark, f"{path}/alerts").select("transaction_id", "alert_id")
    entries = jobs.read_sink(spark, f"{path}/audit").select(F.col("transaction_id").cast("long").alias("transaction_id"), "sha256_checksum")
    rows = scores.join(opened, "transaction_id", "left").join(entries, "transaction_id")
    return rows.select(
        "transaction_id", "ensemble_score", "classification", _joined("fired_rules").alias("fired_rules"), "alert_id", "sha256_checksum"
    )


def _in_thirds(rows, ts, folder):
    """Runs of a stream over ``rows``, by time: each third is added to ``folder`` and yields; rows without a time come first."""
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    bounds = [low + (high - low) * i / 3 for i in (1, 2)] if low else []
    third = sum((F.coalesce(F.col(ts) >= F.lit(b), F.lit(False)).cast("int") for b in bounds), F.lit(0))
    for i in range(3):
        rows.filter(third == i).write.mode("append").parquet(folder)
        yield jobs.read_stream(rows.sparkSession, folder, rows.schema, "*.parquet")


def _stream_folders(spark, name):
    return tuple(new_folder(spark, f"{kind}-{name}") for kind in ("input", "output", "checkpoint"))


@query
def stream_velocity(spark, folder):
    """Trailing counts by keyed state of a stream that gets the table in three runs."""
    parts, path, checkpoint = _stream_folders(spark, "velocity")
    rows = _base(spark, folder).select("transaction_id", "user_id", "ts")
    for stream in _in_thirds(rows, "ts", parts):
        counted = keyed_velocity(stream, {"n_1h": 3600, "n_12h": 12 * 3600})
        jobs.run_to_end(counted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint))
    return spark.read.parquet(path).select("transaction_id", "n_1h", "n_12h")


@query
def stream_velocity_by_batch(spark, folder):
    """The same counts from a sink whose table is the state."""
    parts, path, checkpoint = _stream_folders(spark, "velocity-sink")
    rows = _base(spark, folder).select("transaction_id", "user_id", "ts")
    for stream in _in_thirds(rows, "ts", parts):
        jobs.run_to_end(jobs.velocity_sink(stream, path, checkpoint, {"n_1h": 3600, "n_12h": 12 * 3600}))
    return jobs.read_sink(spark, path).select("transaction_id", "n_1h", "n_12h")


@query
def stream_scored_transactions(spark, folder):
    """Scores with all six rules from one stream, whose counts are keyed state, in three runs."""
    parts, path, checkpoint = _stream_folders(spark, "scoring")
    context = t.context(spark, folder).settled()
    for stream in _in_thirds(t.transactions(spark, folder), "ts", parts):
        scored = jobs.score_stream(stream, context, weights=t.RULE_ONLY, windows=t.WINDOWS, recent=t.BURST)
        jobs.run_to_end(scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint))
    return _flat(spark.read.parquet(path))


@query
def stored_twice(spark, folder):
    """Score tables of one batch stored twice and of a stream, read by one reader: days, classes and rows."""
    path = new_folder(spark, "store")
    rows = settle(t.scored(spark, folder))
    early, late = rows.filter(F.col("created_at") < t.split_day()), rows.filter(F.col("created_at") >= t.split_day())
    for _ in range(2):
        store_scoring(early, path)
    late = settle(late)
    for _ in range(2):  # a stream that has lost its checkpoint repeats its batches
        stream = jobs.read_stream(spark, late.inputFiles()[0].rsplit("/", 1)[0], late.schema, "*.parquet")
        jobs.run_to_end(jobs.scoring_sink(stream, path, new_folder(spark, "checkpoint")))
    back = io.read_store(spark, f"{path}/scores")
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "classification").agg(F.count(F.lit(1)).alias("n_scores"))


@query
def stream_report_queue(spark, folder):
    """Requests of a scored stream that comes twice, the second time from a new checkpoint."""
    rows = settle(t.scored(spark, folder))
    path, known = new_folder(spark, "requests"), settle(t.reports_of(rows))
    for _ in range(2):
        stream = jobs.read_stream(spark, rows.inputFiles()[0].rsplit("/", 1)[0], rows.schema, "*.parquet")
        jobs.run_to_end(report_streams.enqueue_sink(stream, path, new_folder(spark, "checkpoint"), lambda: known))
    asked = io.read_store(spark, path, "transaction_id long, ensemble_score double, fired_rules array<string>, amount decimal(12,2), merchant_name string, retry_count int")
    amount = F.col("amount").cast("double").alias("amount")
    return asked.select("transaction_id", "ensemble_score", _joined("fired_rules").alias("fired_rules"), amount, "merchant_name", "retry_count")


def _streamed_requests(spark, folder):
    """The folder of requests and rejects of a stream of messages that comes twice."""
    parts, path, _ = _stream_folders(spark, "messages")
    lines = _lines(spark, folder)
    lines.write.parquet(parts)
    for _ in range(2):
        stream = jobs.read_stream(spark, parts, lines.schema, "*.parquet")
        jobs.run_to_end(report_streams.request_sink(stream, path, new_folder(spark, "checkpoint")))
    return path


@query
def stream_requests(spark, folder):
    requests = io.read_store(spark, f"{_streamed_requests(spark, folder)}/requests")
    return requests.select("event_id", "transaction_id", "retry_count", F.col("score_breakdown.rule_score").alias("rule_score"))


@query
def stream_request_rejects(spark, folder):
    return io.read_store(spark, f"{_streamed_requests(spark, folder)}/rejects").select("event_id", "value")


@query
def stream_retries(spark, folder):
    """What becomes of failed attempts, by timers of a replay's clock; a last row without id moves it past the last timer."""
    parts, path, checkpoint = _stream_folders(spark, "retries")
    attempts = _base(spark, folder).select(
        "transaction_id",
        (F.col("transaction_id") % 5).cast("int").alias("retry_count"),
        F.concat(F.lit("timeout "), F.col("transaction_id") % 3).alias("error"),
        F.col("ts").alias("failed_at"),
    )
    end = attempts.agg((F.max("failed_at") + F.expr("INTERVAL 1 HOUR")).alias("failed_at"))
    for rows in (attempts, end.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in attempts.schema.fields[:-1]], "failed_at")):
        rows.write.mode("append").parquet(parts)
        stream = jobs.read_stream(spark, parts, attempts.schema, "*.parquet")
        found = report_streams.retry_timers(stream, event_clock=True)
        jobs.run_to_end(found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint))
    return spark.read.parquet(path)


def _streamed_actions(spark, folder):
    """(alerts, folder) of the state machine's tables over actions that come in any order, in three runs and a last row for the clock."""
    parts, path, checkpoint = _stream_folders(spark, "actions")
    table = settle(t.alerts(spark, folder))
    actions = settle(t.actions(table))
    end = actions.agg((F.max("acted_at") + F.expr("INTERVAL 90 DAY")).alias("acted_at"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in actions.schema.fields if f.name != "acted_at"]
    runs = [actions.filter(F.pmod(F.xxhash64("action_id"), F.lit(3)) == i) for i in range(3)] + [end.select(*nothing, "acted_at")]
    for rows in runs:
        rows.select(*actions.columns).write.mode("append").parquet(parts)
        stream = jobs.read_stream(spark, parts, actions.schema, "*.parquet")
        moved = alert_streams.alert_transitions(stream, table, late="60 days")
        jobs.run_to_end(alert_streams.alert_sink(moved, path, checkpoint))
    return table, path


_TRANSITIONS = "alert_id string, action_id string, action string, analyst_id string, acted_at timestamp_ntz, new_status string, problems array<string>"


@query
def stream_alert_fold(spark, folder):
    table, path = _streamed_actions(spark, folder)
    moved = io.read_store(spark, f"{path}/transitions", _TRANSITIONS)
    return alert_streams.current_alerts(table, moved).select("alert_id", "status", "reviewed_by", "reviewed_at")


@query
def stream_alert_illegal(spark, folder):
    _, path = _streamed_actions(spark, folder)
    return io.read_store(spark, f"{path}/illegal", _TRANSITIONS).select("action_id", _joined("problems").alias("problems"))


@query
def stream_kpis(spark, folder):
    """Daily windows: those the watermark has closed, and those still open at the end of the input."""

    def rated(events):
        return events.select(
            "ts",
            F.when(F.col("event_type") == "error", "fraud").otherwise("legitimate").alias("classification"),
            F.col("value").alias("ensemble_score"),
        )

    kpis = jobs.window_kpis(rated(_event_stream(spark, folder)), width="1 day", delay="1 hour")
    path = new_folder(spark, "stream-kpis")
    writer = kpis.writeStream.outputMode("append").format("parquet").option("path", path)
    jobs.run_to_end(writer.option("checkpointLocation", new_folder(spark, "stream-checkpoint")))
    back = jobs.with_open_windows(spark.read.parquet(path), rated(source.scan(spark, folder, "events")), width="1 day")
    return back.select("window_start", "window_end", "n_transactions", "n_fraud", round_exact(F.col("avg_score"), 4).alias("avg_score"))


@query
def stream_unique_requests(spark, folder):
    """Every request arrives twice and passes once."""
    stream = _event_stream(spark, folder).select(
        F.col("event_id").alias("transaction_id"), "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")
    )
    path = new_folder(spark, "stream-requests")
    unique = jobs.unique_requests(stream, delay="40 days").select("transaction_id")
    writer = unique.writeStream.outputMode("append").format("parquet").option("path", path)
    jobs.run_to_end(writer.option("checkpointLocation", new_folder(spark, "stream-checkpoint")))
    return spark.read.parquet(path)
