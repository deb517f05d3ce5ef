"""Every registered query against its SQL, and the shape of the plans."""

import pytest

from __spark_entry__ import entry
from catalogue.oracle import ORACLE
from catalogue.queries import QUERIES
from check import compare, connect
from pyspark.sql import functions as F

PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow")
WITHOUT_SQL = {"forest_scores", "forest_evaluation"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, folder, name):
    agrees, text = compare(spark, connection, folder, name)
    assert agrees, text


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 1000 and "classification" in df.columns


@pytest.mark.parametrize("name", ["scored_transactions", "features", "feature_drift", "audit_chains", "prompts", "dashboard_kpis", "history_prior"])
def test_plans_stay_in_the_jvm(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert not any(node in text for node in PYTHON_NODES)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_one_wide_shuffle_by_user(spark, folder):
    """With joins by sort-merge the scored rows are shuffled by user once, for windows and user context alike."""
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from catalogue import tables as t
        from riskloom.plans.scoring import score_transactions
        from riskloom.session import settle

        stored = settle(t.transactions(spark, folder))
        context = t.context(spark, folder, with_history=True)
        text = plan(score_transactions(stored, type(context)(None, context.known_cards, context.home_country, context.history)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    # One for the transactions; per-user tables are grouped by user and only move their own rows.
    wide = [line for line in moved if "hashpartitioning(user_id" in line and "card_last4" in line]
    assert len([line for line in text.splitlines() if "Window" in line]) == 1
    assert len(wide) <= 1, text


def test_scans_are_pruned_and_filtered(spark, folder):
    text = plan(QUERIES["tx_per_day"](spark, folder))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text
    text = plan(QUERIES["known_cards"](spark, folder))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in text and "value" not in text.split("ReadSchema")[1]


def test_results_do_not_depend_on_partitioning(spark, folder):
    from catalogue import tables as t
    from riskloom.plans.scoring import score_transactions

    context, df = t.context(spark, folder, with_history=True), t.transactions(spark, folder)
    results = []
    for parts in (1, 5, 13):
        scored = score_transactions(df.repartition(parts), context, weights=t.RULE_ONLY)
        results.append(scored.agg(F.sum(F.xxhash64("transaction_id", "ensemble_score", "classification", "fired_rules").cast("decimal(38,0)"))).first()[0])
    assert len(set(results)) == 1
