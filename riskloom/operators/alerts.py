"""Alert state as a fold over append-only analyst actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.skew import HOT_LIMIT, ordered_scan
from riskloom.schemas import ALERT_OPEN, ALLOWED_FROM, STATUS_OF_ACTION

ACTION_ORDER = ["acted_at", "action_id"]


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]


def fold_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Current alerts: the last action sets status, reviewer and time.

    The last action is a partial aggregate, so an alert with very many actions costs no more.
    """
    last = actions.groupBy("alert_id").agg(
        F.max_by(F.struct("action", "analyst_id", "acted_at"), F.struct(*ACTION_ORDER)).alias("last")
    )
    joined = alerts.join(last, "alert_id", "left")
    status = F.coalesce(_lookup(STATUS_OF_ACTION, F.col("last.action")), F.col("status"))
    return joined.select(
        *[F.col(c) for c in alerts.columns if c not in ("status", "reviewed_by", "reviewed_at")],
        status.alias("status"),
        F.coalesce("last.analyst_id", "reviewed_by").alias("reviewed_by"),
        F.coalesce("last.acted_at", "reviewed_at").alias("reviewed_at"),
    )


def action_transitions(alerts: DataFrame, actions: DataFrame, hot_limit: int = HOT_LIMIT) -> DataFrame:
    """Every action with its alert's transaction and the status before and after."""
    walked = ordered_scan(actions, ["alert_id"], ACTION_ORDER, previous={"__before": "action"}, hot_limit=hot_limit)
    subject = alerts.select("alert_id", "transaction_id", F.col("status").alias("__initial"))
    return walked.join(subject, "alert_id").select(
        *actions.columns,
        "transaction_id",
        F.coalesce(_lookup(STATUS_OF_ACTION, F.col("__before")), F.col("__initial"), F.lit(ALERT_OPEN)).alias(
            "previous_status"
        ),
        _lookup(STATUS_OF_ACTION, F.col("action")).alias("new_status"),
    )


def illegal_actions(transitions: DataFrame) -> DataFrame:
    """Strict reading: actions from a wrong status, or a false-positive mark without a reason."""
    wrong = F.col("previous_status") != _lookup(ALLOWED_FROM, F.col("action"))
    no_reason = (F.col("action") == "false_positive") & (F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0)
    problems = F.array_compact(F.array(F.when(wrong, "illegal_transition"), F.when(no_reason, "missing_reason")))
    return transitions.withColumn("problems", problems).filter(F.size("problems") > 0)
