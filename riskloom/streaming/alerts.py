"""The alert state machine on a stream of analyst actions that need not come in order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from riskloom.operators.alerts import illegal_actions
from riskloom.schemas import ALERT_OPEN, STATUS_OF_ACTION
from riskloom.sources.tables import store_batch
from riskloom.streaming.clock import GROUPS, event_time, group_of, instant_of, next_timer, passed, put_back, state_on_disk


class AlertMachine(StatefulProcessor):
    """State of a group of alerts: the status of each, and the actions that wait until the watermark has passed them.

    Many alerts share a list of waiting actions and its timers, since each call to the store costs more than an action. A timer
    takes all that are due, for each alert in order of time and id; the status before each is that after the one before it.
    """

    def __init__(self, fields: StructType):
        self.fields, self.columns = fields, fields.names
        self.row = Row(*self.columns, "previous_status", "new_status")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getMapState("status", StructType([self.fields["alert_id"]]), "status string")
        self.waiting = handle.getListState("waiting", self.fields)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh = [tuple(row) for row in rows if row["__known"] and row["__at"] is not None]
        if fresh:
            at = self.columns.index("__at")
            self.waiting.appendList(fresh)
            self.handle.registerTimer(next_timer(values[at] for values in fresh))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        upto = passed(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo)
        alert, at, action, name, initial = (self.columns.index(c) for c in ("alert_id", "__at", "action", "action_id", "__initial"))
        waiting = {(values[alert], values[at], str(values[name])): values for values in map(tuple, self.waiting.get())}
        due = sorted(place for place in waiting if place[1] <= upto)
        if due:
            later = [values for place, values in waiting.items() if place[1] > upto]
            put_back(self.handle, self.waiting, later, (values[at] for values in later))
        for subject, places in itertools.groupby(due, key=lambda place: place[0]):
            known = self.status.getValue((subject,))
            before = known[0] if known else None
            for place in places:
                values = waiting[place]
                before = before or values[initial] or ALERT_OPEN
                after = STATUS_OF_ACTION.get(values[action])
                yield self.row(*values, before, after)
                before = after or before
            self.status.updateValue((subject,), (before,))


def alert_transitions(actions: DataFrame, alerts: DataFrame, *, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """Every action of a stream with its alert's transaction and the status before and after, as ``operators.alerts.action_transitions``.

    Actions are taken in order of ``acted_at``, then id, as soon as the watermark, ``late`` behind the latest, has passed
    them; later ones Spark drops. Rows without ``alert_id`` only move the clock, for times when nobody acts.
    State is kept by ``groups`` groups of alerts.
    """
    state_on_disk(actions.sparkSession)
    timed, back = event_time(actions, "acted_at")
    timed = timed.withWatermark("acted_at", late).withColumn("__at", instant_of(F.col("acted_at"), timed.schema["acted_at"].dataType))
    subject = alerts.select("alert_id", "transaction_id", F.col("status").alias("__initial"), F.lit(True).alias("__known"))
    # A left join: an inner one would take the rows that only move the clock away before the watermark sees them.
    known = timed.join(subject, "alert_id", "left").select(*actions.columns, "transaction_id", "__initial", "__known", "__at", group_of("alert_id", groups).alias("__group"))
    status = [StructField("previous_status", StringType()), StructField("new_status", StringType())]
    out = StructType([*known.schema.fields, *status])
    moved = known.groupBy("__group").transformWithState(AlertMachine(known.schema), out, "append", "EventTime")
    return moved.select(*actions.columns, "transaction_id", "previous_status", "new_status").withColumn("acted_at", back(F.col("acted_at")))


def alert_sink(transitions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """All transitions below ``path``/transitions, and those that break a rule, with their problems, below ``path``/illegal."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            store_batch(batch, f"{path}/transitions", f"stream-{batch_id}", "acted_at")
            store_batch(illegal_actions(batch), f"{path}/illegal", f"stream-{batch_id}", "acted_at")
        finally:
            batch.unpersist()

    return transitions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def current_alerts(alerts: DataFrame, transitions: DataFrame) -> DataFrame:
    """Alerts with the status, reviewer and time of their last transition."""
    last = transitions.groupBy("alert_id").agg(
        F.max_by(F.struct("new_status", "analyst_id", "acted_at"), F.struct("acted_at", "action_id")).alias("last")
    )
    joined = alerts.join(last, "alert_id", "left")
    return joined.select(
        *[F.col(c) for c in alerts.columns if c not in ("status", "reviewed_by", "reviewed_at")],
        F.coalesce("last.new_status", "status").alias("status"),
        F.coalesce("last.analyst_id", "reviewed_by").alias("reviewed_by"),
        F.coalesce("last.acted_at", "reviewed_at").alias("reviewed_at"),
    )
