"""The report queue as streams: requests once each, malformed messages aside, retries by timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators.reports import parse_requests
from riskloom.schemas import BACKOFF_BASE, MAX_RETRIES
from riskloom.sources.tables import read_store, store_batch
from riskloom.streaming.clock import GROUPS, event_time, group_of, instant_of, next_timer, passed, put_back, state_on_disk

RETRIES = "transaction_id long, outcome string, retry_count int, at long, error string"


def enqueue_sink(
    scored: DataFrame, path: str, checkpoint: str, known: Callable[[], DataFrame], *, time: str = "created_at", late: str = "1 hour"
) -> DataStreamWriter:
    """One request per fraud transaction of a scored stream, below ``path``; a replayed stream adds none.

    Repeats within ``late`` meet in state; a batch then leaves out what has a report or request in ``known`` (read anew
    for each batch) or was requested by an earlier batch. The batch's own rows do not count, so it may be repeated.
    """
    timed, back = event_time(scored, time)
    fraud = timed.withWatermark(time, late).filter(F.col("classification") == "fraud").dropDuplicatesWithinWatermark(["transaction_id"])
    fraud = fraud.withColumn(time, back(F.col(time)))

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"stream-{batch_id}"
        fresh = batch.join(known().select("transaction_id"), "transaction_id", "left_anti")
        asked = read_store(batch.sparkSession, path)
        if asked is not None:
            fresh = fresh.join(asked.filter(F.col("batch_id") != name).select("transaction_id"), "transaction_id", "left_anti")
        store_batch(fresh.withColumn("retry_count", F.lit(0)), path, name, time)

    return fraud.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def request_sink(lines: DataFrame, path: str, checkpoint: str, text: str = "value") -> DataStreamWriter:
    """JSON messages of a stream, parsed below ``path``/requests, malformed ones as they are below ``path``/rejects."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            requests, rejects = parse_requests(batch, text)
            store_batch(requests, f"{path}/requests", f"stream-{batch_id}", None)
            store_batch(rejects, f"{path}/rejects", f"stream-{batch_id}", None)
        finally:
            batch.unpersist()

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


class Retries(StatefulProcessor):
    """State of a group of requests: the attempts that wait for their time, an attempt being a request, a due time and a number.

    Many requests share a state and its timers, since each call to the store costs more than an attempt.
    """

    def __init__(self, max_retries: int, base: int, event_clock: bool):
        self.max_retries, self.base, self.event_clock = max_retries, base, event_clock
        self.row = Row("transaction_id", "outcome", "retry_count", "at", "error")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "transaction_id long, at long, retry_count int, error string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh = []
        for row in rows:
            if row["transaction_id"] is None or row["__at"] is None:
                continue
            tried = row["retry_count"] or 0
            if tried >= self.max_retries:
                yield self.row(row["transaction_id"], "failed", tried, row["__at"], row["error"])
            else:
                fresh.append((row["transaction_id"], row["__at"] + 1_000_000 * self.base ** (tried + 1), tried + 1, row["error"]))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(next_timer(due for _, due, _, _ in fresh))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        clock = timerValues.getCurrentWatermarkInMs() if self.event_clock else timerValues.getCurrentProcessingTimeInMs()
        upto = passed(clock, expiredTimerInfo)
        waiting = {tuple(row[:3]): row[3] for row in self.waiting.get()}
        later = [(*place, error) for place, error in waiting.items() if place[1] > upto]
        if len(later) < len(waiting):
            put_back(self.handle, self.waiting, later, (place[1] for place in later))
        for (name, due, number), error in waiting.items():
            if due <= upto:
                yield self.row(name, "retry", number, due, error)


def retry_timers(
    attempts: DataFrame, *, max_retries: int = MAX_RETRIES, base: int = BACKOFF_BASE, late: str = "0 seconds", event_clock: bool = False,
    groups: int = GROUPS,
) -> DataFrame:
    """Failed attempts (``transaction_id, retry_count, error, failed_at``) as what comes next: (…, outcome, retry_count, at, error).

    The n-th retry comes out ``base ** n`` seconds after the failure, by timers of the machine's clock or, with
    ``event_clock``, of the watermark of ``failed_at``, for replays. (A stream on the machine's clock
    does not end by itself: run it with a trigger by time.) An attempt out of retries comes out at once as failed.
    State is kept by ``groups`` groups of requests.
    """
    state_on_disk(attempts.sparkSession)
    kind = attempts.schema["failed_at"].dataType
    timed, back = event_time(attempts, "failed_at")
    if event_clock:
        timed = timed.withWatermark("failed_at", late)
    keyed = timed.select(F.col("transaction_id").cast("long").alias("transaction_id"), F.col("retry_count").cast("int").alias("retry_count"), "error", "failed_at")
    keyed = keyed.withColumn("__at", instant_of(F.col("failed_at"), keyed.schema["failed_at"].dataType)).withColumn("__group", group_of("transaction_id", groups))
    mode = "EventTime" if event_clock else "ProcessingTime"
    found = keyed.groupBy("__group").transformWithState(Retries(max_retries, base, event_clock), RETRIES, "append", mode)
    return found.withColumn("at", back(F.timestamp_micros("at")).cast(kind))
