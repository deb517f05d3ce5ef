"""Trailing counts of a stream from keyed state that event-time timers drop."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from riskloom.schemas import WINDOW_1H, WINDOW_5MIN
from riskloom.streaming.clock import event_time, instant_of, state_on_disk

STRETCH = 8
GROUPS = 4096  # fixed for a checkpoint's life
WINDOWS = {"tx_count_last_5min": WINDOW_5MIN, "tx_count_last_1h": WINDOW_1H}


class TrailingCounts(StatefulProcessor):
    """State of one group of users and one stretch of time: the distinct times that rows of the stretch can reach, and the rows at each, by user.

    Many users share a state, since each call to the store costs more than the rows of a user. What rows of the stretch reach
    before its beginning comes along without asking for counts. Rows of a batch are counted together with the state: their
    order does not matter, and a late row finds the earlier ones. Times that the watermark has left behind by the longest
    window and ``late`` go at the next batch; one timer, set for when the watermark lets in no more rows of the stretch, drops
    the state of an idle group.
    """

    def __init__(self, windows: Mapping[str, int], width: int, late: int, user: StructField, columns: list[str]):
        self.micros = [1_000_000 * seconds for seconds in windows.values()]
        self.width, self.late, self.places = width, late, {name: i for i, name in enumerate(columns)}
        self.row, self.user = Row(*columns, *windows), user

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        users = StructField("user", ArrayType(self.user.dataType))
        self.seen = handle.getValueState("seen", StructType([users, *[StructField(name, ArrayType(LongType())) for name in ("at", "n")]]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        at_, asks, user_ = self.places["__at"], self.places["__asks"], self.places[self.user.name]
        held, asking = defaultdict(dict), defaultdict(list)
        seen = self.seen.get()
        if seen is not None:
            for user, at, n in zip(*seen):
                held[user][at] = n
        elif key[-1] is not None:
            self.handle.registerTimer(1000 * ((key[-1] + 1) * self.width + self.late))
        for row in rows:
            user, at = row[user_], row[at_]
            if at is not None:
                held[user][at] = held[user].get(at, 0) + 1
            if row[asks]:
                asking[user].append(row)
        first = 1000 * (timerValues.getCurrentWatermarkInMs() - 1000 * self.late) - max(self.micros)
        kept = [(user, at, n) for user, times in held.items() for at, n in times.items() if at >= first]
        if kept:
            self.seen.update(tuple(list(column) for column in zip(*kept)))
        for user, asked in asking.items():
            times, upto = sorted(held.get(user, ())), [0]
            for at in times:
                upto.append(upto[-1] + held[user][at])
            for row in asked:
                counts = [None] * len(self.micros)
                if row[at_] is not None:
                    here = upto[bisect.bisect_right(times, row[at_])]
                    counts = [here - upto[bisect.bisect_left(times, row[at_] - reach)] for reach in self.micros]
                yield self.row(*row, *counts)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.seen.clear()
        return iter([])


def keyed_velocity(
    stream: DataFrame, windows: Mapping[str, int] | None = None, *, user: str = "user_id", ts: str = "ts", clock: str | None = None, late: int = 3600,
    groups: int = GROUPS,
) -> DataFrame:
    """The stream with the trailing counts of ``operators.history.velocity``, each row counted when it comes.

    The watermark follows ``clock`` (``ts`` itself, or a time of arrival) by ``late`` seconds; Spark drops rows behind it.
    A row in time counts all rows known so far, late ones included; counts already given stay as they are. A row without a
    time counts nothing. A key is a stretch of ``STRETCH`` windows of one of ``groups`` groups of users, so that a replay spreads one
    user's rows of many days over many tasks; a state holds distinct times of the longest window, ``late`` and the current batch.
    """
    windows = dict(windows or WINDOWS)
    state_on_disk(stream.sparkSession)
    clock, reach = clock or ts, max(max(windows.values()), 1)
    width = STRETCH * reach
    timed, back = event_time(stream, clock)
    timed = timed.withWatermark(clock, f"{int(late)} seconds").withColumn("__at", instant_of(F.col(ts), stream.schema[ts].dataType))
    stretch = F.floor(F.col("__at") / (1_000_000 * width))
    own = F.struct(stretch.alias("__stretch"), F.lit(True).alias("__asks"))
    after = F.struct((stretch + 1).alias("__stretch"), F.lit(False).alias("__asks"))
    near_end = F.col("__at") >= 1_000_000 * ((stretch + 1) * width - reach)
    copies = F.when(near_end, F.array(own, after)).otherwise(F.array(own))
    keyed = timed.withColumn("__copy", F.explode(copies)).withColumns({"__stretch": F.col("__copy.__stretch"), "__asks": F.col("__copy.__asks")}).drop("__copy")
    # Copies that ask nothing carry their time alone.
    carried = [F.col(c) if c in (user, clock) else F.when(F.col("__asks"), F.col(c)).alias(c) for c in stream.columns]
    keyed = keyed.select(*carried, "__at", "__asks", F.pmod(F.xxhash64(user), F.lit(groups)).alias("__group"), "__stretch")
    out = StructType([*keyed.schema.fields, *[StructField(name, LongType()) for name in windows]])
    processor = TrailingCounts(windows, width, int(late), keyed.schema[user], keyed.columns)
    counted = keyed.groupBy("__group", "__stretch").transformWithState(processor, out, "append", "EventTime")
    return counted.drop("__at", "__asks", "__group", "__stretch").withColumn(clock, back(F.col(clock)))
