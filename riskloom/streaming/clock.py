"""Event time and state of streams: zoned times for watermarks, and state stores on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

GROUPS = 8192  # of keys that share a state; fixed for a checkpoint's life

# State in RocksDB; files grow as they fill, for a store of few entries would else reserve megabytes.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def state_on_disk(spark: SparkSession) -> None:
    """Keyed state and timers need RocksDB; a store the session has chosen itself stays."""
    for name, value in STATE_STORE.items():
        if spark.conf.get(name, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider", "true"):
            spark.conf.set(name, value)


def event_time(stream: DataFrame, ts: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The stream with the zoned time that watermarks need, and the way back.

    Wall-clock times are taken as UTC, whatever zone the session has, so that windows begin at full
    hours and days of that clock.
    """
    if stream.schema[ts].dataType != TimestampNTZType():
        return stream, lambda column: column
    zone = F.current_timezone()
    timed = stream.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    return timed, lambda column: F.to_utc_timestamp(column, zone).cast("timestamp_ntz")


def instant_of(ts: Column, kind: DataType) -> Column:
    """Microseconds since 1970; wall-clock times count as UTC."""
    if kind == TimestampNTZType():
        ts = F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    return F.unix_micros(ts.cast("timestamp"))


def group_of(key: str, groups: int) -> Column:
    """The group of a key whose state it shares."""
    return F.pmod(F.xxhash64(key), F.lit(groups))


def next_timer(instants: Iterable[int]) -> int:
    """The millisecond by which the first of these instants has come."""
    return -(-min(instants) // 1000)


def passed(clock: int, timer: Any) -> int:
    """The last instant whose own timer would have expired, if ``timer`` has; ``clock`` is in milliseconds."""
    return 1000 * max(timer.getExpiryTimeInMs(), clock)


def put_back(handle: Any, state: Any, rows: list[tuple], instants: Iterable[int]) -> None:
    """What still waits, in place of the list's rows, and a timer for the first of it."""
    if rows:
        state.put(rows)
        handle.registerTimer(next_timer(instants))
    else:
        state.clear()
