"""Streams with keyed state and timers: counts, scoring, requests, retries, the alert machine, and repeatable stores."""

import bisect
import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_streaming import START, context, files, make, stream  # noqa: F401

from riskloom.operators import alerts as alert_ops
from riskloom.operators.dashboard import score_trend
from riskloom.operators.forest import fit_forest
from riskloom.operators.history import velocity
from riskloom.operators.tables import filter_alerts, filter_transactions
from riskloom.plans.scoring import score_transactions, store_scoring
from riskloom.sources.tables import audit_between, read_store, store_batch
from riskloom.streaming import alerts as alert_streams
from riskloom.streaming import jobs
from riskloom.streaming import reports as report_streams
from riskloom.streaming.velocity import keyed_velocity

TIMES = "id long, user_id string, ts timestamp_ntz, payload decimal(9,2)"


def run_in_parts(spark, folder, schema, parts, build, path):
    """Runs of one stream, each over one more file; all rows written."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = jobs.read_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, "*.parquet")
        writer = build(source).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{folder}/cp")
        jobs.run_to_end(writer)
    return spark.read.parquet(path)


def seconds(n):
    return START + timedelta(seconds=n)


def counted(parts, windows):
    """Counts by the rule: a row counts what has come so far, its own batch included."""
    times, out = defaultdict(list), {}
    for part in parts:
        for _, user, at, _ in part:
            if at is not None:
                bisect.insort(times[user], at)
        for i, user, at, _ in part:
            known = times[user]
            out[i] = tuple(
                None if at is None else bisect.bisect_right(known, at) - bisect.bisect_left(known, at - timedelta(seconds=w)) for w in windows
            )
    return out


def test_keyed_velocity_over_many_stretches(spark, tmp_path):
    draw, clock, parts = random.Random(2), 0, []
    for _ in range(3):
        part = []
        for _ in range(250):
            clock += draw.choice([0, 1, 7, 7, 60, 400])
            part.append((len(part) + 1000 * len(parts), draw.choice(["hot", "hot", "a", "b", None]), seconds(clock), None))
        draw.shuffle(part)  # any order within a batch
        parts.append(part)
    parts[0].append((9999, "hot", None, None))
    out = run_in_parts(spark, tmp_path, TIMES, parts, lambda s: keyed_velocity(s, {"n": 300, "m": 1800}, late=10), f"{tmp_path}/out")
    assert {r["id"]: (r["n"], r["m"]) for r in out.collect()} == counted(parts, (300, 1800))
    batch = velocity(spark.createDataFrame([r for p in parts for r in p], TIMES), {"n": 300, "m": 1800})
    columns = ("id", "user_id", "ts", "payload", "n", "m")
    assert rows(out, *columns) == rows(batch, *columns)  # in order, so equal to the batch operator


def test_a_late_row_counts_what_it_follows(spark, tmp_path):
    parts = [
        [(1, "u", seconds(0), None), (2, "u", seconds(100), None)],
        [(3, "u", seconds(200), None), (4, "u", seconds(50), None)],  # 4 is late by 50 s, within the allowance
        [(5, "u", seconds(250), None)],
        [(6, "u", seconds(260), None), (7, "u", seconds(10), None)],  # 7 lies behind the watermark
    ]
    out = run_in_parts(spark, tmp_path, TIMES, parts, lambda s: keyed_velocity(s, {"n": 300}, late=100), f"{tmp_path}/out")
    found = {r["id"]: r["n"] for r in out.collect()}
    assert found == {1: 1, 2: 2, 3: 4, 4: 2, 5: 5, 6: 6}


def test_state_goes_with_the_window(spark, tmp_path):
    """Half a day of a minute's rows leaves state for the last hours' stretches only."""
    parts = [[(60 * h + m, "u", seconds(3600 * h + 60 * m), None) for m in range(60)] for h in range(12)]
    folder = f"{tmp_path}/in"
    for part in parts:
        spark.createDataFrame(part, TIMES).coalesce(1).write.mode("append").parquet(folder)
    source = jobs.read_stream(spark, folder, spark.createDataFrame([], TIMES).schema, "*.parquet", per_trigger=1)
    out = keyed_velocity(source, {"n": 600}, late=60)
    query = out.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    # Values and timers of at most the stretch at hand and its neighbours, not of the nine stretches there were.
    assert max(kept) <= 12 and kept[-1] <= 6


def test_one_stream_scores_with_counts_and_model(spark, files, context, tmp_path):  # noqa: F811
    batch_rows = spark.read.parquet(files)
    windows = {"tx_count_last_5min": 300, "tx_count_last_1h": 3600}
    features = [F.col("amount").cast("double"), F.col("transaction_id").cast("double") % 7] + [F.lit(0.0)] * 8
    model = fit_forest(batch_rows, features, n_trees=10, psi=64, contamination=0.1)
    for forest in (None, model):
        out = f"{tmp_path}/{forest is None}"
        scored = jobs.score_stream(stream(spark, files), context.settled(), model=forest, windows=windows, recent="tx_count_last_1h", late=60)
        jobs.run_to_end(jobs.scoring_sink(scored, out, f"{out}/cp"))
        want = score_transactions(batch_rows, context, model=forest, windows=windows, recent="tx_count_last_1h")
        columns = ("transaction_id", "rule_score", "ml_score", "ensemble_score", "threshold", "classification", "fired_rules")
        got = read_store(spark, f"{out}/scores")
        assert rows(got, *columns) == rows(want, *columns)
        assert got.filter(F.array_contains("fired_rules", "high_velocity")).count() > 50


def test_batches_and_streams_share_a_store(spark, files, context, tmp_path):  # noqa: F811
    scored = score_transactions(spark.read.parquet(files), context, weights={"rule": 1.0})
    path = f"{tmp_path}/store"
    for _ in range(2):
        store_scoring(scored, path)
        store_scoring(scored.filter("transaction_id < 50"), path, "first-fifty")
    streamed = jobs.score_stream(stream(spark, files), context.settled(), weights={"rule": 1.0}, windows={"tx_count_last_5min": 300})
    for run in range(2):
        jobs.run_to_end(jobs.scoring_sink(streamed, path, f"{tmp_path}/cp{run}"))
    scores = read_store(spark, f"{path}/scores")
    assert scores.count() == 300 + 50 + 300
    assert scores.select("batch_id").distinct().count() == 5
    assert read_store(spark, f"{tmp_path}/nothing") is None
    # A batch stored again without its last day leaves nothing of it.
    later = spark.createDataFrame([(1, START), (2, START + timedelta(days=1))], "x int, created_at timestamp_ntz")
    store_batch(later, f"{tmp_path}/days", "b")
    store_batch(later.filter("x = 1"), f"{tmp_path}/days", "b")
    assert rows(read_store(spark, f"{tmp_path}/days"), "x") == [(1,)]


def test_time_bounds_open_only_their_days(spark, tmp_path):
    """Partition filters on the day for audit range, transaction and alert lists, and the trend; same rows as without days."""
    schema = "transaction_id long, status string, deleted_at timestamp_ntz, ensemble_score double, sha256_checksum string, created_at timestamp_ntz"
    plain = spark.createDataFrame([(i, "open", None, float(i), str(i), START + timedelta(hours=7 * i)) for i in range(100)], schema)
    store_batch(plain, f"{tmp_path}/t", "b")
    table = read_store(spark, f"{tmp_path}/t")
    start, end = START + timedelta(days=3, hours=5), START + timedelta(days=9, hours=2)
    reads = [
        lambda df: audit_between(df, start, end).select("transaction_id"),
        lambda df: filter_transactions(df, date_from=start, date_to=end).select("transaction_id"),
        lambda df: filter_alerts(df, status="open", date_from=start, date_to=end).select("transaction_id"),
        lambda df: score_trend(df, end, 4),
    ]
    for read in reads:
        plan = read(table)._jdf.queryExecution().toString()
        scans = [line for line in plan.splitlines() if "PartitionFilters" in line and "PartitionFilters: []" not in line]
        assert any("day" in line for line in scans), plan
        assert rows(read(table)) == rows(read(plain))


SCORED = "transaction_id long, classification string, created_at timestamp_ntz"


def test_requests_are_queued_once(spark, tmp_path):
    """Repeats within a batch, over batches, beyond the state's reach and in a replay; known reports stay out."""
    known = spark.createDataFrame([(7,)], "transaction_id long")
    parts = [
        [(1, "fraud", seconds(0)), (1, "fraud", seconds(5)), (2, "legitimate", seconds(6)), (7, "fraud", seconds(7))],
        [(1, "fraud", seconds(20)), (3, "fraud", seconds(30))],
        [(1, "fraud", seconds(90000)), (2, "fraud", seconds(90001)), (3, "fraud", seconds(90002))],
    ]
    for part in parts:
        spark.createDataFrame(part, SCORED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for checkpoint in ("a", "b"):
        source = jobs.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCORED).schema, "*.parquet", per_trigger=1)
        jobs.run_to_end(report_streams.enqueue_sink(source, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", lambda: known, late="1 minute"))
        assert rows(read_store(spark, f"{tmp_path}/out"), "transaction_id", "retry_count") == [(1, 0), (2, 0), (3, 0)]


def test_messages_of_a_repeated_batch(spark, tmp_path):
    lines = [('{"transaction_id": "t1", "retry_count": 2}',), ("not json",), ('{"transaction_id": "t2"}',)]
    spark.createDataFrame(lines, "value string").write.text(f"{tmp_path}/in")
    for checkpoint in ("a", "b"):
        jobs.run_to_end(report_streams.request_sink(spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}"))
    assert rows(read_store(spark, f"{tmp_path}/out/requests"), "transaction_id", "retry_count") == [("t1", 2), ("t2", 0)]
    assert rows(read_store(spark, f"{tmp_path}/out/rejects"), "value") == [("not json",)]


ATTEMPTS = "transaction_id long, retry_count int, error string, failed_at timestamp_ntz"


def test_retries_come_when_due(spark, tmp_path):
    """Each run's clock decides which retries have come out by then."""
    parts = [
        [(1, 0, "a", seconds(0)), (2, 1, "b", seconds(0)), (3, 3, "c", seconds(0)), (4, None, None, seconds(2))],
        [(None, None, None, seconds(4))],
        [(1, 1, "again", seconds(6)), (None, None, None, seconds(10))],
        [(None, None, None, seconds(1000))],
    ]
    due = []
    for n in range(1, 5):
        folder = f"{tmp_path}/{n}"
        out = run_in_parts(spark, folder, ATTEMPTS, parts[:n], lambda s: report_streams.retry_timers(s, event_clock=True), f"{folder}/out")
        due.append({(r["transaction_id"], r["outcome"], r["retry_count"], r["at"], r["error"]) for r in out.collect()})
    assert due[0] == {(3, "failed", 3, seconds(0), "c")}
    assert due[1] - due[0] == {(1, "retry", 1, seconds(3), "a")}
    assert due[2] - due[1] == {(4, "retry", 1, seconds(5), None), (2, "retry", 2, seconds(9), "b")}
    assert due[3] - due[2] == {(1, "retry", 2, seconds(15), "again")}


def test_retries_by_the_machine_clock(spark, tmp_path):
    """Failures of long ago are due at once, those of tomorrow wait."""
    now = datetime.now()
    part = [(1, 0, "old", now - timedelta(days=1)), (2, 0, "new", now + timedelta(days=1)), (3, 3, "over", now)]
    folder, schema = f"{tmp_path}/in", ATTEMPTS
    spark.createDataFrame(part, schema).coalesce(1).write.parquet(folder)
    source = jobs.read_stream(spark, folder, spark.createDataFrame([], schema).schema, "*.parquet")
    writer = report_streams.retry_timers(source).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    query = writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        found, until = set(), time.monotonic() + 60
        while len(found) < 2 and time.monotonic() < until:
            time.sleep(1)
            out = read_store(spark, f"{tmp_path}/out")
            found = set() if out is None else set(rows(out, "transaction_id", "outcome"))
        assert query.exception() is None and found == {(1, "retry"), (3, "failed")}
    finally:
        query.stop()


ACTIONS = "action_id string, alert_id string, action string, analyst_id string, reason string, acted_at timestamp_ntz"


def test_alert_machine_on_shuffled_actions(spark, tmp_path):
    draw = random.Random(9)
    table = spark.createDataFrame(
        [(f"a{i}", i, draw.choice(["open", "reviewed"]), None, None) for i in range(12)],
        "alert_id string, transaction_id long, status string, reviewed_by string, reviewed_at timestamp_ntz",
    )
    actions = [
        (f"x{n}", draw.choice([*(f"a{i}" for i in range(10)), "a1", "a1", "a1", "unknown"]), draw.choice(["review", "false_positive", "revert"]), f"y{n % 3}", draw.choice([None, " ", "why"]), seconds(draw.randrange(400)))
        for n in range(150)
    ]
    parts = [[a for i, a in enumerate(actions) if i % 3 == p] for p in range(3)] + [[(None, None, None, None, None, seconds(9000))]]
    batch = spark.createDataFrame(actions, ACTIONS)
    want = alert_ops.action_transitions(table, batch)
    columns = ("action_id", "alert_id", "transaction_id", "action", "acted_at", "previous_status", "new_status")
    out = run_in_parts(spark, f"{tmp_path}/m", ACTIONS, parts, lambda s: alert_streams.alert_transitions(s, table, late="1 hour"), f"{tmp_path}/out")
    assert rows(out, *columns) == rows(want, *columns)
    assert rows(alert_streams.current_alerts(table, out)) == rows(alert_ops.fold_actions(table, batch))
    source = jobs.read_stream(spark, f"{tmp_path}/m/in", batch.schema, "*.parquet", per_trigger=1)
    moved = alert_streams.alert_transitions(source, table, late="1 hour")
    jobs.run_to_end(alert_streams.alert_sink(moved, f"{tmp_path}/sink", f"{tmp_path}/sinkcp"))
    illegal = read_store(spark, f"{tmp_path}/sink/illegal")
    assert rows(illegal, "action_id", "problems") == rows(alert_ops.illegal_actions(want), "action_id", "problems")


@pytest.mark.parametrize("action", ["review", "revert"])
def test_actions_wait_for_the_watermark(spark, tmp_path, action):
    table = spark.createDataFrame([("a", 1, "open", None, None)], "alert_id string, transaction_id long, status string, reviewed_by string, reviewed_at timestamp_ntz")
    parts = [[("1", "a", action, "y", None, seconds(100))], [("0", "a", "false_positive", "y", "r", seconds(90))]]
    build = lambda s: alert_streams.alert_transitions(s, table, late="30 seconds")
    assert run_in_parts(spark, f"{tmp_path}/m", ACTIONS, parts, build, f"{tmp_path}/out").count() == 0
    out = run_in_parts(spark, f"{tmp_path}/m", ACTIONS, [[(None, None, None, None, None, seconds(200))]], build, f"{tmp_path}/out")
    assert rows(out, "action_id", "previous_status") == [("0", "open"), ("1", "resolved")]


class Calls:
    """A state and its handle that count what a processor asks of the store."""

    def __init__(self):
        self.n, self.rows = 0, []

    def getListState(self, *_):
        return self

    getMapState = getValueState = getListState

    def appendList(self, rows):
        self.n, self.rows = self.n + 1, self.rows + rows

    def put(self, rows):
        self.n, self.rows = self.n + 1, rows

    def get(self):
        self.n += 1
        return iter(self.rows)

    def registerTimer(self, at):
        self.n += 1

    def clear(self):
        self.n, self.rows = self.n + 1, []


class Clock:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_the_store_is_asked_per_group_not_per_attempt():
    calls = Calls()
    processor = report_streams.Retries(3, 3, True)
    processor.init(calls)
    part = [{"transaction_id": i, "retry_count": 0, "error": "e", "__at": 1_000_000 * i} for i in range(1000)]
    assert list(processor.handleInputRows((0,), iter(part), Clock(0))) == []
    out = list(processor.handleExpiredTimer((0,), Clock(500_000), Clock(3000)))
    assert sorted(r.transaction_id for r in out) == list(range(498)) and len(calls.rows) == 502
    assert calls.n <= 6


def test_requests_of_one_group_come_when_due(spark, tmp_path):
    """One group gives in each run what groups of one request give, at the very millisecond and with repeated attempts too."""
    parts = [
        [(1, 0, "a", seconds(0)), (2, 0, "b", seconds(1)), (5, 1, "e", seconds(1)), (5, 1, "e", seconds(1)), (None, 0, "n", seconds(1))],
        [(None, None, None, seconds(4))],
        [(2, 0, "b", seconds(4)), (None, None, None, seconds(1000))],
    ]
    for n in (2, 3):
        found = []
        for groups in (1, 8192):
            folder = f"{tmp_path}/{n}-{groups}"
            out = run_in_parts(spark, folder, ATTEMPTS, parts[:n], lambda s: report_streams.retry_timers(s, event_clock=True, groups=groups), f"{folder}/out")
            found.append(rows(out, "transaction_id", "outcome", "retry_count", "at", "error"))
        assert found[0] == found[1] and len(found[0]) >= n - 1


def test_alerts_of_one_group_keep_their_own_status(spark, tmp_path):
    draw = random.Random(4)
    table = spark.createDataFrame(
        [(f"a{i}", i, draw.choice(["open", "reviewed"]), None, None) for i in range(9)],
        "alert_id string, transaction_id long, status string, reviewed_by string, reviewed_at timestamp_ntz",
    )
    actions = [(f"x{n}", f"a{draw.randrange(9)}", draw.choice(["review", "false_positive", "revert"]), "y", None, seconds(60 * n)) for n in range(90)]
    parts = [actions[:45], actions[40:], [(None, None, None, None, None, seconds(9000))]]  # some come twice
    want = alert_ops.action_transitions(table, spark.createDataFrame(actions, ACTIONS))
    build = lambda s: alert_streams.alert_transitions(s, table, late="10 minutes", groups=1)
    out = run_in_parts(spark, f"{tmp_path}/m", ACTIONS, parts, build, f"{tmp_path}/out")
    columns = ("action_id", "alert_id", "transaction_id", "previous_status", "new_status")
    assert rows(out, *columns) == rows(want, *columns)


def test_users_of_one_group_are_counted_apart(spark, tmp_path):
    draw = random.Random(5)
    parts = [[(100 * p + i, draw.choice(["a", "b", "c", None]), seconds(2000 * p + 20 * i), None) for i in range(100)] for p in range(2)]
    out = run_in_parts(spark, tmp_path, TIMES, parts, lambda s: keyed_velocity(s, {"n": 300}, late=10, groups=1), f"{tmp_path}/out")
    assert {r["id"]: (r["n"],) for r in out.collect()} == counted(parts, (300,))
