"""Headline timings on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue import tables as t  # noqa: E402
from catalogue.queries import QUERIES  # noqa: E402
from riskloom.operators.forest import load_forest  # noqa: E402
from riskloom.plans.scoring import score_transactions  # noqa: E402
from riskloom.plans.training import train  # noqa: E402
from riskloom.session import build_session, new_folder  # noqa: E402
from riskloom.sources import events  # noqa: E402

HEADLINE = (
    "scored_transactions",
    "scored_transactions_default",
    "features",
    "velocity_1h",
    "velocity_hot_users",
    "user_history",
    "history_prior",
    "feature_drift",
    "drift_report",
    "curve_areas_continuous",
    "alert_fold",
    "audit_scoring",
    "audit_chains",
    "dashboard_kpis",
    "score_histogram",
    "score_trend",
    "report_queue",
    "prompts",
    "synthetic_transactions",
    "stream_scores",
)


def seconds_of(build) -> float:
    """Seconds to build and fully evaluate a DataFrame, without collecting its rows."""
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def run(spark, name: str, folder: str) -> float:
    return seconds_of(lambda: QUERIES[name](spark, folder))


def run_forest(spark, folder: str) -> dict[str, float]:
    """Training with 100 trees including its evaluation, then scoring with the saved model."""
    path = new_folder(spark, "bench-forest")
    rows = events.from_events(events.scan(spark, folder, "events"))
    fitted = seconds_of(lambda: train(rows, path=path).metrics)

    def score():
        context = t.context(spark, folder, with_history=True)
        return score_transactions(
            t.transactions(spark, folder), context, model=load_forest(spark, path), windows=t.WINDOWS, recent=t.BURST, counted=rows
        )

    return {"forest_training": fitted, "scored_with_forest": seconds_of(score)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    n = spark.read.parquet(f"{folder}/events.parquet").count()
    # One unmeasured run starts the JIT compiler and the Python workers.
    run(spark, "scored_transactions", folder)
    run_forest(spark, folder)
    timings = {name: run(spark, name, folder) for name in HEADLINE} | run_forest(spark, folder)
    seconds = {name: round(value, 3) for name, value in timings.items()}
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0),
        "rows": n,
        "rows_per_second": {
            "scoring_without_model": round(n / seconds["scored_transactions"]),
            "scoring_with_forest": round(n / seconds["scored_with_forest"]),
        },
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
