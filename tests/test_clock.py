"""Texts of times against the standard library's reader."""

import random
from datetime import datetime

from riskloom.functions.clock import parse_wall_clock

DATES = ["2024-W01-1", "2024W011", "2024-W01", "2024W01", "2020-W53-7", "2021-W53-1", "2024-W00-1", "2024-W10-8", "2024-W10-0", "0001-W01-1", "9999-W52-7"]
TIMES = ["", "T10", "T10:30", "T1030", "-10:00", "-10", "1", "110", "11030", " 23:59:59.5", "T25:00", "W10:00", "T10:00:00+02:00", "-", "x"]
PLAIN = ["2024-01-05W10:00", "20240105W1000", "W", "2024-W", "2024W1", "2024-W1-1", "2024-W011", "2024W01-1"]


def read(text):
    try:
        return datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        return None


def test_week_dates(spark):
    draw = random.Random(5)
    texts = [d + t for d in DATES for t in TIMES] + PLAIN
    for _ in range(400):
        year, week, day = draw.randrange(1900, 2100), draw.randrange(0, 55), draw.randrange(0, 9)
        texts.append(draw.choice([f"{year}-W{week:02d}-{day}", f"{year}W{week:02d}{day}"]) + draw.choice(["", "T08:15:00", "T0815"]))
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r["t"]: r["p"] for r in frame.select("t", parse_wall_clock(frame["t"]).alias("p")).collect()}
    wrong = {t: (found[t], read(t)) for t in texts if found[t] != read(t)}
    assert not wrong, wrong
