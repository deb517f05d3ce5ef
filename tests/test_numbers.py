import datetime
import json
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.functions.jsontext import json_object, json_string, json_string_list
from riskloom.functions.numbers import double_text, fixed_text, round_exact

QUIET = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))


def test_rounding_follows_the_exact_value(spark):
    rng = random.Random(1)
    numbers = [2.675, 13.25, 0.35, 0.45, 0.25, 0.75, 29.25, 1.005, -2.675, 0.125, 1e-9, 0.0, -0.5, -0.0, -0.0001, -0.04, -0.05]
    numbers += [rng.randint(0, 200000) / 1000 for _ in range(5000)] + [rng.randint(0, 10**6) / 20000 for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for digits in (1, 2, 4):
        for row in df.select("x", round_exact(F.col("x"), digits).alias("r"), fixed_text(F.col("x"), digits).alias("t")).collect():
            assert row["r"] == round(row["x"], digits)
            assert row["t"] == f"{row['x']:.{digits}f}"


def test_double_text(spark):
    rng = random.Random(2)
    numbers = [0.0, -0.0, 1e-4, 1.5e-4, 9.99e-4, 1e-5, 1.25e-7, 1e7, 123456789.123, 1e15, 1e16, -2.5e17, 1.25e300, -3.25e8, 100.0, 13.5]
    numbers += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for row in df.select("x", double_text(F.col("x")).alias("t")).collect():
        assert row["t"] == repr(row["x"])


@QUIET
@given(st.lists(st.text(max_size=20).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)), min_size=1, max_size=50))
def test_json_strings(spark, texts):
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    for row in df.select("s", json_string(F.col("s")).alias("t")).collect():
        assert row["t"] == json.dumps(row["s"])


def test_json_values(value):
    assert value(json_string(F.lit(None).cast("string"))) == "null"
    assert value(json_string_list(F.array(F.lit("a"), F.lit("b")))) == '["a", "b"]'
    assert value(json_string_list(F.array().cast("array<string>"))) == "[]"
    nothing = F.lit(None).cast("string")
    assert value(json_object({"b": nothing, "a": F.lit("1"), "c": F.lit("2")}, drop_null=True)) == '{"a": 1, "c": 2}'


def test_text_before_a_last_line_end_is_escaped(value):
    from riskloom.functions.jsontext import json_string

    for text in ("plain", "x\n", "x\r\n", "x\u2028"):
        assert value(json_string(F.col("x")), "x string", (text,)) == json.dumps(text)


def test_iso_texts_have_all_separators_or_none(value):
    from riskloom.functions.clock import parse_wall_clock

    for text in ("2024-0101", "2024-01-01T03:0000", "2024-01-01\n", "202401-01"):
        assert value(parse_wall_clock(F.col("x")), "x string", (text,)) is None
    for text in ("2024-01-02", "20240102", "2024-01-02T03:04", "20240102T030405", "2024-01-02T03:04:05.25+01:00"):
        expected = datetime.datetime.fromisoformat(text).replace(tzinfo=None)
        assert value(parse_wall_clock(F.col("x")), "x string", (text,)) == expected


def test_no_score_stays_pending(value):
    from riskloom.functions.ensemble import classify, status_from_class

    assert value(classify(F.col("x"), F.lit(1.0)), "x double", (None,)) is None
    assert value(status_from_class(classify(F.col("x"), F.lit(1.0))), "x double", (None,)) == "pending"
