import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "3",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    session = build_session("tests", "local[8]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    """Cut even small fixtures into several cells."""
    monkeypatch.setattr("riskloom.operators.skew.SMALL_CELL", 20)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def value(spark):
    """Values of Columns over one row of literals: ``value(column, schema, row)``."""

    def run(column, schema="x int", row=(1,)):
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return run


def rows(df, *columns):
    """All rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in chosen.collect()), key=repr)
