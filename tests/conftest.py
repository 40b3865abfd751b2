from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tidegrid.schema import PRICES
from tidegrid.session import build_session

SF = "/root/testdata/sf0.01"
SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def checkpoints(tmp_path_factory):
    return tmp_path_factory.mktemp("checkpoints")


@pytest.fixture(scope="session")
def spark(checkpoints):
    session = build_session(
        "tidegrid-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(checkpoints),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_prices(spark):
    """Price table from (stamp text or datetime, region, price[, changed]) tuples."""

    def make(rows):
        full = []
        for stamp, region, price, *changed in rows:
            at = datetime.fromisoformat(stamp) if isinstance(stamp, str) else stamp
            full.append((at, 1, price, changed[0] if changed else at, at.year, at.month, region))
        return spark.createDataFrame(full, PRICES)

    return make


@pytest.fixture(scope="session")
def grid():
    """Rows of a regular five-minute grid: ``grid("2024-01-01 00:00", "R", prices)``."""

    def rows(start, region, prices):
        first = datetime.fromisoformat(start)
        return [(first + timedelta(minutes=5 * i), region, float(p)) for i, p in enumerate(prices)]

    return rows
