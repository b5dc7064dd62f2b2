from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from palimpsest import build_session  # noqa: E402
from palimpsest.plans.ordered import HOT_ROWS_SETTING  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "sliced"])
def hot_mode(request, spark):
    """Runs a test with whole keys and with keys cut into slices."""
    if request.param == "sliced":
        spark.conf.set(HOT_ROWS_SETTING, "3")
    yield request.param
    spark.conf.unset(HOT_ROWS_SETTING)
