import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aerocal.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def hours(spark):
    """Build (key, ts, x) rows from values at consecutive hours."""

    def build(values, key="a", start=dt.datetime(2024, 1, 1)):
        rows = [(key, start + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "key string, ts timestamp_ntz, x double")

    return build


def column(df, name, order="ts"):
    return [row[name] for row in df.orderBy(order).collect()]
