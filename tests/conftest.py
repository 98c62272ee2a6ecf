import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quercus.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "quercus-tests",
        spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression on one row of the given fields."""

    kinds = {list: "array<string>", int: "bigint"}

    def run(expression, **fields):
        given = [F.lit(v).cast(kinds.get(type(v), "string")).alias(n) for n, v in fields.items()]
        return spark.range(1).select("id", *given).select(expression.alias("x")).first().x

    return run
