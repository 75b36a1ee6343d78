"""A small local session shared by all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from commitloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def mined(spark):
    """A function from row dicts to a table of mined records; missing columns are null."""
    from commitloom.schemas import MINED, schema

    names = [f.name for f in schema(MINED).fields]

    def make(rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema(MINED))

    return make
