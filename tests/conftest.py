import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siteweave.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=4)
    s.conf.set("spark.sql.session.timeZone", "UTC")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def rows(spark):
    """``rows(schema, *tuples)`` as a DataFrame."""

    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make
