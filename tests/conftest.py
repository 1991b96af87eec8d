import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ferry.inputs import Inputs  # noqa: E402
from ferry.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def t(spark):
    return Inputs(spark, SMALL)


def rows(df, *names):
    """Rows as a sorted list of tuples."""
    found = df.select(*names).collect() if names else df.collect()
    return sorted((tuple(r) for r in found), key=lambda r: tuple((v is not None, str(v)) for v in r))
