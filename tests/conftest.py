import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Collect a table as a list of dicts, ordered by the given columns."""

    def collect(df, *order):
        return [row.asDict() for row in (df.orderBy(*order) if order else df).collect()]

    return collect
