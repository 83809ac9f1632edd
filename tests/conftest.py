import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from hunkwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("hunkwise-tests", cpus=8, spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session


def rows(df, *order):
    """Rows as tuples, sorted by the named columns."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
