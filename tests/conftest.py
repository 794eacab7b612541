import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rillmap.session import get_session
    s = get_session(8, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
