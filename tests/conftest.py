import pytest

from tests.oracle import session


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Collected rows as sorted tuples of the named columns."""

    def collect(df, *cols):
        return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())

    return collect
